"""Exact and near deduplication, and repeated passages, against plain versions."""

import hashlib
import re
from collections import Counter

import numpy as np
from xxhash import xxh64_intdigest

from hindsight.llm import exact_dedup, near_copies, simhash, substrings
from tests.conftest import bag, order

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact(docs, rows):
    got = bag(exact_dedup.deduplicate(docs), "doc_id", "keep_id", "group_size", "kept", "digest")
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(UP), []).append(r[0])
    want, seen = [], set()
    for r in rows:
        text = (r[1] or "").translate(UP)
        ids = groups[text]
        keep = max((i for i in ids if i is not None), default=None)
        first = r[0] == keep and text not in seen
        if first:
            seen.add(text)
        want.append((r[0], keep, len(ids), first, hashlib.sha256(text.encode()).digest()))
    assert [tuple(map(bytes_, g)) for g in got] == sorted([tuple(map(bytes_, w)) for w in want], key=order)


def bytes_(v):
    return bytes(v) if isinstance(v, (bytearray, bytes)) else v


def test_exact_empty(no_docs):
    assert exact_dedup.deduplicate(no_docs).collect() == []


def test_index_is_carried_on(spark, frame, tmp_path):
    path = str(tmp_path / "index")
    first = frame("doc_id long, text string", (1, "A"), (2, "b"))
    exact_dedup.deduplicate(first, index=exact_dedup.DigestIndex(spark, path))
    later = exact_dedup.DigestIndex(spark, path)
    out = exact_dedup.deduplicate(frame("doc_id long, text string", (7, "a"), (8, "c")), index=later)
    assert bag(out, "doc_id", "keep_id", "kept") == [(7, 1, False), (8, 8, True)]
    assert later.rows().count() == 3


def plain_fingerprint(text):
    w = words_of((text or "").translate(UP))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, distance):
    label = {i: i for i in range(len(fps))}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            best = min(label[j] for j in np.flatnonzero(near[i]))
            if best < label[i]:
                label[i], changed = best, True
    return [min((ids[j] for j in range(len(ids)) if label[j] == label[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def test_simhash(docs, rows):
    got = bag(simhash.near_duplicates(docs).selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) fp", "component_id"))
    fps = [plain_fingerprint(r[1]) for r in rows]
    of = plain_components([r[0] for r in rows], np.array(fps, np.uint64), 2)
    assert got == sorted([(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, of, strict=True)], key=order)


def test_simhash_empty(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


def test_links_in_crowded_buckets(spark, monkeypatch):
    """Thousands of fingerprints around a few centres: buckets are split and no link is lost."""
    monkeypatch.setattr(simhash, "BUCKET", 32)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (1500, 3)).astype(np.uint64)
    fps = np.unique(centres[rng.integers(0, 6, 1500)] ^ flips[:, 0] ^ np.where(rng.random(1500) < 0.7, flips[:, 1], 0) ^ np.where(rng.random(1500) < 0.3, flips[:, 2], 0))
    nodes = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, rep long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, 2)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    mine = [roots.get(int(f), int(f)) for f in fps.view(np.int64)]
    assert len(set(zip(label.tolist(), mine, strict=True))) == len(set(label.tolist())) == len(set(mine))


def test_thresholds():
    assert simhash.allocate([[0, 5, 90, 900], [0, 5, 90, 900], [0, 5, 90, 900]], 2) == [0, 0, 0]
    assert simhash.allocate([[0, 1, 2, 900], [0, 5, 90, 900], [0, 800, 900, 900]], 2) == [1, 0, -1]
    parts = simhash.group_bits(0, np.zeros((64, 64)), 3)
    assert sorted(b for p in parts for b in p) == list(range(64)) and {len(p) for p in parts} == {21, 22}


def test_near_copies(docs, rows):
    found = near_copies.groups(docs)
    assert {(r["doc_id"], r["group"]) for r in found.collect()} == {(6, 5), (5, 5), (12, 11), (13, 11), (11, 11), (9, 9), (10, 9), (100, 9)}
    assert {r["doc_id"] for r in near_copies.duplicates(docs).collect()} == {6, 12, 13, 10, 100}


def test_near_copies_empty(no_docs):
    assert near_copies.groups(no_docs).collect() == []


def plain_removed(rows, window):
    count = Counter(tuple(w[i : i + window]) for w in (words_of(r[1]) for r in rows) for i in range(len(w) - window + 1))
    out = []
    for r in rows:
        w = words_of(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=order)


def test_repeats(docs, rows):
    assert bag(substrings.remove_repeats(docs, with_text=True)) == plain_removed(rows, substrings.WINDOW)


def test_repeats_of_every_kind(spark):
    """Few different words and a short window: repeats overlap themselves and each other."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 40)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(substrings.remove_repeats(docs, 9, 4, with_text=True)) == plain_removed(rows, 9)


def test_repeats_empty(no_docs):
    assert substrings.remove_repeats(no_docs).collect() == []


def test_near_copies_behind_an_unrelated_text(frame):
    """Texts of the same distinct words: a pair of near copies is found though a third comes first."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    shuffled = [" ".join(rng.permutation(words)) for _ in range(4)]
    rows = [(1, shuffled[0]), (2, shuffled[1]), (3, shuffled[1] + " w0 w1 w2"), (4, shuffled[2]), (5, shuffled[3]), (6, "w9 w8 " + shuffled[3])]
    docs = frame("doc_id long, text string", *rows)
    assert {r["doc_id"] for r in near_copies.duplicates(docs).collect()} == {3, 6}


def plain_groups(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words_of((t or "").translate(UP)) for _, t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {(rows[i][0], rows[r][0]) for i, r in enumerate(root) if root.count(r) > 1}


def test_near_copies_are_all_found(frame):
    """Pairs at exactly 0.8 and about it, of every length, and crowds of them in parts; as a comparison of all pairs finds."""
    rng = np.random.default_rng(11)
    texts = []
    for k in range(60):
        n = int(rng.integers(5, 120))
        base = [f"t{k}_{i}" for i in range(n)]
        more = int((n - 4) * rng.choice([0.15, 0.25, 0.25, 0.3]))
        texts += [base, base + [f"n{k}_{i}" for i in range(more)]]
    crowd = [f"c{i}" for i in range(60)]
    for _ in range(40):
        some = list(crowd)
        for i in rng.integers(0, 60, 2):
            some[i] = f"x{rng.integers(0, 6)}"
        texts.append(some)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = frame("doc_id long, text string", *rows)
    want = plain_groups(rows)
    assert len(want) > 80
    for bucket in (1024, 4):
        assert {(r["doc_id"], r["group"]) for r in near_copies.groups(docs, bucket=bucket).collect()} == want
