"""Common lines, phrases and source divergence against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hindsight.llm import collocations, divergence, line_dedup
from tests.conftest import bag, order

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def by_order(rows):
    return sorted(rows, key=order)


# ---- lines ------------------------------------------------------------------


def plain_lines(rows, least, shortest=1, keep_first=False):
    """(id, lines, dropped, kept) for rows (id, text)."""
    key = lambda line: line.strip(SPACE).translate(UP)
    texts = [(i, t or "") for i, t in rows]
    docs = Counter(k for _, t in texts for k in {key(x) for x in t.split("\n")})
    common = {k for k, n in docs.items() if n >= least and len(k) >= shortest}
    first = {}
    if keep_first:
        for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0)):
            for n, line in enumerate(t.split("\n")):
                first.setdefault(key(line), (i, t, n))
    out = []
    for i, t in texts:
        lines = t.split("\n")
        kept = [x for n, x in enumerate(lines) if key(x) not in common or (keep_first and first[key(x)] == (i, t, n))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return by_order(out)


def lined(n=400, seed=3):
    rng = random.Random(seed)
    stock = [f"line {i}" for i in range(40)] + ["", "  ", "\tShared LINE\r", "shared line", "Ünder", "ünder", "é"]
    rows = [(i, "\n".join(rng.choice(stock[: rng.randrange(1, len(stock) + 1)]) for _ in range(rng.randrange(0, 9)))) for i in range(n)]
    return rows


@pytest.mark.parametrize(("least", "shortest", "keep_first"), [(10, 1, False), (1, 1, False), (2, 3, False), (90, 1, False), (2, 1, True), (10, 6, True)])
def test_lines(spark, least, shortest, keep_first):
    rows = lined()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = bag(line_dedup.deduplicate(docs, least, shortest, keep_first), "doc_id", "n_lines", "n_dropped", "kept")
    assert got == plain_lines(rows, least, shortest, keep_first)


def test_a_line_that_spans_ranges(spark):
    """With one hot line every range begins and ends with it, and each settles its share."""
    rows = [(i, f"hot\nonly {i}") for i in range(300)] + [(1000 + i, "rare\nhot") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for least in (3, 4, 303, 304):
            got = bag(line_dedup.deduplicate(docs, least), "doc_id", "n_lines", "n_dropped", "kept")
            assert got == plain_lines(rows, least), least
        assert bag(line_dedup.deduplicate(docs, 3, keep_first=True), "doc_id", "n_lines", "n_dropped", "kept") == plain_lines(rows, 3, keep_first=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_open_ends_of_a_range():
    """What a range cannot settle stays few rows, whatever the length of a key's run."""
    row = lambda h, doc: (h, 0, doc, 0, b"\0\0\0\0")
    rows = [row(1, d) for d in range(500)] + [row(2, d) for d in range(3)] + [row(3, d) for d in range(30)] + [row(4, d) for d in range(7)]
    told = list(line_dedup._streamed(iter(rows), 10, False))
    assert sum(kind != line_dedup._GONE for kind, *_ in told) == 1 + 7
    assert sum(kind == line_dedup._GONE for kind, *_ in told) == 499 + 30


def test_lines_awkward(docs, rows):
    plain = [(r[0], r[1]) for r in rows]
    for least in (1, 2, 3):
        got = bag(line_dedup.deduplicate(docs, least), "doc_id", "n_lines", "n_dropped", "kept")
        assert got == plain_lines(plain, least)


def test_rows_that_repeat_keep_their_first_line(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (2, "a\nc\na")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(line_dedup.deduplicate(docs, 1, keep_first=True), "doc_id", "kept") == [(1, "a\nb"), (1, "a\nb"), (2, "c")]


def test_a_long_text_of_lines(spark):
    text = "\n".join(f"n{i % 70_000}" for i in range(200_000))
    docs = spark.createDataFrame([(i, text) for i in range(3)] + [(9, "n5")], "doc_id long, text string")
    got = bag(line_dedup.deduplicate(docs, 4), "doc_id", "n_lines", "n_dropped")
    assert got == [(0, 200_000, 3), (1, 200_000, 3), (2, 200_000, 3), (9, 1, 1)]


def test_no_lines(no_docs):
    assert line_dedup.deduplicate(no_docs).collect() == []


def test_bitmap():
    packed = line_dedup.bitmap([np.array([1, 9], "<u4").tobytes(), np.array([3], "<u4").tobytes()])
    n, kept = line_dedup.kept_lines(b"\n".join(b"%d" % i for i in range(12)), packed)
    assert (n, kept) == (12, [b"0", b"2", b"4", b"5", b"6", b"7", b"8", b"10", b"11"])


# ---- phrases ----------------------------------------------------------------


def plain_phrases(rows, least, top=2000, covered=80):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        found = []
        for p, a in often.items():
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            value, k = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items())
            if not inside:
                found.append((-value, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (value, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -value))
    return by_order(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def phrased(seed, n=120):
    rng = random.Random(seed)
    words = "a b c d e Ff gg ü Ü 漢 the-end".split()
    stock = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(25)]
    joined = lambda: "".join(rng.choice(stock) + rng.choice([" ", "\t", ". ", ",", "\n", "; ", "\x0b"]) for _ in range(rng.randrange(0, 12)))
    return [(rng.choice(["en", "de", None, ""]), joined()) for _ in range(n)]


@pytest.mark.parametrize("table", [1 << 18, 4, 0])
@pytest.mark.parametrize("tokens", [1 << 20, 50])
def test_phrases(spark, table, tokens):
    """Also where not all common words have numbers, and where a piece is cut by the end of a stretch."""
    rows = phrased(tokens)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for least in (2, 12):
        got = bag(collocations.mine(docs, least, tokens=tokens, table=table), *COLUMNS)
        assert got == plain_phrases(rows, least)


def test_first_phrases(spark):
    rows = phrased(5)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert bag(collocations.mine(docs, 3, top=4, covered=50), *COLUMNS) == plain_phrases(rows, 3, 4, 50)


def test_phrases_awkward(docs, rows):
    plain = [(r[2], r[1]) for r in rows]
    assert bag(collocations.mine(docs, 3), *COLUMNS) == plain_phrases(plain, 3)
    assert collocations.mine(docs, 10**6).collect() == []


def test_no_phrases(no_docs):
    assert collocations.mine(no_docs).collect() == []


def test_paths_are_the_edges():
    """Unrolled paths give each window of words as often as it stands there, in fewer rows."""
    rng = random.Random(1)
    passage = [rng.randrange(1, 500) for _ in range(60)]
    words = []
    for _ in range(40):
        words += [rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))] + [0] + passage + [0]
    codes = np.array(words + [0] * 4, np.int64)
    seen, rows = Counter(), 0
    for begin in range(0, len(words), 700):
        stop = min(begin + 700, len(words))
        for start, size, edges, weight in zip(*(x.tolist() for x in collocations.compacted(codes, begin, stop))):
            rows += 1
            path = words[start : start + size]
            for i in range(edges):
                seen[tuple(path[i : i + 4])] += weight
    want = Counter()
    for i in range(len(words)):
        gram = words[i : i + 4]
        gram = gram[: gram.index(0)] if 0 in gram else gram
        if len(gram) > 1:
            want[tuple(gram)] += 1
    assert seen == want
    assert rows < len(want)


def test_sums_over_batches():
    """Sorted edges in batches of one row give the sums of one batch."""
    import pyarrow as pa

    edges = sorted((lang, a, b, c, c and d, w) for lang in ("x", "y") for a in (1, 2) for b in (1, 2) for c in (0, 1, 2) for d in (0, 3) for w in (1, 5))
    columns = ["lang", "c1", "c2", "c3", "c4", "weight"]
    batch = pa.RecordBatch.from_pylist([dict(zip(columns, e)) for e in edges])
    flat = lambda batches: sorted(tuple(r.values()) for b in collocations._open_sums(iter(batches), 6) for r in b.to_pylist())
    single = [batch.slice(i, 1) for i in range(batch.num_rows)]
    assert flat(single) == flat([batch]) != []


def test_words_that_share_a_hash_get_another_seed(spark, monkeypatch):
    monkeypatch.setattr(collocations, "xxh64_intdigest", lambda word, seed: 7 << 8 if seed < 2 else hash_of(word, seed))
    words = spark.createDataFrame([("en", w, 50) for w in ("a", "b", "c", "d")], "lang string, word string, n long")
    codes = collocations.find_codes(words, 30, 2).value
    look = codes.lookup()
    assert codes.seed == 2 and len({look(w) for w in (b"a", b"b", b"c", b"d")}) == 4


def hash_of(word, seed):
    return int.from_bytes(hashlib.sha256(word + bytes([seed])).digest()[:8], "big")


# ---- sources ----------------------------------------------------------------


def plain_audit(rows, least=3, top=200):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UP))
        groups[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        mine = {s: c for (x, s), c in groups.items() if x == lang}
        p = {s: share(c) for s, c in mine.items()}
        q = share(sum(mine.values(), Counter()))
        for s in mine:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in mine if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(found, 1) if part == "pair" or rank <= top]
    return by_order(out)


AUDIT = ["lang", "source", "part", "item", "value", "rank"]


def sourced(seed, n=150):
    rng = random.Random(seed)
    chunks = ["don't", "a-b-a", "A", "b,", "Über", "über", "42", "x1y", "(c)", "ß", "漢字", "...", "rare1", "the", "the", "the.", "THE", "a_b"]
    chunks += [f"w{i}v{rng.choice('abc')}" for i in range(40)]
    text = lambda: rng.choice([" ", "\n", "\t "]).join(rng.choices(chunks, k=rng.randrange(0, 14)))
    return [(rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s3", "s10", None, ""]), text()) for _ in range(n)]


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize(("tokens", "cells"), [(1 << 22, 1 << 21), (20, 16)])
def test_sources(spark, least, tokens, cells):
    rows = sourced(least)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    got = bag(divergence.audit(docs, least, 7, tokens, cells), *AUDIT)
    assert got == plain_audit(rows, least, 7)


def test_sources_awkward(spark, docs, rows):
    got = bag(divergence.audit(docs.withColumnRenamed("runs", "source")), *AUDIT)
    assert got == plain_audit([(r[2], r[10], r[1]) for r in rows])


def test_sources_without_terms(spark, no_docs):
    assert divergence.audit(no_docs.withColumnRenamed("runs", "source")).collect() == []
    few = spark.createDataFrame([("en", "a", "x"), ("en", "b", None), ("de", "a", "y")], "lang string, source string, text string")
    assert bag(divergence.audit(few), *AUDIT) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_counts_beyond_64_bits():
    import pyarrow as pa

    n = [10**12, 5]
    rows = [("en", s, t, c, None) for s, cs in (("a", n), ("b", n[::-1])) for t, c in zip("xy", cs)]
    rows += [("en", s, None, None, sum(n) + 2) for s in "ab"]
    table = pa.Table.from_pylist([dict(zip(("lang", "source", "term", "n", "total"), r)) for r in rows])
    p = [[1 + 10**9 * (c + 1) // (sum(n) + 2) for c in cs] for cs in (n, n[::-1])]
    want = [sum((a - b) ** 2 // b for a, b in zip(p[i], p[1 - i])) for i in (0, 1)]
    assert divergence._block(table).column("value").to_pylist() == want


def test_more_documents_than_settled(docs):
    with pytest.raises(ValueError):
        divergence.audit(docs.withColumnRenamed("runs", "source"), least=4)
