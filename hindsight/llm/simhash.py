"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints have 64 bits; two link when they differ in at most ``distance`` of them. Bits that go together are put
into the same of ``distance + 1`` parts. A part with threshold t (-1: not looked at) finds the pairs that differ in at
most t of its bits; the thresholds plus one add up to ``distance`` plus one, so every linked pair is found by some part.
Which part gets which threshold is decided by dynamic programming on candidate counts estimated from all fingerprints.

A part with threshold t is a set of masks, one for each choice of t bits left out; fingerprints that agree under a mask
share a bucket. Buckets above ``BUCKET`` are split by pigeonhole over the bits not yet used, again and again; once ten
bits are left a bucket cannot be larger, as fingerprints are distinct. Within a bucket all distances are verified and
one link to the smallest fingerprint of each connected set leaves it, not all pairs. Components follow by passing
smallest labels along links, every round a written table.

Defined results: a null or wordless text has fingerprint zero, linked like any other; with fewer words than a shingle
the whole sequence is one; equal fingerprints are one node, so copies cost nothing more; a component is named by its
smallest non-null id; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.llm.text import whole
from hindsight.session import cut_lineage

BITS = 64
WORDS = 3
SEED = 42
DISTANCE = 2
#: Fingerprints that are compared with each other at most; log2 of it is the number of bits that need no split.
BUCKET = 1024
#: Shingles whose bits are summed at a time.
BLOCK = 1 << 15


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Majority of the bits of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()
    if not found:
        return 0
    data = b" ".join(found)
    start, stops, at = [], [], 0
    for w in found:
        start.append(at)
        at += len(w) + 1
        stops.append(at - 1)
    last = stops[words - 1 :] or stops[-1:]
    # slices pair the first word's start with the last word's end
    hashes = [xxh64_intdigest(data[a:b], seed) for a, b in zip(start, last, strict=False)]
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), BLOCK):
        part = np.array(hashes[lo : lo + BLOCK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (its 64 bits as a signed long)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words, seed) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp)], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """(fingerprints, how often bits i and j are both set), over all of ``nodes`` (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(fp)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *i.tolist()], pa.int32()), pa.array([-1, *j.tolist()], pa.int32()), pa.array([n, *total[i, j].tolist()], pa.int64())], ["i", "j", "n"])

    both, n = np.zeros((BITS, BITS)), 0
    for r in nodes.select("fp").mapInArrow(run, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int, bits: int = BITS) -> list[list[int]]:
    """The lowest ``bits`` bits in ``parts`` groups of even size, those that go together in the same."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tied, 0)
    free, out = list(range(bits)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        inside = [max(free, key=lambda b: (tied[b, free].max(), -b))]
        while len(inside) < size:
            inside.append(max((b for b in free if b not in inside), key=lambda b: (tied[b, inside].sum(), -b)))
        out.append(sorted(inside))
        free = [b for b in free if b not in inside]
    return out


def allocate(cost: list[list[float]], distance: int) -> list[int]:
    """Thresholds (-1 to ``distance``) of least total ``cost[part][threshold + 1]`` whose plus-ones add up to ``distance + 1``."""
    best = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t in range(-1, distance - used + 1):
                new = (total + row[t + 1], [*chosen, t])
                if used + t + 1 not in step or new < step[used + t + 1]:
                    step[used + t + 1] = new
        best = step
    return best[distance + 1][1]


def plan_masks(nodes: DataFrame, distance: int, bits: int = BITS) -> list[int]:
    """The masks under which linked fingerprints share a bucket, from statistics of all ``nodes`` (fp)."""
    n, both = bit_statistics(nodes)
    parts = group_bits(n, both, distance + 1, bits)
    whole_part = [sum(1 << b for b in part) for part in parts]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(_signed(m)).alias("v")) for i, m in enumerate(whole_part)]))
    counts = nodes.select(keys.alias("k")).groupBy("k.i", "k.v").agg(F.count(F.lit(1)).alias("c"))
    pairs = {r["i"]: float(r["p"]) for r in counts.groupBy("i").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("p")).collect()}
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    cost = []
    for i, part in enumerate(parts):
        row = [0.0]
        for t in range(distance + 1):
            # leaving bits out lets in the pairs that differ there; every mask also is a probe of every fingerprint
            row.append(sum(n + pairs.get(i, 0.0) / float(np.prod(agree[list(out)])) for out in combinations(part, t)))
        cost.append(row)
    masks = []
    for part, t in zip(parts, allocate(cost, distance), strict=True):
        masks += [sum(1 << b for b in part if b not in out) for out in combinations(part, t)] if t >= 0 else []
    return masks


def finer(mask: int, distance: int, bits: int = BITS) -> list[int]:
    """Masks that add to ``mask`` one of ``distance + 1`` parts of the other bits; none once few bits are left."""
    rest = [b for b in range(bits) if not mask >> b & 1]
    if 1 << len(rest) <= BUCKET:
        return []
    return [mask | sum(1 << b for b in rest[k :: distance + 1]) for k in range(distance + 1)]


def _within(bucket: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest of its connected set) for those that are not the smallest."""
    near = np.bitwise_count(bucket[:, None] ^ bucket[None, :]) <= distance
    label = np.arange(len(bucket))
    while True:
        new = np.where(near, label[None, :], len(bucket)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(bucket)))
    return bucket[far], bucket[label[far]]


def buckets(nodes: DataFrame, distance: int = DISTANCE, bits: int = BITS, keys: tuple[str, ...] = ()) -> list[DataFrame]:
    """Tables of (members: array of (fp, rep)): each pair within ``distance`` is together in one of the arrays at least.

    ``nodes`` (fp, rep and ``keys``) are distinct in keys and fp, and written; pairs agree in their keys. No array has
    more than ``BUCKET`` members.
    """
    by = [*keys, "mask", "val"]

    def items(source: DataFrame, masks: list[int]) -> DataFrame:
        under = [F.struct(F.lit(_signed(m)).cast("long").alias("mask"), F.col("fp").bitwiseAND(_signed(m)).alias("val")) for m in masks]
        return source.select(*keys, F.explode(F.array(*under)).alias("k"), "fp", "rep").select(*keys, "k.*", "fp", "rep")

    masks = plan_masks(nodes, distance, bits)
    now, found = items(nodes, masks), []
    while masks:
        counted = now.groupBy(*by).agg(F.count(F.lit(1)).alias("c"))
        large = cut_lineage(counted.where(F.col("c") > BUCKET).select(*by))
        small = now.join(large, by, "left_anti").groupBy(*by).agg(F.collect_list(F.struct("fp", "rep")).alias("members"))
        found.append(small.where(F.size("members") > 1).select("members"))
        hot = {r["mask"] for r in large.select("mask").distinct().collect()}
        tree = {_signed(m): children for m in masks if _signed(m) in hot and (children := finer(m, distance, bits))}
        masks = sorted({m for children in tree.values() for m in children})
        if masks:
            held = cut_lineage(now.join(large, by, "left_semi"))
            deeper = [items(held.where(F.col("mask") == mask).select(*keys, "fp", "rep"), children) for mask, children in tree.items()]
            now = deeper[0]
            for more in deeper[1:]:
                now = now.unionByName(more)
            now = now.distinct()
    return found


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: links that connect what pairs within ``distance`` connect; ``nodes`` (fp, rep) are distinct and written."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for bucket in batch["members"]:
                a, b = _within(np.sort(bucket.values.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)), distance)
                left.append(a)
                right.append(b)
            if left:
                sides = [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)]
                yield pa.RecordBatch.from_arrays(sides, ["a", "b"])

    found = [cut_lineage(members.mapInArrow(verify, "a bigint, b bigint")) for members in buckets(nodes, distance)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return cut_lineage(out.distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): root is the smallest node it is connected to."""
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        heard = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("heard"))
        step = label.join(heard, F.col("node") == F.col("a"), "left").select("node", F.least("root", "heard").alias("new"), "root")
        step = cut_lineage(step)
        up = step.select(F.col("node").alias("at"), F.col("new").alias("its"))
        jumped = step.join(up, F.col("new") == F.col("at")).select("node", F.least("new", "its").alias("root"), (F.col("root") != F.least("new", "its")).alias("moved"))
        jumped = cut_lineage(jumped)
        label = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    found = cut_lineage(fingerprints(docs, id_col, text_col, words, seed))
    nodes = cut_lineage(found.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(nodes, distance))
    placed = cut_lineage(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    named = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    each = cut_lineage(placed.join(cut_lineage(named), "root").select("fp", "component_id"))
    return found.join(each, "fp").select("doc_id", "fp", "component_id")
