"""Phrases that score high for how often their parts meet: counts from a weighted de Bruijn graph of words.

The edges of the graph are the longest phrases (``LONGEST`` words, overlapping nodes of one word less). Each word of a
piece begins one edge; near the end of a piece an edge is cut short, which is the piece-end correction. So

1. words are counted by language. The ``TABLE`` most common of those that are common enough become small numbers; where
   these are all common words, any other word ends a piece, as no phrase with it can be common; where they are not, other
   words become 64-bit hashes, under a seed for which no two words of the input share one;
2. each task sums equal edges over some million words and compacts unary paths: where all that enters a node leaves it
   by one edge, the edges go on in one row. Paths are unrolled behind the Python task, and the edges meet by their first
   two words, sorted;
3. the shorter counts are the flow through the nodes: one pass over the sorted edges sums them by their first two, three
   and four words, cut ones included. Memory is one open sum of each length;
4. common phrases are few. The counts of their parts are joined to them; a phrase that a longer one accounts for goes.

Defined results: null text is empty, null language is ``und``; documents without words count nothing; repeated rows
count each; ties are settled by count and then phrase; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from hindsight.llm.text import whole
from hindsight.session import cut_lineage

LEAST = 30
TOP = 2000
LONGEST = 4
#: A phrase goes if a longer one has this share of its occurrences or more, in hundredths.
COVERED = 80
SCALE = 2_000_000
UNKNOWN = "und"
#: Words with numbers of their own; the list goes to every task.
TABLE = 1 << 18
#: Words that a task sums at a time, below 2**21.
TOKENS = 1 << 20

_PIECE_END = re.compile(rb"[.,;:!?\x0a-\x0d]+")
_END = b"."
_WORDS = [f"c{i + 1}" for i in range(LONGEST)]


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words, with ``.``, which is no word, where a piece ends."""
    return _PIECE_END.sub(b" . ", text.lower()).split()  # of bytes: A-Z only, and only space and tab are left to split at


def word_counts(docs: DataFrame, tokens: int = 4 * TOKENS) -> DataFrame:
    """lang, word, n over (lang, text)."""

    def told(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            found.pop(_END, None)
            words = pa.array(list(found), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), words, pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = defaultdict(Counter), 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                counts[lang].update(words)
                n += len(words)
                if n >= tokens:
                    yield from told(counts)
                    counts, n = defaultdict(Counter), 0
        yield from told(counts)

    return docs.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Codes:
    """Numbers of words: their place in a list of common ones; for others a hash, or 0 where the list is complete."""

    def __init__(self, common: list[str], complete: bool, seed: int = 0):
        self.common, self.complete, self.seed = common, complete, seed

    def lookup(self, digest: Callable[[bytes, int], int] | None = None) -> Callable[[bytes], int]:
        seed, complete, digest = self.seed, self.complete, digest or xxh64_intdigest

        class Table(dict):
            def __missing__(self, word: bytes) -> int:
                return 0 if complete else 1 << 62 | digest(word, seed) >> 2

        table = Table((w.encode(), i + 1) for i, w in enumerate(self.common))
        table[_END] = 0
        return table.__getitem__


def _coded(words: DataFrame, codes) -> DataFrame:
    """``words`` with the number of the column word as ``code``."""
    digest = xxh64_intdigest  # the one of this process, whatever a task would import

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codes.value.lookup(digest)
        for batch in batches:
            numbers = pa.array([code(w.encode()) for w in batch["word"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers], [*batch.schema.names, "code"])

    return words.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*words.dtypes, ("code", "bigint")]))


def find_codes(words: DataFrame, least: int, table: int = TABLE):
    """The broadcast numbers of ``words`` (lang, word, n)."""
    spark = words.sparkSession
    common = words.where(F.col("n") >= least).groupBy("word").agg(F.max("n").alias("n"))
    first = [r["word"] for r in common.orderBy(F.desc("n"), "word").limit(table + 1).collect()]
    complete, seed = len(first) <= table, 0
    while True:
        codes = spark.sparkContext.broadcast(Codes(first[:table], complete, seed))
        if complete:
            return codes
        code = _coded(words.select("word"), codes).groupBy("code")
        if code.agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a <> b").isEmpty():
            return codes
        seed += 1


def compacted(codes: np.ndarray, begin: int, stop: int) -> tuple[np.ndarray, ...]:
    """(first word, number of words, number of edges, weight) of each path of the edges that begin in a stretch of words.

    ``codes`` has zeros between pieces and at least ``LONGEST`` of them at its end.
    """
    window = codes[begin : stop + LONGEST]
    _, local = np.unique(np.append(window, 0), return_inverse=True)  # 0 stays 0
    n = stop - begin
    w = [local[i : i + n].astype(np.int64) for i in range(LONGEST)]
    for i in range(1, LONGEST):
        w[i] = np.where(w[i - 1] == 0, 0, w[i])
    at = np.flatnonzero(w[1])  # one word alone is no phrase
    if not len(at):
        return (at,) * 4
    w = [x[at] for x in w]
    _, pair = np.unique(w[0] << 21 | w[1], return_inverse=True)
    edge, place, weight = np.unique(pair.astype(np.int64) << 42 | w[2] << 21 | w[3], return_index=True, return_counts=True)
    node = edge >> 21
    new = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    flow = np.repeat(np.add.reduceat(weight, new), np.diff(np.append(new, len(node))))
    order = np.argsort(place)
    place, weight, flow = place[order], weight[order], flow[order]
    length = (w[0][place] > 0).astype(np.int64) + (w[1][place] > 0) + (w[2][place] > 0) + (w[3][place] > 0)
    place = at[place]
    # an edge goes on in the next if its end node has one way in and one way out: weight, flow and weight are the same
    on = (place[1:] == place[:-1] + 1) & (weight[1:] == weight[:-1]) & (flow[1:] == weight[1:])
    head = np.flatnonzero(np.concatenate([[True], ~on]))
    tail = np.append(head[1:], len(place)) - 1
    return begin + place[head], place[tail] - place[head] + length[tail], tail - head + 1, weight[head]


def paths(docs: DataFrame, codes, tokens: int = TOKENS) -> DataFrame:
    """lang, codes, edges, weight over (lang, text): unary paths of the edges of some words at a time."""

    def told(lang: str, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        zeros = np.zeros(LONGEST, np.int64)
        words = np.concatenate([*parts, zeros])
        for begin in range(0, len(words) - LONGEST, tokens):
            start, size, edges, weight = compacted(words, begin, min(begin + tokens, len(words) - LONGEST))
            offset = np.concatenate([[0], np.cumsum(size)])
            value = words[np.repeat(start - offset[:-1], size) + np.arange(offset[-1])]
            lists = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(value))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(start), pa.string()), lists, pa.array(edges, pa.int32()), pa.array(weight, pa.int64())], ["lang", "codes", "edges", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codes.value.lookup()
        parts, n = defaultdict(list), 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                words.append(_END)
                parts[lang].append(np.fromiter(map(code, words), np.int64, len(words)))
                n += len(words)
                if n >= 2 * tokens:
                    for one in parts.items():
                        yield from told(*one)
                    parts, n = defaultdict(list), 0
        for one in parts.items():
            yield from told(*one)

    return docs.mapInArrow(run, "lang string, codes array<bigint>, edges int, weight bigint")


def edges_of(found: DataFrame) -> DataFrame:
    """lang, c1 .. c4, weight: the edges of ``found`` paths, 0 where a piece ends before."""
    codes = F.col("codes")

    def edge(i: Column) -> Column:
        return F.struct(*[F.coalesce(F.get(codes, i + k), F.lit(0).cast("bigint")).alias(c) for k, c in enumerate(_WORDS)])

    return found.select("lang", F.inline(F.transform(F.sequence(F.lit(0), F.col("edges") - 1), edge)), "weight")


def _open_sums(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sums by the first 2, 3, ... words over rows sorted by language and words; those of ``least`` or more."""
    names = ["lang", *_WORDS, "f"]
    kept: dict[int, tuple] = {}

    def told(lang: pa.Array, words: list[np.ndarray], f: np.ndarray, depth: int) -> pa.RecordBatch:
        zeros = np.zeros(len(f), np.int64)
        return pa.RecordBatch.from_arrays([lang, *(pa.array(words[i] if i < depth else zeros) for i in range(LONGEST)), pa.array(f)], names)

    def closed(depth: int) -> Iterator[pa.RecordBatch]:
        (lang, *words), f = kept[depth]
        if f >= least and words[-1]:
            yield told(pa.array([lang], pa.string()), [np.array([w], np.int64) for w in words], np.array([f], np.int64), depth)

    for batch in batches:
        if not batch.num_rows:
            continue
        lang = batch["lang"].dictionary_encode()
        words = [batch[c].to_numpy() for c in _WORDS]
        weight = batch["weight"].to_numpy()
        which = lang.indices.to_numpy()
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (words[0][1:] != words[0][:-1])])
        for depth in range(2, LONGEST + 1):
            w = words[depth - 1]
            new[1:] |= w[1:] != w[:-1]
            start = np.flatnonzero(new)
            f = np.add.reduceat(weight, start)

            def key(i: int) -> tuple:
                return lang[i].as_py(), *(int(x[i]) for x in words[:depth])

            if depth in kept:
                if kept[depth][0] == key(0):
                    f[0] += kept[depth][1]
                else:
                    yield from closed(depth)
            kept[depth] = key(start[-1]), int(f[-1])
            often = np.flatnonzero((f[:-1] >= least) & (w[start[:-1]] != 0))
            if len(often):
                yield told(batch["lang"].take(pa.array(start[often])), [x[start[often]] for x in words], f[often], depth)
    for depth in kept:
        yield from closed(depth)


def phrase_counts(edges: DataFrame, least: int) -> DataFrame:
    """lang, c1 .. c4, f of all phrases of 2 to 4 words that ``edges`` hold ``least`` times or more; 0 behind the last word."""
    first = F.xxhash64("lang", *_WORDS[:2])
    dealt = edges.repartition(first).sortWithinPartitions(first, "lang", *_WORDS)
    columns = ", ".join(f"{c} bigint" for c in [*_WORDS, "f"])
    return dealt.mapInArrow(lambda batches: _open_sums(batches, least), f"lang string, {columns}")


def _part(begin: int, stop: int) -> Column:
    """The words from ``begin`` to before ``stop``, in front."""
    chosen = [F.col(c) for c in _WORDS[begin:stop]]
    return F.struct(*[(chosen[i] if i < len(chosen) else F.lit(0).cast("bigint")).alias(f"p{i + 1}") for i in range(LONGEST - 1)])


_PART = [f"p{i + 1}" for i in range(LONGEST - 1)]


def score(phrases: DataFrame, singles: DataFrame, scale: int = SCALE) -> DataFrame:
    """``phrases`` with l, r and score of their lowest cut; ``singles`` (lang, code, n) has the counts of single words."""
    parts = phrases.where("c4 = 0").select("lang", *[F.col(c).alias(p) for c, p in zip(_WORDS, _PART)], F.col("f").alias("of_part"))
    zero = F.lit(0).cast("bigint")
    parts = parts.unionByName(singles.select("lang", F.col("code").alias("p1"), zero.alias("p2"), zero.alias("p3"), F.col("n").alias("of_part")))
    cuts = []
    for k in range(1, LONGEST):
        # a cut of a shorter phrase leaves zeros behind, which the part has too
        sides = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), p.alias("part")) for side, p in (("l", _part(0, k)), ("r", _part(k, LONGEST)))]
        cuts += [F.when(F.col(_WORDS[k]) != 0, s) for s in sides]
    asked = phrases.select("lang", *_WORDS, "f", F.explode(F.filter(F.array(*cuts), lambda x: x.isNotNull())).alias("cut"))
    asked = asked.select("lang", *_WORDS, "f", "cut.k", "cut.side", "cut.part.*")
    told = asked.join(parts, ["lang", *_PART]).groupBy("lang", *_WORDS, "f", "k").agg(
        *[F.max(F.when(F.col("side") == side, F.col("of_part"))).alias(side) for side in ("l", "r")]
    )
    value = F.expr(f"{scale}bd * cast(f as decimal(20, 0)) div (cast(l as decimal(20, 0)) + r)").cast("bigint")
    least = F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("cut")
    return told.groupBy("lang", *_WORDS, "f").agg(least).select("lang", *_WORDS, "f", "cut.l", "cut.r", "cut.score")


def uncovered(phrases: DataFrame, counts: DataFrame, covered: int = COVERED) -> DataFrame:
    """``phrases`` without those in a longer one of ``counts`` that has ``covered`` hundredths of their occurrences."""
    zero = F.lit(0).cast("bigint")

    def run(begin: int, stop: int) -> Column:
        inside = F.struct(*[(F.col(_WORDS[begin + i]) if begin + i < stop else zero).alias(c) for i, c in enumerate(_WORDS)])
        return F.when(F.col(_WORDS[stop - 1]) != 0, inside)

    # phrases of the full length are in no longer one, and a phrase is in itself as long as nothing follows
    inner = [run(b, b + n) for n in range(2, LONGEST) for b in range(LONGEST - n + 1)]
    whole_ = F.struct(*_WORDS)
    held = F.explode(F.filter(F.array(*inner), lambda x: x.isNotNull() & (x != whole_)))
    most = counts.where("c3 <> 0").select("lang", held.alias("in"), "f").groupBy("lang", "in").agg(F.max("f").alias("longer")).select("lang", "in.*", "longer")
    left = phrases.join(most, ["lang", *_WORDS], "left")
    hundred, share = (F.lit(x).cast("decimal(3, 0)") for x in (100, covered))
    keep = F.col("longer").isNull() | (hundred * F.col("longer") < share * F.col("f"))
    return left.where(keep).drop("longer")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, tokens: int = TOKENS, table: int = TABLE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language over (lang, text)."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), whole("text").cast("binary").alias("text"))
    words = cut_lineage(word_counts(docs, 4 * tokens))
    codes = find_codes(words, least, table)
    singles = cut_lineage(_coded(words.where(F.col("n") >= least), codes))
    counts = cut_lineage(phrase_counts(edges_of(paths(docs, codes, tokens)), least))
    left = cut_lineage(uncovered(score(counts, singles), counts, covered))

    place = left.select("lang", *_WORDS, F.posexplode(F.array(*_WORDS)).alias("i", "code")).where("code <> 0")
    named = place.join(singles.select("lang", "code", "word"), ["lang", "code"]).groupBy("lang", *_WORDS).agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("words"))
    phrase = F.array_join(F.transform("words", lambda x: x["word"]), " ")
    told = left.join(named, ["lang", *_WORDS]).select("lang", phrase.alias("phrase"), F.col("f").alias("a"), "l", "r", "score")
    ranked = told.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
