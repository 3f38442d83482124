"""How sources differ in the words they use: counts by factoring texts into white-space chunks.

Texts repeat a modest stock of chunks (what stands between white space), so terms are looked for in chunks, not texts:

1. Each task counts the chunks of its documents, document by document, and hands over one row for each language, source
   and chunk: occurrences, documents, the least and the largest document.
2. Rows meet by chunk. Each different chunk of the whole corpus becomes one row with its counts by language and source
   and is split into terms once, which brings the terms back to all counts of the chunk.
3. Occurrences are summed by language, source and term. A term's documents are counted exactly as far as ``LEAST`` asks:
   a chunk in that many documents settles its terms; of a rarer chunk the least and the largest document are all it has,
   so the documents of its terms are distinct counts over those.
4. A source is compared with every other one of its language in blocks of terms: a task holds the counts of a block as a
   matrix and returns one partial sum for each pair of sources, in whole numbers.

Defined results: null text, language or source is read as empty; a row is a document, so repeated rows count one by one;
texts without terms still bring their source into the result; a language that keeps no term has pairs of value 0; ties
in value are broken by item; an empty table gives an empty result; other columns are not looked at. Sums stay below 64
bits as long as a language keeps fewer than 2 * 10**9 terms.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindsight.llm.text import whole
from hindsight.session import cut_lineage

#: Documents that a term must be in; 3 is the most that the least and largest document can settle.
LEAST = 3
#: Terms reported of each source.
TERMS = 200
#: Probabilities are whole parts of this.
UNIT = 1_000_000_000

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Chunks counted before a task hands rows over, and cells of a block's matrix.
TOKENS = 1 << 22
CELLS = 1 << 21

_COUNTS = "lang string, source string, chunk string, n bigint, docs bigint, lo bigint, hi bigint"


class _Counter:
    """Chunks of the documents so far, as numbers."""

    def __init__(self):
        self.ids = defaultdict(count().__next__)
        self.groups = defaultdict(count().__next__)
        self.chunks, self.group, self.size, self.row = [], [], [], []

    def add(self, lang: str, source: str, text: bytes, row: int) -> int:
        words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
        self.chunks.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.group.append(self.groups[lang, source])
        self.size.append(len(words))
        self.row.append(row)
        return len(words)

    def told(self) -> pa.RecordBatch:
        chunk = np.concatenate(self.chunks)
        doc = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        key = np.repeat(np.array(self.group, np.int64) * len(self.ids), self.size) + chunk
        order = np.argsort(key, kind="stable")  # documents stay in order
        key, doc = key[order], doc[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(key))
        docs = np.add.reduceat((new | np.concatenate([[True], doc[1:] != doc[:-1]])).astype(np.int64), start)
        group, chunk = np.divmod(key[start], len(self.ids))
        row = np.array(self.row, np.int64)
        names, words = list(self.groups), pa.array(list(self.ids), pa.binary()).cast(pa.string())
        columns = [
            *(pa.array([n[i] for n in names], pa.string()).take(pa.array(group)) for i in (0, 1)),
            words.take(pa.array(chunk)), pa.array(stop - start), pa.array(docs), pa.array(row[doc[start]]), pa.array(row[doc[stop - 1]]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "chunk", "n", "docs", "lo", "hi"])


def chunk_counts(docs: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """lang, source, chunk, n, docs, lo, hi over (lang, source, text); summed within ``tokens`` chunks of a task only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = count(TaskContext.get().partitionId() << 40)
        counter, n = _Counter(), 0
        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].to_pylist(), strict=True):
                n += counter.add(lang, source, text, next(rows))
                if n >= tokens:
                    yield counter.told()
                    counter, n = _Counter(), 0
        if n:
            yield counter.told()

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, _COUNTS)


def term_counts(docs: DataFrame, least: int = LEAST, tokens: int = TOKENS) -> DataFrame:
    """lang, source, term, n of the terms in ``least`` documents of the language or more, over (lang, source, text)."""
    if not 1 <= least <= 3:
        raise ValueError("documents can be settled up to 3")
    rows = chunk_counts(docs, tokens).repartition("chunk")
    sums = [F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    # all of a chunk is in one task by now; its lists are as long as there are sources
    by_source = rows.groupBy("chunk", "lang", "source").agg(F.sum("n").alias("n"), *sums)
    by_lang = by_source.groupBy("chunk", "lang").agg(*sums, F.collect_list(F.struct("source", "n")).alias("by"))
    by_chunk = by_lang.groupBy("chunk").agg(F.collect_list(F.struct("lang", "docs", "lo", "hi", "by")).alias("langs"))
    found = cut_lineage(by_chunk.select(F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0)).alias("terms"), "langs"))

    joined = found.select(F.explode("terms").alias("term"), "langs").select("term", F.inline("langs")).select("lang", "term", F.inline("by"))
    counts = joined.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))

    settled = F.col("docs") >= least
    seen = found.select(F.explode(F.array_distinct("terms")).alias("term"), "langs").select("term", F.inline("langs")).select(
        "lang", "term", settled.alias("settled"),
        F.when(settled, F.array(F.lit(None).cast("bigint"))).otherwise(F.array_distinct(F.array("lo", "hi"))).alias("in"),
    )
    each = seen.select("lang", "term", "settled", F.explode("in").alias("row")).groupBy("lang", "term", "row").agg(F.max("settled").alias("settled"))
    kept = each.groupBy("lang", "term").agg(F.max("settled").alias("settled"), F.count("row").alias("docs")).where(F.col("settled") | (F.col("docs") >= least))
    return counts.join(kept.select("lang", "term"), ["lang", "term"])


def _share(n: str, total: str) -> Column:
    """1 + floor(UNIT * (n + 1) / total), in whole numbers of any size."""
    return (F.expr(f"cast({n} + 1 as decimal(20, 0)) * {UNIT}bd div {total}") + 1).cast("bigint")


def _block(table: pa.Table) -> pa.Table:
    """Partial sums of each pair of sources over the terms of one block."""
    t = table.to_pydict()
    total = {s: n for s, n in zip(t["source"], t["total"], strict=True) if n is not None}
    sources = sorted(total)
    place, terms = {s: i for i, s in enumerate(sources)}, defaultdict(count().__next__)
    cells = [(place[s], terms[x], n) for s, x, n in zip(t["source"], t["term"], t["n"], strict=True) if x is not None]
    big = max((n for *_, n in cells), default=0) >= (1 << 63) // UNIT - 1
    p = np.zeros((len(sources), len(terms)), object if big else np.int64)
    for s, x, n in cells:
        p[s, x] = n
    p = 1 + UNIT * (p + 1) // np.array([total[s] for s in sources], p.dtype)[:, None]
    value = [((p[s] - p) ** 2 // p).sum(axis=1) for s in range(len(sources))]
    pairs = [(s, o) for s in range(len(sources)) for o in range(len(sources)) if s != o]
    return pa.table({
        "lang": pa.array([t["lang"][0]] * len(pairs), pa.string()),
        "source": pa.array([sources[s] for s, _ in pairs], pa.string()),
        "item": pa.array([sources[o] for _, o in pairs], pa.string()),
        "value": pa.array([int(value[s][o]) for s, o in pairs], pa.int64()),
    })


def audit(docs: DataFrame, least: int = LEAST, top: int = TERMS, tokens: int = TOKENS, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank over (lang, source, text)."""
    docs = docs.select(*[whole(c).alias(c) for c in ("lang", "source", "text")])
    counts = cut_lineage(term_counts(docs, least, tokens))
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    size = by_lang.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("all"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(size, "lang", "left")
    terms = F.coalesce("terms", F.lit(0))
    of_lang = W.partitionBy("lang")
    groups = cut_lineage(groups.select(
        "lang", "source", (F.coalesce("own", F.lit(0)) + terms).alias("total"), (F.coalesce("all", F.lit(0)) + terms).alias("lang_total"),
        F.greatest(F.lit(1), F.ceil(terms * F.count("*").over(of_lang) / cells)).cast("int").alias("blocks"),
    ))

    blocks = groups.select("lang", "blocks").distinct()
    sparse = counts.join(blocks, "lang").select("lang", F.expr("pmod(xxhash64(term), blocks)").cast("int").alias("block"), "source", "term", "n")
    marks = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total")
    pairs = (
        sparse.unionByName(marks, allowMissingColumns=True).groupBy("lang", "block")
        .applyInArrow(_block, "lang string, source string, item string, value bigint")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )

    here = groups.select("lang", "source", "total", "lang_total")
    share = counts.join(by_lang.withColumnRenamed("n", "n_lang"), ["lang", "term"]).join(here, ["lang", "source"])
    share = share.select("lang", "source", F.col("term").alias("item"), _share("n", "total").alias("p"), _share("n_lang", "lang_total").alias("q"))
    over = share.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    both = [
        pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank")),
        over.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= top),
    ]
    return both[0].unionByName(both[1])
