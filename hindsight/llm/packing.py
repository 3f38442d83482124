"""Packing of documents into fixed-length sequences as a cutting-stock problem.

Documents are tokenised where they lie and cut into blocks of a whole sequence and a rest. Rests are counted by
length class, a histogram whose size depends on the sequence length alone. Column generation solves the linear
program over it: a pattern says how many pieces of each class share a sequence, an unbounded-knapsack dynamic
program prices new patterns, and patterns are rounded down, what is left being filled largest first. Pieces are
ranked within their class and ranks are looked up in the plan, so the work on pieces is joins with small tables.

Defined results: a null text is an empty one and gives the end id alone; every id lies in exactly one piece;
rows that repeat are packed as documents of their own; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindsight.llm.text import whole
from hindsight.session import cut_lineage

LENGTH = 4096
#: The id that ends each document.
END = 2
#: Tokens by which length classes differ; there are LENGTH / GRAIN classes.
GRAIN = 16
#: Parts of a class that are ranked apart from each other.
PARTS = 256
#: Entries of a worker's word table; it starts anew when full.
WORDS = 300_000

_ENCODERS: dict = {}

# text that the tokenizer's normaliser changes by lower-casing and white space alone
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*").fullmatch
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+").findall


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Ids of whole texts, as little-endian unsigned 32-bit integers; words are looked up, new ones encoded by the model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        letters = word.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _PLAIN(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, _WORDS(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (, ids): blocks of a whole sequence, then the rest."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids binary" if with_ids else "")
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            owner, out, ids = [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                data = enc.encode(text) + last
                total = len(data) // 4
                for start in range(0, total, length):
                    piece = data[4 * start : 4 * (start + length)]
                    owner.append(i)
                    out.append((start, len(piece) // 4, zlib.crc32(piece), total))
                    if with_ids:
                        ids.append(piece)
            cols = [batch["doc_id"].take(pa.array(owner, pa.int64())), *[pa.array([r[k] for r in out], pa.int64()) for k in range(4)]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, schema)


def _price(worth: np.ndarray, sizes: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """The pattern of most worth that fits the width."""
    best, taken = np.zeros(width + 1), np.full(width + 1, -1)
    for room in range(1, width + 1):
        best[room] = best[room - 1]
        fit = np.searchsorted(sizes, room, side="right")
        if fit:
            value = best[room - sizes[:fit]] + worth[:fit]
            k = int(value.argmax())
            if value[k] > best[room] + 1e-12:
                best[room], taken[room] = value[k], k
    pattern, room = np.zeros(len(sizes)), width
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= sizes[taken[room]]
    return float(best[width]), pattern


def cutting_plan(demand: dict[int, int], width: int, gap: float = 5e-4) -> list[tuple[dict[int, int], int]]:
    """[(pieces of each size in a sequence, how many such sequences)], which use up ``demand`` (size: pieces) exactly.

    The linear program is left once its value is within ``gap`` of the bound that the prices prove; any plan is
    complete, the gap only concerns how full sequences are.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n), int)
    if not len(sizes):
        return []
    need = np.array([demand[s] for s in sizes], float)
    columns = [np.eye(len(sizes))[i] * (width // s) for i, s in enumerate(sizes)]
    inverse = np.diag(1 / np.array([width // s for s in sizes], float))
    amount = inverse @ need
    for _ in range(40 * len(sizes)):
        worth = inverse.sum(axis=0)
        value, pattern = _price(worth, sizes, width)
        if value <= 1 + 1e-9 or amount.sum() * (1 - 1 / value) < gap * amount.sum():
            break
        change = inverse @ pattern
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * change, 0)
        amount[out] = step
        inverse[out] /= change[out]
        others = np.arange(len(sizes)) != out
        inverse[others] -= np.outer(change[others], inverse[out])
        columns[out] = pattern
    left, plan = need.astype(int), []
    for column, x in sorted(zip(columns, amount, strict=True), key=lambda p: -p[1]):
        column = column.astype(int)
        times = min([int(x + 1e-6), *(left[column > 0] // column[column > 0])])
        if times > 0:
            left -= times * column
            plan.append(({int(s): int(n) for s, n in zip(sizes, column, strict=True) if n}, int(times)))
    while left.any():
        room, column = width, np.zeros(len(sizes), int)
        for i in range(len(sizes) - 1, -1, -1):
            column[i] = min(left[i], room // sizes[i])
            room -= column[i] * sizes[i]
        times = int((left[column > 0] // column[column > 0]).min())
        left -= times * column
        plan.append(({int(s): int(n) for s, n in zip(sizes, column, strict=True) if n}, times))
    return plan


def place(found: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """``found`` (doc_id, start, length, ...) with sequence_id and offset.

    ``found`` is read several times and should be a written table. The plan and the ranks' bases are tables whose
    size depends on ``length / grain`` and ``PARTS`` alone, so they are broadcast.
    """
    spark = found.sparkSession
    names = found.columns
    tagged = found.withColumn("__class", F.ceil(F.col("length") / grain).cast("int")).withColumn(
        "__part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(PARTS)).cast("int")
    )
    counts = cut_lineage(tagged.groupBy("__class", "__part").agg(F.count(F.lit(1)).alias("n")))
    demand = {r["__class"]: r["n"] for r in counts.groupBy("__class").agg(F.sum("n").alias("n")).collect()}
    rows, first, used = [], 0, dict.fromkeys(demand, 0)
    for pattern, times in cutting_plan(demand, length // grain):
        for size, each in pattern.items():
            rows.append((size, used[size], used[size] + times * each, each, first))
            used[size] += times * each
        first += times
    plan = spark.createDataFrame(rows, "__c int, __lo bigint, __hi bigint, __each bigint, __first bigint")
    ahead = Window.partitionBy("__class").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__class", "__part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__class", "__part").orderBy("doc_id", "start", "length", "ids_crc32")
    ranked = tagged.withColumn("__k", F.row_number().over(within)).join(F.broadcast(bases), ["__class", "__part"])
    ranked = ranked.withColumn("__rank", F.col("__base") + F.col("__k") - 1)
    on = (F.col("__class") == F.col("__c")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi"))
    put = ranked.join(F.broadcast(plan), on)
    put = put.withColumn("sequence_id", F.col("__first") + F.floor((F.col("__rank") - F.col("__lo")) / F.col("__each")).cast("long"))
    before = Window.partitionBy("sequence_id").orderBy(F.col("__class").desc(), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    return put.select(*names, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset: one row for each piece."""
    return place(cut_lineage(pieces(docs, path, length, end, id_col, text_col, with_ids)), length)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (bytes of all its pieces in order), from ``pack(..., with_ids=True)``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.array_join(F.transform(parts, lambda x: F.hex(x["ids"])), "").alias("hex")).select("sequence_id", F.unhex("hex").alias("ids"))
