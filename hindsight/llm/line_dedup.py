"""Removal of lines that many documents share: sorted line hashes, streamed into keep bitmaps.

1. Each document is split at line feeds once; each different key of it (the line without white space at both ends, A-Z
   lower-cased) becomes a row: 128 bits of hash, the document, the line numbers that hold it.
2. The rows are range-partitioned by hash, document and digest, and sorted so. A common key simply spans several
   ranges. Each task streams its range: the documents of a key are counted as their first occurrences pass by, of a key
   that is still undecided it holds fewer rows than documents are asked for.
3. Only the first and last key of a range may go on in another one. Of those a handful of rows for each range is left
   undecided, and a join of these few settles them.
4. Line numbers that go become one compressed bitmap for each document that loses lines. Texts take no part until
   ``deduplicate`` cuts the lines out.

With ``keep_first`` the first line of a key, by document and line number, stays.

Defined results: a null or empty text is one empty line; keys shorter than ``shortest`` code points are never dropped; a
row is a document, so repeated rows count one by one; rows that agree in id and text share a bitmap (with ``keep_first``
each of them keeps the first line); null ids are told apart by their text and come first; ties cannot be; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from hindsight.llm.text import whole
from hindsight.session import cut_lineage

#: Documents that make a line common, and the least length of its key.
LEAST = 10
SHORTEST = 1

_SPACE = b" \t\n\x0b\x0c\r"
#: Rows that a task hands over at a time.
_ROWS = 10_000
#: What a streamed row says: it goes; its key may go on in another range (the first row of the key, the others).
_GONE, _HEAD, _REST = 0, 1, 2


def keys_of(text: bytes, shortest: int = SHORTEST) -> dict[bytes, list[int]]:
    """The line numbers of each key of a text."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip(_SPACE).lower()  # of bytes, so A-Z only
        if len(key) >= shortest and (len(key) >= 4 * shortest or len(key.decode()) >= shortest):
            found.setdefault(key, []).append(i)
    return found


def _packed(numbers: list[int]) -> bytes:
    return np.array(numbers, "<u4").tobytes()


def bitmap(numbers: list[bytes]) -> bytes:
    """A compressed keep bitmap that ends with the last line that goes; lines behind it stay."""
    gone = np.frombuffer(b"".join(numbers), "<u4")
    keep = np.ones(int(gone.max()) + 1, bool)
    keep[gone] = False
    return zlib.compress(np.packbits(keep).tobytes() + bytes([-len(keep) % 8]))


def kept_lines(text: bytes, packed: bytes | None) -> tuple[int, list[bytes]]:
    """Number of lines of a text, and those that stay."""
    lines = text.split(b"\n")
    if packed is None:
        return len(lines), lines
    data = zlib.decompress(packed)
    keep = np.unpackbits(np.frombuffer(data[:-1], np.uint8))
    keep = keep[: len(keep) - data[-1]].tolist()
    return len(lines), [line for line, k in zip(lines, keep) if k] + lines[len(keep) :]


def _rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th, text as bytes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))


def hashed_lines(rows: DataFrame, shortest: int) -> DataFrame:
    """h1, h2, doc_id, th, at: a row for each different key of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, digests, at = [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                for key, numbers in keys_of(text, shortest).items():
                    doc.append(i)
                    digests.append(xxh3_128_digest(key))
                    at.append(_packed(numbers))
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            row = pa.array(doc, pa.int64())
            columns = [pa.array(h[:, 0]), pa.array(h[:, 1]), batch["doc_id"].take(row), batch["th"].take(row), pa.array(at, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc_id", "th", "at"])

    return rows.mapInArrow(run, f"h1 bigint, h2 bigint, doc_id {dict(rows.dtypes)['doc_id']}, th bigint, at binary")


def _streamed(rows: Iterator[tuple], least: int, keep_first: bool) -> Iterator[tuple]:
    """(kind, n, *row) of one sorted range; n is the number of documents, with the first row of a key."""

    def settled(head: tuple, n: int) -> Iterator[tuple]:
        at = head[4][4:] if keep_first else head[4]
        if n >= least and at:
            yield _GONE, 0, *head[:4], at

    def open_(head: tuple, n: int, rest: list[tuple]) -> Iterator[tuple]:
        yield _HEAD, n, *head
        for row in rest:
            yield _REST, 0, *row

    held, first = None, True
    for _, group in groupby(rows, lambda row: row[:2]):
        if held:
            yield from open_(*held) if first else settled(*held[:2])
            first = False
        head, n, rest = next(group), 1, []
        for row in group:
            n += 1
            if keep_first and row[2:4] == head[2:4]:
                row = (*row[:4], row[4][4:])
            if n < least:
                rest.append(row)
            else:
                yield from ((_GONE, 0, *r) for r in (*rest, row) if r[4])
                rest = []
        held = head, n, rest
    if held:
        yield from open_(*held)


def _ranges(lines: DataFrame, least: int, keep_first: bool) -> DataFrame:
    """The streamed rows of all ranges."""
    names = ["kind", "n", *lines.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = None, []

        def rows() -> Iterator[tuple]:
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema([("kind", pa.int32()), ("n", pa.int64()), *batch.schema])
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def told() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], names)

        for row in _streamed(rows(), least, keep_first):
            out.append(row)
            if len(out) == _ROWS:
                yield told()
                out = []
        if out:
            yield told()

    order = ["h1", "h2", "doc_id", "th"]
    kinds = ", ".join(f"{c} {t}" for c, t in lines.dtypes)
    return lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"kind int, n bigint, {kinds}")


def bitmaps(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), keep: a compressed bitmap for every document that loses lines."""
    lines = cut_lineage(hashed_lines(_rows_of(docs, id_col, text_col), shortest))
    told = cut_lineage(_ranges(lines, least, keep_first))
    edge = told.where(F.col("kind") != _GONE)
    common = (
        edge.groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.min(F.struct("doc_id", "th")).alias("first"))
        .where(F.col("docs") >= least).drop("docs")
    )
    at = F.col("at")
    if keep_first:
        is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("kind") == _HEAD)
        at = F.when(is_first, F.substring("at", 5, 1 << 30)).otherwise(at)
    late = edge.join(common, ["h1", "h2"]).select("doc_id", "th", at.alias("at"))
    gone = told.where(F.col("kind") == _GONE).select("doc_id", "th", "at").unionByName(late).where(F.length("at") > 0)
    sets = gone.groupBy("doc_id", "th").agg(F.collect_set("at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([bitmap(numbers) for numbers in batch["at"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], packed], ["doc_id", "th", "keep"])

    return sets.mapInArrow(run, f"doc_id {dict(docs.select(F.col(id_col)).dtypes)[id_col]}, th bigint, keep binary")


def deduplicate(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that is left) for every row of ``docs``."""
    rows = _rows_of(docs, id_col, text_col)
    maps = bitmaps(docs, least, shortest, keep_first, id_col, text_col)
    on = rows["doc_id"].eqNullSafe(maps["doc_id"]) & (rows["th"] == maps["th"])
    met = rows.join(maps, on, "left").select(rows["doc_id"], "text", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [kept_lines(t, k) for t, k in zip(batch["text"].to_pylist(), batch["keep"].to_pylist(), strict=True)]
            columns = [
                batch["doc_id"],
                pa.array([n for n, _ in told], pa.int64()),
                pa.array([n - len(kept) for n, kept in told], pa.int64()),
                pa.array([b"\n".join(kept) for _, kept in told], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept"])

    return met.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_lines bigint, n_dropped bigint, kept string")
