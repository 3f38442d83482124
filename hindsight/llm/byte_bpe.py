"""Byte-level BPE over whole texts, long ones in overlapping chunks.

A text longer than a chunk is cut into overlapping chunks, which become rows of their own and are pre-tokenised
wherever they land. The pattern looks ahead but never back, so from a position at which both neighbours begin a
pre-token they agree for good: the first such position in their overlap is where they are stitched. What lies
between two stitches is encoded as a piece, and the pieces' ids are joined in order. A text in which some overlap
has no common boundary (one run of letters longer than it, say) is encoded in one piece. Decoding concatenates the
ids' bytes.

Only long texts are shuffled. Defined results: a null text is an empty one and has no ids; rows that repeat are
encoded alike, each a row of the result; ids are those of the library for ordinary text, special tokens' names
included; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindsight.llm.text import whole
from hindsight.session import cut_lineage

CHUNK = 32_768
OVERLAP = 2_048
#: Characters before a chunk's end whose boundaries the missing text could still change.
MARGIN = 8
#: White space in runs from this length on is cut out by hand: the library's matcher runs out of stack on it.
LONG_SPACE = 2_000

_ENCODERS: dict = {}


def encoder(path: str, pattern: str):
    """The library's encoder for a rank file, kept per worker."""
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


# what the pattern's \s matches
_SPACES = "\t-\r \x85\xa0  -     　"
_RUN = re.compile(f"[{_SPACES}]{{{LONG_SPACE},}}")


def encode_text(enc, text: str) -> list[int]:
    """The library's ids. A long run of white space before other text is one pre-token but for its last character."""
    if len(text) < LONG_SPACE:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += enc.encode_ordinary(text[at : run.start()])
        ids += enc._encode_single_piece(text[run.start() : end])
        at = end
    return ids + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def boundaries(text: str, pattern: str) -> list[int]:
    """Where pre-tokens begin."""
    import regex

    return [m.start() for m in regex.compile(pattern).finditer(text)]


def _long(docs: DataFrame, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """Long texts, once for each id: doc_id, fp, text, n."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).where(F.length("text") > chunk)
    return cut_lineage(rows.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("fp", F.sha2("text", 256)))


def _chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """doc_id, fp, k, start, chunk: overlapping chunks of each text, dealt out over all tasks."""
    id_type = dict(long.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, fp, text in zip(batch["doc_id"], batch["fp"], batch["text"], strict=True):
                whole_text, step = text.as_py(), chunk - overlap
                starts = list(range(0, max(1, len(whole_text) - overlap), step))
                for lo in range(0, len(starts), 64):
                    some = starts[lo : lo + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc.as_py()] * len(some), batch.schema.field("doc_id").type), pa.array([fp.as_py()] * len(some)),
                            pa.array(range(lo, lo + len(some)), pa.int32()), pa.array(some, pa.int64()),
                            pa.array([whole_text[s : s + chunk] for s in some]),
                        ],
                        ["doc_id", "fp", "k", "start", "chunk"],
                    )

    parts = long.select("doc_id", "fp", "text").mapInArrow(cut, f"doc_id {id_type}, fp string, k int, start bigint, chunk string")
    return parts.repartition("fp", "k")


def stitched(long: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, fp, k, piece: texts cut at resynchronised boundaries; one piece where an overlap has none."""
    id_type = dict(long.dtypes)["doc_id"]
    cut = _chunks(long, chunk, overlap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for start, text in zip(batch["start"].to_pylist(), batch["chunk"].to_pylist(), strict=True):
                found = boundaries(text, pattern)
                heads.append([start + b for b in found if b < overlap - MARGIN])
                tails.append([start + b for b in found if len(text) - overlap <= b < len(text) - MARGIN])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["fp"], batch["k"], pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                ["doc_id", "fp", "k", "heads", "tails"],
            )

    found = cut_lineage(cut.mapInArrow(scan, f"doc_id {id_type}, fp string, k int, heads array<bigint>, tails array<bigint>"))
    one = Window.partitionBy("doc_id", "fp").orderBy("k")
    joint = F.array_min(F.array_intersect("tails", F.lead("heads").over(one)))
    last = F.lead("k").over(one).isNull()
    ends = found.select("doc_id", "fp", "k", joint.alias("to"), last.alias("last"))
    ends = ends.withColumn("from", F.lag("to").over(one))
    every = Window.partitionBy("doc_id", "fp")
    broken = F.max((F.col("to").isNull() & ~F.col("last")) | (F.col("from") >= F.col("to"))).over(every)
    ends = cut_lineage(ends.withColumn("broken", F.coalesce(broken, F.lit(False))))

    def on(a: DataFrame, b: DataFrame, *keys: str):
        cond = a["doc_id"].eqNullSafe(b["doc_id"])
        for key in keys:
            cond = cond & (a[key] == b[key])
        return cond

    good, bad = ends.where("not broken"), ends.where("broken and k = 0")
    begin = F.coalesce(good["from"] - cut["start"], F.lit(0))
    size = F.coalesce(good["to"] - cut["start"], F.length(cut["chunk"]).cast("long")) - begin
    pieces = cut.join(good, on(cut, good, "fp", "k")).select(
        cut["doc_id"], cut["fp"], cut["k"], F.substring(cut["chunk"], (begin + 1).cast("int"), size.cast("int")).alias("piece")
    )
    rest = long.join(bad, on(long, bad, "fp"), "left_semi").select("doc_id", "fp", F.lit(0).alias("k"), F.col("text").alias("piece"))
    return pieces.unionByName(rest)


def _encoded(docs: DataFrame, path: str, pattern: str, show: Callable, schema: str, id_col: str, text_col: str, chunk: int, overlap: int) -> DataFrame:
    """``show(encoder, ids)`` for each row, as the columns of ``schema`` after doc_id."""
    id_type = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    out = f"doc_id {id_type}, {schema}"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        enc = encoder(path, pattern)
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        for batch in batches:
            rows = [show(enc, encode_text(enc, t)) for t in batch["text"].to_pylist()]
            cols = pd.DataFrame(rows, columns=names)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(cols[c].tolist()) for c in names]], ["doc_id", *names])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).where(F.length("text") <= chunk)
    direct = rows.mapInArrow(short, out)

    long = _long(docs, id_col, text_col, chunk)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(path, pattern)
        for batch in batches:
            ids = [np.asarray(encode_text(enc, t), "<u4").tobytes() for t in batch["piece"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["fp"], batch["k"], pa.array(ids, pa.binary())], ["doc_id", "fp", "k", "ids"])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(path, pattern)
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        for batch in batches:
            rows = [show(enc, np.frombuffer(b"".join(ids), "<u4").tolist()) for ids in batch["ids"].to_pylist()]
            cols = [pa.array([r[i] for r in rows]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols], ["doc_id", *names])

    parts = stitched(long, pattern, chunk, overlap).mapInArrow(encode, f"doc_id {id_type}, fp string, k int, ids binary")
    # a document's ids meet in one row, as the result asks
    joined = parts.groupBy("doc_id", "fp").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]).alias("ids"))
    times = long.select("doc_id", "fp", "n")
    rows = joined.join(times, joined["doc_id"].eqNullSafe(times["doc_id"]) & (joined["fp"] == times["fp"])).select(
        joined["doc_id"], "ids", F.explode(F.expr("sequence(1, n)")).alias("_")
    )
    return direct.unionByName(rows.select("doc_id", "ids").mapInArrow(join_up, out))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids."""
    return _encoded(docs, path, pattern, lambda enc, ids: (ids,), "ids array<bigint>", id_col, text_col, chunk, overlap)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes: the ids' bytes one after the other."""
    id_type = dict(tokens.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            out = [enc.decode_bytes(ids or []) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, with ids encoded and decoded again in one pass."""

    def show(enc, ids: list[int]) -> tuple:
        named = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        return len(ids), named, hashlib.sha256(enc.decode_bytes(ids)).hexdigest()

    return _encoded(docs, path, pattern, show, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col, chunk, overlap)
