"""Removal of repeated passages: Rabin-Karp hashes of every window of words, counted in Spark.

Each document is hashed once: words by a polynomial over their bytes, then by prefix sums every window of ``WINDOW``
words and every gram of ``GRAM`` words. The smallest gram hash inside a window is its anchor. Neighbouring windows
mostly share their anchor's place, and such a run leaves the document as one row: anchor, place, number of windows and
the Rabin-Karp hash of all the words it spans. Equal windows have equal anchors at equal places, so

1. anchors are counted; a run whose anchor occurs once holds no repeated window;
2. runs are counted; where a whole run recurs, so do all its windows;
3. what is left (the edges of repeated passages) sends its single window hashes, together with those of one run of
   each kind that shares the anchor, and these are counted one by one.

Every window is thus counted against all others, but most of them by their run. Repeated windows merge into
maximal intervals, which are cut out where the text is read again; texts move once, and once more if they hold a
repeated passage.

Defined results: words are runs of anything but ASCII white space; a null text has none; a window counts as repeated if
the same words start anywhere else, in the same document too, or in a row that repeats this one; documents with fewer
words than a window stay whole; null ids are kept apart by their text; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.llm.text import whole
from hindsight.session import cut_lineage

WINDOW = 35
GRAM = 8
#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20

_BYTE = np.uint64(0x9E3779B97F4A7C55)
_WORD = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the power of 0, 1, ... modulo 2**64, ``n`` of them at least."""
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps)
    return _POWERS[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """Rabin-Karp prefix sums over the words of several texts, one after the other."""

    def __init__(self, words: list[list[bytes]]):
        sizes = np.array([len(w) for w in words], np.int64)
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        data = np.frombuffer(b" ".join([b" ".join(w) for w in words if w]) + b" ", np.uint8)
        stop = np.flatnonzero(data == 32)
        start = np.concatenate([[0], stop[:-1] + 1])
        n = int(sizes.sum())
        if not n:
            self.sums, self.back = np.zeros(1, np.uint64), np.ones(1, np.uint64)
            return
        size = stop + 1 - start
        inside = np.arange(len(data)) - np.repeat(start, size)
        word = np.add.reduceat(data.astype(np.uint64) * _powers(_BYTE, int(size.max()) + 1)[inside], start)
        word = _mixed(word + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * _powers(_WORD, n)[:n])])
        self.back = _powers(np.uint64(pow(int(_WORD), -1, 1 << 64)), n + 1)

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``start`` to before ``stop``."""
        return _mixed((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def runs_of(words: list[list[bytes]], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, start, n, place, anchor, span) of each run of windows that share an anchor, starts within documents."""
    h = Hashed(words)
    n = len(h.sums) - 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = np.arange(n - gram + 1)
    grams = h.span(at, at + gram)
    doc = np.repeat(np.arange(len(words)), np.maximum(h.end - h.begin - window + 1, 0))
    first = np.cumsum(np.concatenate([[0], np.maximum(h.end - h.begin - window + 1, 0)[:-1]]))
    i = np.arange(len(doc)) - first[doc] + h.begin[doc]
    least = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1)
    p = i + least[i]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])])) if len(p) else none
    count = np.diff(np.concatenate([new, [len(p)]]))
    start, anchor = i[new], p[new]
    place = anchor - start
    span = h.span(start, start + count - 1 + window) ^ _mixed((count * 64 + place).astype(np.uint64))
    return doc[new], start - h.begin[doc[new]], count, place, grams[anchor], span


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(index of the first, words of each) for stretches of about ``BLOCK`` bytes; a longer text is a stretch of its own."""
    words, total, first = [], 0, 0
    for i, text in enumerate(texts):
        data = text.encode()
        if words and total + len(data) > BLOCK:
            yield first, words
            words, total, first = [], 0, i
        words.append(data.split())
        total += len(data)
    if words:
        yield first, words


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def window_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, th, start, n, place, anchor, span for every run of ``docs`` (doc_id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in _blocks(batch["text"].to_pylist()):
                doc, start, n, place, anchor, span = runs_of(words, window, gram)
                row = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(row), batch["th"].take(row), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), _signed(anchor), _signed(span)],
                    ["doc_id", "th", "start", "n", "place", "anchor", "span"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, th bigint, start int, n int, place int, anchor bigint, span bigint")


def covered(total: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of ``total`` words lie in one of the spans (start, stop)."""
    edge = np.zeros(total + 1, np.int64)
    for start, stop in spans:
        edge[start] += 1
        edge[stop] -= 1
    return np.cumsum(edge[:-1]) > 0


def _finished(words: list[bytes], gone: np.ndarray | None) -> tuple[int, int, str, str]:
    kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    text = b" ".join(kept)
    return len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode()


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (, kept) for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    kind = dict(rows.dtypes)["doc_id"]
    key = ["doc_id", "th"]

    runs = cut_lineage(window_runs(rows.select("doc_id", "th", "text"), window, gram))
    often = cut_lineage(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"))
    shared = cut_lineage(runs.join(often, "anchor", "left_semi"))
    one = F.min(F.struct(*key, "start")).alias("one")
    kinds = cut_lineage(shared.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("c"), one, F.first("n").alias("n"), F.first("place").alias("place")))
    edges = cut_lineage(
        kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("c").alias("least")).where("kinds > 1 and least = 1").select("anchor")
    )
    recurring = kinds.where("c > 1").select("anchor", "span")
    whole_runs = shared.join(recurring, ["anchor", "span"], "left_semi").select(*key, "start", "n", F.lit(0).alias("weight"), F.lit(0).alias("place"), F.lit(None).cast("bigint").alias("anchor"))
    singly = kinds.join(edges, "anchor", "left_semi").select("one.*", "n", F.when(F.col("c") > 1, 2).otherwise(1).alias("weight"), "place", "anchor")
    todo = whole_runs.unionByName(singly).groupBy(*key).agg(F.collect_list(F.struct("start", "n", "weight", "place", "anchor")).alias("runs"))
    todo = cut_lineage(todo)

    extra = ", kept string" if with_text else ""
    result = f"n_words bigint, n_removed bigint, kept_sha256 string{extra}"

    def shown(out: tuple) -> tuple:
        return out if with_text else out[:3]

    names = [c.strip().split(" ")[0] for c in result.split(",")]
    kinds_of = [pa.int64(), pa.int64(), pa.string(), pa.string()][: len(names)]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = pa.list_(pa.struct([("anchor", pa.int64()), ("place", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("weight", pa.int32())]))
        for batch in batches:
            done, texts, spans, single = [], [], [], []
            for text, runs_ in zip(batch["text"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                words = text.encode().split()
                if not runs_:
                    done.append(shown(_finished(words, None)))
                    texts.append(None)
                    spans.append(None)
                    single.append(None)
                    continue
                h, mine = None, []
                for r in runs_:
                    if r["weight"]:
                        h = h or Hashed([words])
                        at = np.arange(r["start"], r["start"] + r["n"])
                        mine += [
                            {"anchor": r["anchor"], "place": r["place"] - k, "hash": int(v), "at": r["start"] + k, "weight": r["weight"]}
                            for k, v in enumerate(h.span(at, at + window).view(np.int64).tolist())
                        ]
                done.append((None,) * len(names))
                texts.append(text)
                spans.append([{"start": r["start"], "stop": r["start"] + r["n"] - 1 + window} for r in runs_ if not r["weight"]])
                single.append(mine)
            cols = [pa.array([d[i] for d in done], kinds_of[i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["th"], *cols, pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(single, hashes)],
                [*key, *names, "text", "spans", "singly"],
            )

    on = rows["doc_id"].eqNullSafe(todo["doc_id"]) & (rows["th"] == todo["th"])
    met = rows.join(todo, on, "left").select(rows["doc_id"], rows["th"], "text", "runs")
    told = "singly array<struct<anchor: bigint, place: int, hash: bigint, at: int, weight: int>>"
    seen = cut_lineage(met.mapInArrow(first_pass, f"doc_id {kind}, th bigint, {result}, text string, spans array<struct<start: int, stop: int>>, {told}"))

    # rows that repeat each other have no single runs: theirs all recur
    windows = seen.where(F.size("singly") > 0).select(*key, F.inline("singly"))
    window_key = ["anchor", "place", "hash"]
    again = windows.groupBy(*window_key).agg(F.sum("weight").alias("w")).where("w > 1").select(*window_key)
    hits = windows.where("weight = 1").join(cut_lineage(again), window_key, "left_semi")
    hits = cut_lineage(hits.groupBy(*key).agg(F.collect_list("at").alias("hits")))
    open_ = seen.where("text is not null")
    on = open_["doc_id"].eqNullSafe(hits["doc_id"]) & (open_["th"] == hits["th"])
    open_ = open_.join(hits, on, "left").select(open_["doc_id"], "text", "spans", "hits")

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, at in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), batch["hits"].to_pylist(), strict=True):
                words = text.encode().split()
                gone = covered(len(words), [(s["start"], s["stop"]) for s in spans] + [(a, a + window) for a in at or []])
                out.append(shown(_finished(words, gone)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array([o[i] for o in out], kinds_of[i]) for i in range(len(names))]], ["doc_id", *names])

    cut = open_.mapInArrow(second_pass, f"doc_id {kind}, {result}")
    return seen.where("text is null").select("doc_id", *names).unionByName(cut)
