"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces, which a forward pass over its characters gives; a text's score is the sum of its
words' logarithms and the language's share of the labels. Piece probabilities come from expectation-maximisation:
a backward pass turns the current ones into expected counts, which Spark sums over the word types of all languages.

Training reads at most ``SAMPLE`` labelled documents of each language (chosen by a hash of id and text, so by no order);
prediction reads every word of every text. Workers keep a bounded table of word scores.

Defined results: letters are lower-cased; runs of letters are words and anything else is ignored; a null text, or one
without a letter, is ``und`` with score 0, and so is every text if nothing could be learned; rows with a null label or
text teach nothing; ties go to the language that sorts first; repeated rows are predicted alike; very long words are
scored in stretches; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindsight.llm.text import whole
from hindsight.session import cut_lineage

#: Labelled documents of each language that training reads, about.
SAMPLE = 4_000
ROUNDS = 3
#: Longest piece that is looked up, in characters, the word mark included.
LONGEST = 8
#: Longest stretch of a word that is segmented at once.
STRETCH = 24
#: What each piece has besides its expected count.
SMOOTHING = 0.1
#: Words whose scores a worker keeps.
WORDS = 250_000
MARK = "▁"
UNKNOWN = "und"

_VOCABULARY: dict = {}
_words = re.compile(r"[^\W\d_]+").findall
_BASE = np.uint64(0x9E3779B97F4A7C55)


def stretches(word: str) -> list[str]:
    """The letters of ``word``, marked at its start, in stretches that are segmented at once."""
    word = word if word.isalpha() else "".join(c for c in word if c.isalpha())
    if not word:
        return []
    marked = MARK + word
    return [marked[i : i + STRETCH] for i in range(0, len(marked), STRETCH)]


class Vocabulary:
    """Pieces by length, found by a hash of their characters; the last index is any other single character."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        pieces = sorted({p for p in pieces if len(p) <= LONGEST and p.removeprefix(MARK).isalpha() or p == MARK})
        self.size = len(pieces) + 1
        self.tables = {}
        for n in range(1, LONGEST + 1):
            at = np.array([i for i, p in enumerate(pieces) if len(p) == n], np.int64)
            if len(at):
                codes = np.array([[ord(c) for c in pieces[i]] for i in at], np.uint64)
                key = self._hash(codes)
                order = key.argsort()
                self.tables[n] = key[order], at[order]

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        key = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            key = key * _BASE + codes[:, j]
        return key

    def lookup(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece of each substring (start, length) of equally long words; ``size`` where there is none."""
        out, (_, width) = {}, codes.shape
        for n, (keys, ids) in self.tables.items():
            for start in range(width - n + 1):
                key = self._hash(codes[:, start : start + n])
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                found = np.where(keys[at] == key, ids[at], self.size - 1 if n == 1 else self.size)
                if n == 1 or (found != self.size).any():
                    out[start, n] = found
        return out


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARY:
        _VOCABULARY[path] = Vocabulary(path)
    return _VOCABULARY[path]


@dataclass
class Model:
    path: str
    languages: list[str]
    #: piece x language, with a last row of zeros for what is no piece
    chance: np.ndarray
    prior: np.ndarray


def forward(pieces: dict, chance: np.ndarray, width: int) -> list[np.ndarray]:
    """Probability of each prefix, summed over its segmentations: ``width + 1`` arrays of words x languages."""
    count = len(next(iter(pieces.values())))
    alpha = [np.ones((count, chance.shape[1]))]
    for stop in range(1, width + 1):
        total = np.zeros_like(alpha[0])
        for n in range(1, min(stop, LONGEST) + 1):
            if (stop - n, n) in pieces:
                total += alpha[stop - n] * chance[pieces[stop - n, n]]
        alpha.append(total)
    return alpha


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Logarithm of each word's probability in each language; zeros for what has no letter."""
    vocab, out = vocabulary(model.path), np.zeros((len(words), len(model.languages)))
    by_width = defaultdict(list)
    for i, word in enumerate(words):
        for part in stretches(word):
            by_width[len(part)].append((i, part))
    for width, some in by_width.items():
        for lo in range(0, len(some), 8192):
            block = some[lo : lo + 8192]
            codes = np.array([list(map(ord, p)) for _, p in block], np.uint64)
            last = forward(vocab.lookup(codes), model.chance, width)[-1]
            np.add.at(out, [i for i, _ in block], np.log(np.maximum(last, 1e-300)))
    return out


def expected_counts(words: list[str], weights: np.ndarray, model: Model) -> np.ndarray:
    """Expected uses of each piece in each language; ``weights`` are words x languages."""
    vocab, total = vocabulary(model.path), np.zeros((vocabulary(model.path).size + 1, len(model.languages)))
    by_width = defaultdict(list)
    for i, word in enumerate(words):
        for part in stretches(word):
            by_width[len(part)].append((i, part))
    for width, some in by_width.items():
        for lo in range(0, len(some), 8192):
            block = some[lo : lo + 8192]
            codes = np.array([list(map(ord, p)) for _, p in block], np.uint64)
            pieces = vocab.lookup(codes)
            alpha = forward(pieces, model.chance, width)
            scale = weights[[i for i, _ in block]] / np.maximum(alpha[-1], 1e-300)
            beta = [np.zeros_like(scale) for _ in range(width)] + [np.ones_like(scale)]
            for start in range(width - 1, -1, -1):
                for n in range(1, min(width - start, LONGEST) + 1):
                    if (start, n) in pieces:
                        way = model.chance[pieces[start, n]] * beta[start + n]
                        beta[start] += way
                        used = alpha[start] * way * scale
                        for k in range(total.shape[1]):
                            total[:, k] += np.bincount(pieces[start, n], used[:, k], len(total))
    return total


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """A model of the languages that ``docs`` are labelled with."""
    spark = docs.sparkSession
    vocab = vocabulary(path)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    prior = np.log([sizes[x] / sum(sizes.values()) for x in languages]) if sizes else np.zeros(0)
    model = Model(path, languages, np.full((vocab.size + 1, len(languages)), 1 / vocab.size), prior)
    model.chance[-1] = 0
    if not languages:
        return model
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, sample / sizes[x]))) for x in languages])
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                seen[lang].update(_words(text.lower()))
            out = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    types = drawn.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    types = cut_lineage(types.repartition(spark.sparkContext.defaultParallelism))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = shared.value
            total = np.zeros((vocabulary(now.path).size + 1, len(now.languages)))
            column = {x: k for k, x in enumerate(now.languages)}
            for batch in batches:
                weights = np.zeros((batch.num_rows, len(now.languages)))
                weights[np.arange(batch.num_rows), [column[x] for x in batch["lang"].to_pylist()]] = batch["n"].to_numpy(zero_copy_only=False)
                total += expected_counts(batch["word"].to_pylist(), weights, now)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        summed = types.mapInArrow(expect, "piece bigint, lang bigint, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        counts = np.full((vocab.size + 1, len(languages)), SMOOTHING)
        for r in summed.collect():  # pieces x languages at most
            counts[r["piece"], r["lang"]] += r["n"]
        counts[-1] = 0
        model = Model(path, languages, counts / counts.sum(axis=0), prior)
    return model


class Scorer:
    """Texts to (language, score), with a bounded table of words."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.scores = np.zeros((0, len(model.languages)))
        self.letters = np.zeros(0, bool)

    def _learn(self, found: list[list[str]]) -> None:
        if len(self.place) > WORDS:
            self.__init__(self.model)
        new = list(dict.fromkeys(w for words in found for w in words if w not in self.place))
        if new:
            self.place |= zip(new, range(len(self.place), len(self.place) + len(new)), strict=True)
            self.scores = np.concatenate([self.scores, word_scores(new, self.model)])
            self.letters = np.concatenate([self.letters, [bool(stretches(w)) for w in new]])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.model.languages:
            return langs, scores
        for lo in range(0, len(texts), 256):
            found = [_words((t or "").lower()) for t in texts[lo : lo + 256]]
            self._learn(found)
            for i, words in enumerate(found, lo):
                at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                if len(at) and self.letters[at].any():
                    total = self.scores[at].sum(axis=0) + self.model.prior
                    best = int(total.argmax())
                    langs[i] = self.model.languages[best]
                    scores[i] = float(1 / np.exp(total - total[best]).sum())
        return langs, scores


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (a struct of the columns in ``keep``), lang_pred and score for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    inside = text_col in keep  # the text goes to the task once
    rows = docs.select(row) if inside else docs.select(row, F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = part["row"].flatten()[keep.index(text_col)] if inside else part["text"]
                langs, scores = scorer.predict(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out, predicted for all."""
    model = train(docs.where(~F.coalesce(held_out(id_col), F.lit(False))), path, text_col, lang_col)
    out = predict(docs, model, [id_col], text_col).select(F.col("row")[id_col].alias("doc_id"), "lang_pred", "score")
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
