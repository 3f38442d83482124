"""Language identification: the forward pass against all segmentations, and held-out accuracy."""

from itertools import product

import numpy as np
import public_tokenizers

from hindsight.llm import language
from hindsight.plans.registry import table
from tests.conftest import bag

PATH = public_tokenizers.path("piece_bpe_32k.model")


def model_of(chance=None):
    vocab = language.vocabulary(PATH)
    rng = np.random.default_rng(1)
    chance = rng.random((vocab.size + 1, 2)) / vocab.size
    chance[-1] = 0
    return language.Model(PATH, ["aa", "bb"], chance, np.zeros(2))


def piece_index(piece):
    vocab = language.vocabulary(PATH)
    codes = np.array([list(map(ord, piece))], np.uint64)
    return int(vocab.lookup(codes).get((0, len(piece)), np.array([vocab.size]))[0]) if len(piece) <= language.LONGEST else vocab.size


def test_all_segmentations_are_summed():
    model = model_of()
    for word in ("the", "thing", "straße", "漢字x"):
        marked, total = language.MARK + word, np.zeros(2)
        uses = np.zeros((len(model.chance), 2))
        for cuts in product([0, 1], repeat=len(marked) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(marked)]
            pieces = [piece_index(marked[a:b]) for a, b in zip(at, at[1:], strict=False)]
            way = np.prod(model.chance[pieces], axis=0)
            total += way
            for p in pieces:
                uses[p] += way
        assert np.allclose(language.word_scores([word], model)[0], np.log(total))
        got = language.expected_counts([word], np.ones((1, 2)), model)
        assert np.allclose(got[:-1], (uses / total)[:-1])


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = language.identify(docs, PATH).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out)


def test_awkward_rows(docs, rows):
    out = bag(language.identify(docs, PATH), "doc_id", "lang_pred", "score")
    assert len(out) == len(rows)
    told = {(r[0], r[1]) for r in out}
    assert {(0, "und"), (1, "und"), (2, "und"), (3, "en"), (24, "en"), (25, "und"), (26, "und"), (None, "en"), (None, "und")} <= told
    assert all(r[2] == 0 for r in out if r[1] == "und")


def test_labels_teach_only_where_they_may(frame):
    """A label that only held-out rows carry is never predicted."""
    rows = [(i, "some english words here", "en") for i in range(40)]
    held = [r["doc_id"] for r in frame("doc_id long, text string, lang string", *rows).where(language.held_out("doc_id")).collect()]
    rows = [(i, "mots tout autres ici" if i in held else t, "fr" if i in held else lang) for i, t, lang in rows]
    out = language.identify(frame("doc_id long, text string, lang string", *rows), PATH).collect()
    assert {r["lang_pred"] for r in out} == {"en"} and {r["doc_id"] for r in out if r["held_out"]} == set(held)


def test_nothing_learned(no_docs, frame):
    assert language.identify(no_docs, PATH).collect() == []
    out = language.identify(frame("doc_id long, text string, lang string", (1, "words", None)), PATH).collect()
    assert [(r["lang_pred"], r["score"]) for r in out] == [("und", 0.0)]
