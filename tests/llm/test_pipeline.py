"""The pipeline's stages one by one, and the registered queries."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from hindsight.llm.queries import ORACLES, QUERIES
from tests.conftest import order
from tests.llm.test_dedup import UP
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def key(r):
    return order((r["doc_id"], r["text"]))


def test_stages(spark, docs, rows):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "pii", "packing"]
    spoken = stages["language_id"](spark, docs, FOLDER)
    assert spoken.columns == docs.columns
    letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(map(key, spoken.collect())) == sorted(order((r[0], r[1])) for r in letters)
    once = stages["exact_dedup"](spark, docs, FOLDER)
    assert once.columns == docs.columns
    keep = {}
    for r in rows:
        text = (r[1] or "").translate(UP)
        keep[text] = max(keep.get(text, -1), -1 if r[0] is None else r[0])
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in once.collect()) == sorted(keep.values())
    apart = stages["near_dedup"](spark, docs, FOLDER)
    assert apart.columns == docs.columns
    left = [r["doc_id"] for r in apart.collect()]
    assert {6, 12, 13, 10, 100}.isdisjoint(left) and {None, 0, 5, 11, 9} <= set(left) and len(left) == len(rows) - 6
    clean = stages["pii"](spark, docs, FOLDER)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[20] == "write to [email] or [phone] today" and texts[0] is None and texts[4] == rows[4][1]


def test_run(spark):
    """Whole table in, gapless sequences out, every token of every document that is left once."""
    out = corpus_pipeline.run(spark, FOLDER).collect()
    total = {}
    for r in out:
        total.setdefault(r["doc_id"], [r["doc_tokens"], 0])[1] += r["length"]
    assert all(a == b for a, b in total.values())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    distinct = {t.translate(UP) for t in texts.values()}
    assert len(distinct) * 0.9 < len(total) <= len(distinct)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    same = [d for d, (n, _) in total.items() if len(tokenizer.encode(texts[d], add_special_tokens=False).ids) + 1 == n]
    assert len(same) > 0.8 * len(total)


def test_registered(spark):
    """Every operator has its query, and SQL agrees where there is some."""
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    con = connect(FOLDER)
    for name, sql in ORACLES.items():
        assert compare(spark, con, QUERIES[name], sql, FOLDER)[0] == ""


def test_near_keys_on_id_and_text(spark, frame):
    """A repeated id loses only the text that is a near copy; near copies without an id are looked at, too."""
    base, other = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    rows = [(1, base), (2, base + " end"), (2, "a clean text of its own with many words"), (None, other), (None, other + " end")]
    docs = frame("doc_id long, text string", *rows)
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, docs, FOLDER).collect()}
    assert {(1, base), (2, rows[2][1])} < left and len(left) == 3 and {r[1] for r in left if r[0] is None} < {other, other + " end"}
