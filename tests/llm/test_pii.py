"""Personal data: base spans against plain patterns, votes, classifier and redaction."""

import re

from pyspark.sql import functions as F

from hindsight.llm import pii
from tests.conftest import bag, order

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for i, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def spans_of(column):
    return [(s["start"], s["kind"], s["stop"]) for s in column]


def test_base_spans_stay(docs, rows):
    got = pii.with_spans(docs, keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        base = spans_of(r["base"])
        assert base == plain_spans(r["row"]["text"])
        assert set(base) <= set(spans_of(r["spans"]))
        assert spans_of(r["spans"]) == sorted(spans_of(r["spans"]))


def test_hard_texts(frame):
    texts = [
        "a@b.com_x@y.org", "a.b@c.d.e-f.g. x@y", "1.2.3.4.5.6.7.8", "000255.1.1.1 256.1.1.1 1.1.1.1111", "4111 1111-1111 1111 4111111111111111",
        "+1 2 3(4)5.6-7 8 9 0 ++49 30 1234567 +12", "é@é.de ü+1 555 010 9999é", "@a.b a@.b a@b", "1-2 3  4 5", "+--1", "x" * 3000 + "@y.zz " + "7" * 3000,
        " ".join(["10.0.0.1"] * 1500),
    ]
    docs = frame("doc_id long, text string", *enumerate(texts))
    for r in pii.find_spans(docs).collect():
        assert spans_of(r["base"]) == plain_spans(r["text"]), r["text"][:50]


def test_neighbours_are_added(frame):
    """Numbers side by side, which the base patterns read as one and drop."""
    rows = [(i, f"call +1 (836) 555-{1000 + i} or mail a{i}@example.com, 53.121.55.{i % 200} card 4913187196670932.") for i in range(60)]
    rows += [(100, "so +1 (836) 555-9331 4913187196670932 53.121.55.90 and"), (101, "card 4465758382889437 4465758382889437 end"), (102, "Version 2.0 of 4234 5678 9012 3457 things, plain words")]
    found = {r["doc_id"]: r["spans"] for r in pii.with_spans(frame("doc_id long, text string", *rows), keep=["doc_id"]).select("row.doc_id", pii.written("spans").alias("spans")).collect()}
    assert found[100] == "phone:3:20,card:21:37,ip:38:50"
    assert found[101] == "card:5:21,card:22:38"
    assert found[102] == ""


def test_each_spelling_of_an_address_is_proposed(frame):
    """Alone in its text, with nothing else that the filter looks for; ends of sentences are no addresses."""
    dots = [".", " . ", "(dot)", "[dot]", " (dot) ", " [dot] ", " dot "]
    spelt = [f"jane{at}example{dot}com" for at in (" at ", "(at)", "[at]", " (at) ", " [at] ") for dot in dots]
    docs = frame("doc_id long, text string", *enumerate(f"so {x}, then" for x in spelt), (100, "He looked at him. She was at home. It rained."))
    got = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["more"]] for r in pii.find_spans(docs).select("row.doc_id", "more").collect()}
    assert got == {i: [(3, 3 + len(x))] for i, x in enumerate(spelt)} | {100: []}
    rows = [(i, f"mail a{i}@example.com now") for i in range(40)] + [(100, "so jane at example.com, then")]
    found = pii.with_spans(frame("doc_id long, text string", *rows), keep=["doc_id"]).where("row.doc_id = 100")
    assert found.select(pii.written("spans")).first()[0] == "email:3:22"


def test_estimate_tells_labelers_apart(frame):
    told = frame("kind int, votes string, n long", (0, "11111", 500), (0, "21212", 40), (0, "20200", 400), (0, "20220", 200))
    posterior = {r["votes"]: r["posterior"] for r in pii.estimate(told).collect()}
    assert posterior["11111"] > 0.95 and posterior["20200"] < 0.05
    assert pii.accepted(told)[0] == "0 11111" and "0 20200" not in pii.accepted(told)


def test_redaction(frame):
    text = "é mail a@b.com, or 1.2.3.4!"
    rows = pii.with_spans(frame("doc_id long, text string", (1, text), (2, None), (3, "plain")))
    out = bag(rows.select("row.doc_id", F.when(F.col("row.text").isNotNull(), pii.redacted("row.text", "spans")).alias("t")))
    assert out == [(1, "é mail [email], or [ip]!"), (2, None), (3, "plain")]
    overlapping = frame("text string, spans array<struct<start int, kind int, stop int>>", ("abcdefgh", [(1, 0, 4), (2, 2, 5), (5, 1, 6)]))
    assert overlapping.select(pii.redacted("text", "spans")).first()[0] == "a[email][ip]gh"


def test_empty(no_docs):
    assert pii.with_spans(no_docs).collect() == []
    assert order((None,)) == ((True, 0),)


def test_a_text_full_of_spans(spark):
    """Work grows with the text, not with text times spans."""
    import time

    text = " ".join(f"word {i} user{i}@example.com" for i in range(10_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    t0 = time.monotonic()
    row = pii.find_spans(docs).select(F.size("base").alias("n"), F.element_at("base", -1)["stop"].alias("stop")).first()
    assert (row.n, row.stop) == (10_000, len(text))
    assert time.monotonic() - t0 < 90
