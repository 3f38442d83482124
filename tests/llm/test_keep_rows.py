"""Rows that are kept by decisions on their keys."""

from pyspark.sql import functions as F

from hindsight.llm import exact_dedup
from hindsight.llm.text import keep_rows


def test_keep_rows(frame):
    """Repeated rows, null ids and columns with clashing names: of equal texts the row with the largest id, once."""
    rows = [(1, "Same", "x"), (2, "same", "y"), (2, "same", "y"), (2, "SAME", "y"), (None, "alone", "z"), (None, None, "n"), (None, "", "n"), (3, "own", "k")]
    docs = frame("doc_id long, text string, kept string", *rows)
    out = keep_rows(docs, exact_dedup.deduplicate(docs), {"doc_id": F.col("doc_id"), "digest": exact_dedup.digest_of()})
    assert out.columns == docs.columns
    found = [((r["doc_id"] is None, r["doc_id"] or 0), (r["text"] or "").lower(), r["kept"]) for r in out.collect()]
    assert sorted(found) == [((False, 2), "same", "y"), ((False, 3), "own", "k"), ((True, 0), "", "n"), ((True, 0), "alone", "z")]


def test_keep_rows_empty(frame):
    docs = frame("doc_id long, text string")
    assert keep_rows(docs, exact_dedup.deduplicate(docs), {"doc_id": F.col("doc_id"), "digest": exact_dedup.digest_of()}).collect() == []
