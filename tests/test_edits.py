"""Proposals cut from texts of every short length, against their SQL."""

import duckdb

from hindsight.plans import load_all
from hindsight.plans.registry import ORACLES, QUERIES
from tests.oracle import compare

TEXT = "Reealy for. Onin rentre. Ene ly"


def test_proposals_from_short_texts(spark, frame, tmp_path):
    load_all()
    rows = [(n * 4 + k, TEXT[:n], "en", "s") for n in range(len(TEXT) + 1) for k in range(4)]
    frame("doc_id long, text string, lang string, source string", *rows, (1000, None, "en", "s")).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "E09_validate_proposal"
    problem, found, *_ = compare(spark, con, QUERIES[name], ORACLES[name], str(tmp_path))
    assert (problem, found) == ("", len(rows) + 1)
