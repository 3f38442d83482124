"""Pairs that are compared at last, and how rows and texts meet what is known of them."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindsight.llm import exact_dedup, near_copies
from hindsight.llm.text import keep_rows


@pytest.mark.parametrize("bucket", [4, 1024])
def test_a_pair_is_made_once(spark, frame, monkeypatch, bucket):
    """Nodes that share three shingles, in one part or in several."""
    bits = bytearray(near_copies.bits_of(np.arange(64, dtype=np.uint64) << np.uint64(20)))
    live = frame("shingle bigint, node bigint, label bigint", *[(s, n, n) for s in (5, -7, 9) for n in range(12)], *[(11, n, n) for n in range(3)], (13, 20, 20), (13, 0, 0))
    sets = frame("node bigint, n bigint, bits binary", *[(n, 64, bits) for n in (*range(12), 20)])
    monkeypatch.setattr(type(live), "distinct", lambda self: self)
    found = [(r.a, r.b) for r in near_copies.rest_pairs(live, sets, 0.8, bucket).collect()]
    assert sorted(found) == sorted([*combinations(range(12), 2), (0, 20)])


def test_kept_rows_are_merged(frame):
    docs = frame("doc_id long, text string", (1, "a"), (2, "a"), (3, "b"))
    out = keep_rows(docs, exact_dedup.deduplicate(docs), {"doc_id": F.col("doc_id"), "digest": exact_dedup.digest_of()})
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]
