"""Tables that joins read by their keys."""

import os

from pyspark.sql import functions as F

from hindsight import session
from hindsight.operators import blame, graph
from tests.conftest import bag


def files(table):
    return [f for path, _, names in os.walk(table.path.removeprefix("file:")) for f in names if f.endswith(".parquet")]


def test_a_step_has_one_file_a_bucket(spark):
    table = session.Bucketed(spark, ["node"])
    try:
        rows = spark.range(5000).repartition(7).select(F.concat(F.lit("n"), F.col("id")).alias("node"))
        assert table.append(rows) == 5000
        assert len(files(table)) <= table.buckets
        assert table.rows().select("node").distinct().count() == 5000
    finally:
        table.drop()


def test_what_lies_behind_few_nodes_is_sent_to_many_roots(spark, frame):
    roots = frame("root string, node string", *[(f"r{i}", f"a{i % 2}") for i in range(12)])
    dep = frame("node string, operand string, via string", ("a0", "b", "data"), ("a1", "b", "control"), ("a1", "b", "control"), ("b", "c", "data"), ("c", "a1", "data"))
    found = [bag(graph.backward_slice(roots, dep, 2, hot=h), "root", "node", "depth", "via", "parent", "truncated") for h in (3, 1_000_000)]
    assert found[0] == found[1]
    deep = lambda i: i % 2 == 0
    assert [r for r in found[0] if r[2] == 2] == sorted((f"r{i}", "c", 2, "data", "b", deep(i)) for i in range(12))


def test_links_are_ranked_once(frame):
    kinds = "root string, depth int, node string, via string, parent string, value bigint, last_change bigint, module string, ref string, truncated boolean"
    rows = [("r", d, f"n{d}", "x", f"n{d - 1}" if d else None, 7, 5 - d, "m", "a.scala:1", False) for d in range(4)]
    chain = session.cut_lineage(frame(kinds, *rows))
    digest, capped = blame.chain_digest(chain, 3), graph.cap_nodes(chain.select("root", "node", "depth", "via", "parent", "truncated"), 2)
    assert bag(digest, "depth", "truncated") == [(d, True) for d in range(3)] and bag(capped, "depth", "truncated") == [(0, True), (1, True)]
    assert not any("Window" in x._jdf.queryExecution().executedPlan().toString() for x in (digest, capped))
