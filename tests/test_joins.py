"""What grows with the input is merged, however small its file is."""

import pytest
from pyspark.sql import functions as F

from hindsight import session
from hindsight.operators import blame, evidence, graph, sites
from tests.conftest import bag


@pytest.fixture
def plans(monkeypatch):
    """Plans of all written copies; copies of more than two rows count as large."""
    seen, write = [], session.cut_lineage

    def cut(df):
        seen.append(plan(df))
        return write(df)

    monkeypatch.setattr(session, "SENT", 2)
    for module in (session, blame, graph):
        monkeypatch.setattr(module, "cut_lineage", cut)
    return seen


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_matches_are_not_broadcast(spark, frame, plans):
    rows = [("r", "f", i, "the end" if i % 3 else "") for i in range(30)]
    lines = frame("run_id string, file string, line_no int, text string", *rows)
    found = evidence.grep(lines, "the ", context=1, limit=1000)
    assert "BroadcastHashJoin" not in plan(found)
    at = lambda m: [n for n in (m - 1, m, m + 1) if n < 30]
    assert bag(found, "match", "line_no") == sorted((m, n) for m in range(30) if m % 3 for n in at(m))


def test_evaluation_merges_what_is_many(spark, frame, plans):
    gates = frame("node string, op string, width int, hi int, lo int", *[(f"g{i}", "&", 1, 0, 0) for i in range(8)], ("top", "|", 1, 0, 0))
    inputs = [(f"g{i}", k, f"x{i}{k}", 0, 1) for i in range(8) for k in range(2)] + [("top", i, f"g{i}", 0, 1) for i in range(8)]
    operands = frame("node string, pos int, operand string, shift int, operand_width int", *inputs)
    traced = frame("node string, value bigint", *[(f"x{i}{k}", int(i == 5 or k)) for i in range(8) for k in range(2)])
    found = blame.evaluate(gates, operands, session.cut_lineage(traced))
    assert {r.node: r.value for r in found.where("node LIKE 'g%' OR node = 'top'").collect()} == {**{f"g{i}": int(i == 5) for i in range(8)}, "top": 1}
    # the ninth gate settles alone, and one row may be sent
    assert sum("BroadcastHashJoin" in p for p in [*plans, plan(found)]) <= 1


def test_slices_merge_what_is_many(spark, frame, plans):
    dep = frame("node string, operand string, via string", *[(f"a{i}", f"b{i}", "data") for i in range(9)], *[(f"b{i}", "c", "data") for i in range(9)])
    roots = frame("root string, node string", *[(f"a{i}", f"a{i}") for i in range(9)])
    steps = graph.backward_slice(roots, dep, 1)
    assert "BroadcastHashJoin" not in plan(steps)
    assert bag(steps, "root", "depth", "node", "truncated") == sorted([(f"a{i}", 0, f"a{i}", True) for i in range(9)] + [(f"a{i}", 1, f"b{i}", True) for i in range(9)])


def test_lines_of_sites_are_not_broadcast(spark):
    texts = spark.range(20).select(F.concat(F.lit("f"), "id").alias("path"), F.concat(F.lit("a\n b + 1.U\n"), "id").alias("text"))
    found = sites.constant_sites(texts)
    assert "BroadcastHashJoin" not in plan(found)
    assert bag(found, "path", "line", "context") == sorted((f"f{i}", 2, "b + 1.U") for i in range(20))


def test_grams_travel_without_their_texts(spark, frame, plans, monkeypatch):
    seen, write = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: seen.append(df.columns) or write(df))
    lines = [("r", "f", i, f"the {i}th line of a file of lines") for i in range(8)] + [("r", "f", 9, "x" * 500), ("r", "f", 10, "")]
    found = evidence.nearest_lines(
        frame("run_id string, file string, probe string", ("r", "f", "the 3th line of a fyle of lines")),
        frame("run_id string, file string, line_no int, text string", *lines), 1, 0.8,
    )
    assert bag(found, "line", "line_no") == [("the 3th line of a file of lines", 3)]
    assert seen and not any({"line", "probe", "text"} & set(columns) for columns in seen)


def test_what_is_made_of_chains_is_merged(spark, frame, plans):
    roots = [f"r{i}" for i in range(9)]
    rows = [(r, d, f"{r}.n{d}", "x", f"{r}.n{d - 1}" if d else None, 7, 5 - d, "m", "a/f.scala:1", False) for r in roots for d in range(3)]
    kinds = "root string, depth int, node string, via string, parent string, value bigint, last_change bigint, module string, ref string, truncated boolean"
    chain = session.cut_lineage(frame(kinds, *rows))
    digest = blame.chain_digest(chain)
    assert bag(digest, "root", "depth", "node", "truncated") == sorted((r, d, f"{r}.n{d}", False) for r in roots for d in range(3))
    reads = frame("node string, mem string", *[(f"{r}.n1", f"{r}.m") for r in roots])
    hop = frame("root string, mem string, write_cycle bigint, port string", *[(r, f"{r}.m", 3, "W0") for r in roots])
    below = frame(kinds.replace(", truncated boolean", ", mem string"), *[(r, 0, "w", "root", None, 1, 3, "W", None, f"{r}.m") for r in roots])
    through = blame.cross_memory(chain, reads, hop, below)
    assert through.where("via = 'memory' AND depth = 1").count() == through.where("node = 'w' AND depth = 2").count() == 9
    files = blame.chain_files(chain, frame("root string, file string", *[(r, "f.scala") for r in roots]))
    assert bag(files, "root", "files", "modules", "hit") == sorted((r, 1, 1, True) for r in roots)
    capped = graph.cap_nodes(chain.drop("value", "last_change", "module", "ref"), 2)
    assert bag(capped, "root", "depth", "truncated") == sorted((r, d, True) for r in roots for d in range(2))
    assert not [p for p in [*plans, *map(plan, (digest, through, files, capped))] if "BroadcastHashJoin" in p]
