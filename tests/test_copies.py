"""What an operator writes and shuffles on the way to its result does not stay on disk, and is not dealt out twice."""

import os

import pytest
from pyspark.sql import functions as F

from hindsight import session
from hindsight.operators import blame, graph
from hindsight.sources import netlist
from tests.conftest import bag


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def copies(spark):
    folder = session.own_folder(spark).rsplit("/", 1)[0].removeprefix("file:")
    return set(os.listdir(folder)) if os.path.exists(folder) else set()


@pytest.fixture
def tree(frame):
    """An adder and a gate of eight inputs over eight pairs, one of which is not recorded."""
    gates = [(f"g{i}", "&", 1, 0, 0) for i in range(8)] + [("top", "|", 1, 0, 0), ("sum", "+", 4, 0, 0), ("loop", "id", 1, 0, 0)]
    inputs = [(f"g{i}", k, f"x{i}{k}", 0, 1) for i in range(8) for k in range(2)] + [("top", i, f"g{i}", 0, 1) for i in range(8)]
    inputs += [("sum", 0, "top", 0, 1), ("sum", 1, "x00", 0, 1), ("loop", 0, "loop", 0, 1)]
    traced = [(f"x{i}{k}", int(i == 5 or k)) for i in range(8) for k in range(2) if i != 7]
    return (
        frame("node string, op string, width int, hi int, lo int", *gates),
        frame("node string, pos int, operand string, shift int, operand_width int", *inputs), frame("node string, value bigint", *traced),
    )


def test_written_copies_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    copy = session.cut_lineage(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.sum("id").alias("s")))
    assert not shuffle_files(spark) - before
    assert copy.count() == 7


def test_dealt_copies_join_without_a_shuffle(spark):
    left = session.cut_dealt(spark.range(50).withColumn("a", F.col("id") % 5), ["id"])
    right = session.cut_dealt(spark.range(30).withColumn("b", F.col("id") % 3), ["id"])
    both = left.join(right.hint("merge"), "id")
    assert both.count() == 30 and "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("dealt_")]


@pytest.mark.parametrize("large", [0, 1_000_000])
def test_evaluation_leaves_its_result_alone(spark, tree, large):
    before = copies(spark)
    found = blame.evaluate(*tree, large=large)
    assert len(copies(spark) - before) == 1
    values = {r.node: (r.value, r.reason) for r in found.collect()}
    assert [values[f"g{i}"] for i in range(8)] == [(int(i == 5), None) if i < 7 else (None, "unknown") for i in range(8)]
    assert values["top"] == values["sum"] == (None, "unknown") and values["loop"] == (None, "loop") and values["x70"] == (None, "unknown")
    assert len(bag(found)) == len(values) == 16 + 11


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_operands_move_twice_to_those_they_account_for(spark, tree):
    gates, operands = (session.cut_dealt(t, ["node"]) for t in tree[:2])
    found = blame.responsible(gates, operands, blame.evaluate(gates, operands, tree[2]))
    assert exchanges(found) <= 4  # all operands to their values and back, the first of a mux likewise
    assert bag(found.where("node IN ('g5', 'g0', 'sum')"), "node", "pos") == [("g0", 0), ("g5", 0), ("g5", 1), ("sum", 0), ("sum", 1)]


def chains(frame, links):
    """Chains (root, depth, node, parent, value) as ``why`` returns them."""
    kinds = "root string, depth int, node string, via string, parent string, value bigint, last_change bigint, module string, ref string, truncated boolean"
    return frame(kinds, *[(r, d, n, "x", p, v, 9 - d, "m", "a/f.scala:1", False) for r, d, n, p, v in links])


def test_digest_follows_parents_only_below_anchors(frame, monkeypatch):
    """A plain root's chain is not dealt out by parent; below an anchor only its own branch stays."""
    dealt, cut = [], session.cut_dealt
    monkeypatch.setattr(blame, "cut_dealt", lambda df, keys: dealt.append((keys, cut(df, keys))) or dealt[-1][1])
    plain = [("p", d, f"p{d}", f"p{d - 1}" if d else None, 1) for d in range(4)]
    marked = [("m", 0, "m0", None, 7), ("m", 1, "m1", "m0", 7), ("m", 1, "n1", "m0", 2), ("m", 2, "a2", "n1", 3), ("m", 2, "m2", "m1", 4)]
    found = blame.chain_digest(chains(frame, plain + marked))
    assert bag(found, "root", "depth", "node") == [("m", 0, "m0"), ("m", 1, "m1"), ("m", 2, "m2"), *[("p", d, f"p{d}") for d in range(4)]]
    parents = [df for keys, df in dealt if keys == ["root", "parent"]]
    assert [{r.root for r in df.collect()} for df in parents] == [{"m"}]


def test_capped_slices_tell_what_was_left_out(frame):
    steps = chains(frame, [("r", d, f"r{d}", None, 1) for d in range(3)] + [("s", 0, "s0", None, 1)]).select("root", "node", "depth", "via", "parent", "truncated")
    deep = steps.withColumn("truncated", F.col("root") == "s")
    capped = graph.cap_nodes(deep, 2)
    assert bag(capped, "root", "depth", "truncated") == [("r", 0, True), ("r", 1, True), ("s", 0, True)]
    assert exchanges(capped) == 0  # what was dealt out by root for the ranks serves the flags


def test_chains_across_a_memory_are_dealt_out_once(frame):
    chain = chains(frame, [("r", 0, "r0", None, 1), ("r", 1, "q.0", "r0", 1), ("r", 1, "q.1", "r0", 1), ("s", 0, "s0", None, 1)])
    hop = frame("root string, mem string, write_cycle bigint, port string", ("r", "q", 5, "W0"))
    below = chains(frame, [("r", 0, "w", None, 7)]).withColumn("mem", F.lit("q"))
    found = blame.cross_memory(chain, frame("node string, mem string", ("q.0", "q")), hop, below)
    assert bag(found, "root", "depth", "node") == [("r", 0, "r0"), ("r", 1, "-- written at cycle 5 by port W0 --"), ("r", 1, "q.0"), ("r", 2, "w"), ("s", 0, "s0")]
    assert exchanges(found) <= 2  # only what lies below is moved to the ends


def test_lines_are_dealt_out_by_chunk_once(frame):
    texts = ["always @(posedge c) begin", "if (a) begin", "q <= x;", "end", "end // always", "wire w = y;"] * 3
    lines = frame("module string, line_no bigint, text string", *[(m, i, t) for m in ("M", "N") for i, t in enumerate(texts)])
    found = netlist.statements(lines, 4)
    assert exchanges(found) <= 8  # summaries to their modules and back, no lines
    assert bag(netlist.fanin(found), "module", "node", "operand", "via") == sorted(
        (m, *e) for m in ("M", "N") for e in (("q", "a", "control"), ("q", "x", "data"), ("w", "y", "data"))
    )


def test_chains_without_values_join_facts_alone(frame):
    roots = frame("root string, node string", ("r", "a"))
    edges = frame("node string, operand string, via string", ("a", "b", "data"))
    facts = frame("node string, module string, ref string, expr string", ("a", "M", "m/f.scala:1", "&"))
    chain = blame.why(roots, edges, None, None, facts)
    assert bag(chain, "root", "depth", "node", "value", "last_change", "ref") == [("r", 0, "a", None, None, "m/f.scala:1"), ("r", 1, "b", None, None, None)]
    named = blame.chain_files(chain, frame("root string, file string", ("r", "f.scala"), ("s", "g.scala")))
    assert bag(named, "root", "files", "modules", "hit") == [("r", 1, 2, True), ("s", 0, 0, False)]
