"""Log text, outcomes, netlists and graphs on small literal inputs."""

import math
import random
import re
import time
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindsight.operators import blame, evidence, graph, outcome, sites, study
from hindsight.operators.resample import bootstrap_ci, weighted_sums
from hindsight.sources import ledger, nesting, netlist, runlog
from hindsight.streaming import queue
from tests.conftest import bag, order

LOG = """C                  27: 3 0x0000000000010000 (0x00000517) auipc   a0, 0x0 x10 0x0000000000010000
C                  39: 3 0x0000000000010008 (0x30551073) csrw    mtvec, a0
C                  51: 3 0x000000000001000c (0x301022f3) csrr    t0, misa x 5 0x800000000014112d
Cosim: Configuring spike cosim
Cosim: isa string: rv64imafdczicsr_zifencei_zihpm_zicntr
C               49200: 0 0x0000000080000048 (0xfc0f2023) sd      t3, -64(t5)
3 0x0000000000010000 (0x00000517)""".split("\n")


@pytest.fixture
def log(frame):
    def make(*rows):
        return frame("run_id string, line_no long, text string", *[("r", i, t) for i, t in enumerate(rows)])

    return make


def test_commits(log):
    got = runlog.parse_commits(log(*LOG))
    cols = ["line_no", "cycle", "priv", F.col("pc").cast("long"), "rd", F.col("wdata").cast("decimal(20,0)").cast("string"), "regfile"]
    assert bag(got, *cols) == sorted([
        (0, 27, 3, 0x10000, 10, str(0x10000), "x"), (1, 39, 3, 0x10008, None, None, None),
        (2, 51, 3, 0x1000C, 5, str(0x800000000014112D), "x"), (5, 49200, 0, 0x80000048, None, None, None),
        (6, None, 3, 0x10000, None, None, None),
    ], key=order)


def test_findings(log):
    pc = runlog.parse_divergence(log("Cosim: 1c PC mismatch spike 10000 != DUT 0")).first()
    assert (pc.kind, pc.spike, pc.dut, pc.cycle_token, pc.cycle_hex, pc.cycle_dec) == ("pc", "0x10000", "0x0", "1c", 28, None)
    wd = runlog.parse_divergence(log("noise", "Cosim: ff wdata mismatch reg 5 deadbeef != cafef00d")).first()
    assert (wd.kind, wd.reg, wd.spike) == ("wdata", 5, "0xdeadbeef")
    assert runlog.parse_divergence(log("Cosim: Configuring spike cosim", "*** PASSED ***")).count() == 0


def test_assertion_with_and_without_source(log):
    got = runlog.parse_assertions(log(
        "[17249000] %Error: BoomCore.sv:2116: Assertion failed in TOP.core: Assertion failed: Pipeline has hung.",
        "    at core.scala:2059 assert (!(idle_cycles.value(13)))", "quiet", "%Error: x.sv:1: Assertion failed: other", "quiet",
    ))
    assert bag(got, "line_no", "src") == [(0, "core.scala:2059"), (3, None)]
    assert "Pipeline has hung" in got.where("line_no = 0").first().message


def test_locator_inherits_the_file_named_last(log):
    got = runlog.parse_locators(log("wire x; // @[a.scala:12:3, :14:9, b.scala:4:{1,2}]"))
    assert bag(got, "ref_no", "file", "line", "col") == [
        (0, "a.scala", 12, 3), (1, "a.scala", 14, 9), (2, "b.scala", 4, 1), (3, "b.scala", 4, 2)
    ]


def test_identifiers(frame):
    df = frame("e string", "a & 2'h3 | b", "32'hDEAD", "if_x + x // y")
    assert [r[0] for r in df.select(netlist.identifiers(F.col("e"))).collect()] == [["a", "b"], [], ["if_x", "x"]]


SV = """module Child(
  input        clock,
  input  [3:0] io_in,
  output [3:0] io_out
);
  wire [3:0] inner = io_in;
  assign io_out = inner;
endmodule""".split("\n")
PARENT = """module Parent(
  input clock,
  input [3:0] src
);
  wire [3:0] _child_io_out;
  reg  [3:0] held;
  wire [3:0] gate = src & held;
  always @(posedge clock) begin
    if (gate[0]) begin
      held <= _child_io_out;
    end
  end // always
`ifdef ENABLE_INITIAL_REG_
  initial begin
    held = _RANDOM[0];
  end
`endif
  Child child (
    .clock (clock),
    .io_in (gate),
    .io_out (_child_io_out)
  );
endmodule""".split("\n")


@pytest.mark.parametrize("span", [3, 1000])
def test_netlist_slice_crosses_modules(frame, span):
    text = frame("module string, line_no long, text string", *[
        (m, i, t) for m, lines in (("Child", SV), ("Parent", PARENT)) for i, t in enumerate(lines)
    ])
    edges = netlist.fanin(netlist.statements(text, span))
    assert bag(edges) == sorted([
        ("Child", "inner", "io_in", "data"), ("Child", "io_out", "inner", "data"), ("Parent", "gate", "src", "data"),
        ("Parent", "gate", "held", "data"), ("Parent", "held", "_child_io_out", "data"), ("Parent", "held", "gate", "control"),
    ], key=order)
    conns = netlist.connections(text, span)
    assert bag(conns, "port", "expr") == [("clock", "clock"), ("io_in", "gate"), ("io_out", "_child_io_out")]
    instance = frame("path string, module string", ("top", "Parent"), ("top.child", "Child"))
    dep = graph.hops(instance, edges, netlist.ports(text, span), netlist.wiring(conns))
    roots = frame("root string, node string", ("q", "top.held"))
    steps = {(r.node, r.via) for r in graph.backward_slice(roots, dep).collect()}
    assert {
        ("top.gate", "control"), ("top._child_io_out", "data"), ("top.child.io_out", "port-down"), ("top.child.inner", "data"),
        ("top.child.io_in", "data"),
    } <= steps
    kept = graph.backward_slice(roots, dep, keep=frame("node string", "top._child_io_out"))
    assert {r.node for r in kept.where("via in ('data', 'control')").collect()} == {"top._child_io_out"}


def test_every_statement_of_a_nested_block(frame):
    # an `if` at the depth of an earlier `else if` takes its place
    text = """always @(posedge clock) begin
    if (reset) begin
      a <= 1'h0;
    end else if (en) begin
      a <= b;
      if (deep)
        m[idx] <= c;
    end
  end
  assign z = a;
  always @(posedge clock) begin
    d <= e;
  end""".split("\n")
    lines = frame("module string, line_no long, text string", *[("M", i, t) for i, t in enumerate(text)])
    got = set(bag(netlist.fanin(netlist.statements(lines, 4)), "node", "operand", "via"))
    assert got == {
        ("a", "reset", "control"), ("a", "b", "data"), ("a", "en", "control"), ("m", "c", "data"), ("m", "deep", "control"),
        ("m", "idx", "control"), ("m", "reset", "control"), ("z", "a", "data"), ("d", "e", "data"),
    }


def plain_nesting(lines):
    """(line_no, within, conditions) of statements, each from all lines before it, by definition."""
    nest, events, out, kept = 0, [], [], []
    for n, r in enumerate(lines):
        nest += r["step"]
        if r["step"]:
            events.append((nest - 1 if r["step"] == 1 else max(nest, 0), r["step"] == 1 and r["scaffold"]))
        open_ = [k for k in range(9) if [e for e in events if e[0] <= k][-1:] == [(k, True)]]
        if not r["step"] and not open_:
            kept.append((n, r))
    for i, (n, r) in enumerate(kept):
        starts = [j for j in range(i + 1) if kept[j][1]["always"]]
        after = lambda j: sum(kept[k][1]["delta"] for k in range([s for s in starts if s <= j][-1], j + 1))
        left = [j for j in range(i) if starts and j >= starts[0] and after(j) <= 0 and kept[j][1]["ends"] and not kept[j][1]["names_always"]]
        r["within"] = bool(starts) and not (left and left[-1] >= starts[-1])
        r["level"], r["load"] = None, None
        if r["always"]:
            r["level"] = 0
        elif r["within"] and (r["cond"] is not None or r["is_else"]):
            r["level"], r["load"] = max(after(i) - r["delta"], 0), r["cond"]
        held = []
        for k in range(30):
            last = [x for _, x in kept[: i + 1] if x["level"] is not None and x["level"] <= k][-1:]
            if last and last[0]["level"] == k and last[0]["load"] is not None:
                held.append(last[0]["load"])
        if r["q"]:
            out.append((n, r["within"], tuple(held)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_nesting_composes(spark, seed):
    """Chunks of any size give what the whole history of each line gives, unbalanced text too."""
    rng = random.Random(seed)
    rows = []
    for module in "AB":
        for n in range(70):
            step = rng.choice([0] * 12 + [1, -1])
            always = not step and rng.random() < 0.06
            delta = 0 if step else rng.choice([0, 0, 0, 1, 1, -1, -1, -2])
            cond = f"c{n}" if not step and not always and rng.random() < 0.3 else None
            rows.append({
                "module": module, "line_no": n, "step": step, "scaffold": step == 1 and rng.random() < 0.5, "always": always, "delta": delta,
                "ends": delta < 0 or rng.random() < 0.1, "names_always": always or rng.random() < 0.05, "cond": cond,
                "is_else": cond is None and not always and not step and rng.random() < 0.15, "q": "x" if rng.random() < 0.6 else None,
            })
    schema = "module string, line_no long, step int, scaffold boolean, always boolean, delta long, ends boolean, names_always boolean, cond string, is_else boolean, q string"
    lines = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(3)
    want = sorted((m, *x) for m in "AB" for x in plain_nesting([dict(r) for r in rows if r["module"] == m]))
    for span in (1, 4, 13, 1000) if seed < 2 else (5,):
        found = nesting.enclosed(lines, F.col("q").isNotNull(), span).collect()
        assert sorted((r.module, r.line_no, r.within, tuple(r.conditions)) for r in found) == want, span


GATES = "node string, op string, width int, hi int, lo int"
OPERANDS = "node string, pos long, operand string, shift int, operand_width int"


def gate_tables(frame, *specs):
    gates = frame(GATES, *[(n, op, w, hi, lo) for n, op, w, hi, lo, _ in specs])
    rows = []
    for n, op, w, hi, lo, ins in specs:
        for i, name in enumerate(ins):
            rows.append((n, i, name, len(ins) - 1 - i, 1))
    return gates, frame(OPERANDS, *rows)


def test_evaluate_operators(frame):
    env = frame("node string, value long", ("a", 1), ("b", 0), ("c", 5), ("d", 3), ("g", (3 << 7) | 5), ("k", 0xF0), ("four", 4), ("one", 1), ("zero", 0), ("u", None))
    specs = [
        ("and", "&", 1, 0, 0, "ab", 0), ("or", "|", 1, 0, 0, "ab", 1), ("not", "~", 1, 0, 0, "b", 1), ("mux1", "?:", 4, 0, 0, "acd", 5),
        ("mux0", "?:", 4, 0, 0, "bcd", 3), ("ne", "!=", 1, 0, 0, "cc", 0), ("eq", "==", 1, 0, 0, "cc", 1), ("cat", "concat", 2, 0, 0, "ab", 2),
        ("add", "+", 4, 0, 0, "cd", 8), ("gt", ">", 1, 0, 0, "cd", 1), ("sub", "-", 4, 0, 0, "cd", 2), ("mul", "*", 4, 0, 0, "cd", 15),
        ("slice", "slice", 4, 2, 1, "c", 2), ("unknown", "&", 1, 0, 0, "bu", None), ("muxu", "?:", 1, 0, 0, "uab", None),
        ("arm", "?:", 1, 0, 0, "acu", 5), ("div0", "/", 4, 0, 0, "cb", 0), ("mod", "%", 4, 0, 0, "cd", 2),
    ]
    gates, operands = gate_tables(frame, *[(n, op, w, hi, lo, list(i)) for n, op, w, hi, lo, i, _ in specs])
    more, inputs = gate_tables(
        frame, ("asr", ">>>", 8, 0, 0, ["k", "four"]), ("g0", "index", 7, 0, 0, ["g", "zero"]), ("g1", "index", 7, 0, 0, ["g", "one"]),
        ("loop", "&", 1, 0, 0, ["loop2", "a"]), ("loop2", "|", 1, 0, 0, ["loop", "b"]), ("held", "reg", 1, 0, 0, ["a"]), ("chain", "~", 1, 0, 0, ["and"]),
    )
    got = {r.node: r.value for r in blame.evaluate(gates.unionByName(more), operands.unionByName(inputs), env).collect()}
    for n, *_, want in specs:
        assert got[n] == want, n
    assert (got["asr"], got["g0"], got["g1"], got["loop"], got["loop2"], got["held"], got["chain"]) == (0xFF, 5, 3, None, None, None, 1)


def test_responsible_and_elements(frame):
    gates, operands = gate_tables(
        frame, ("x", "&", 1, 0, 0, ["a", "b"]), ("y", "|", 1, 0, 0, ["a", "b"]), ("z", "?:", 1, 0, 0, ["c", "p", "q"]),
        ("bank", "concat", 3, 0, 0, ["e2", "e1", "e0"]), ("r", "index", 1, 0, 0, ["bank", "i"]),
    )
    env = frame("node string, value long", ("a", 1), ("b", 0), ("c", 1), ("p", 4), ("q", 9), ("e2", 0), ("e1", 1), ("e0", 0), ("i", 1))
    values = blame.evaluate(gates, operands, env)
    got = bag(blame.responsible(gates, operands, values).where("node in ('x', 'y', 'z')"), "node", "operand")
    assert got == [("x", "b"), ("y", "a"), ("z", "c"), ("z", "p")]
    edges = blame.blame_edges(gates, operands, values)
    assert bag(edges.where("node = 'r'"), "operand") == [("e1",), ("i",)]


def test_digest_follows_a_telling_value(frame):
    chain = frame(
        "root string, depth int, node string, via string, parent string, value long, last_change long, module string, ref string",
        ("r", 0, "rob.out", "root", None, 77, 50, "", None), ("r", 1, "rob._GEN_1", "", "rob.out", 77, 50, "", None),
        ("r", 1, "rob.named", "", "rob.out", 77, 50, "", None), ("r", 1, "fpu.valid", "", "rob.out", 0, 50, "", None),
        ("r", 2, "alu.a", "", "rob.named", 3, 40, "", None), ("r", 2, "fpu.b", "", "fpu.valid", 4, 41, "", None),
    )
    assert bag(blame.chain_digest(chain), "depth", "node") == [(0, "rob.out"), (1, "rob.named"), (2, "alu.a")]
    control = chain.withColumn("value", F.when(F.col("depth") == 0, 0).otherwise(F.col("value")))
    assert bag(blame.chain_digest(control), "depth", "node")[2] == (2, "fpu.b")


def test_closure_ends_cycles(frame):
    bases = frame(
        "name string, base string, seq int", ("Alu", "Unit", 1), ("Unit", "Abstract", 2), ("Abstract", "Module", 3), ("Io", "Bundle", 4),
        ("A", "B", 5), ("B", "A", 6), ("Lost", "Nowhere", 7), ("Alu", "Bundle", 8),
    )
    got = dict(bag(graph.module_closure(bases)))
    assert got == {"Alu": True, "Unit": True, "Abstract": True, "Io": False, "A": False, "B": False, "Lost": False}


TEXT = "val a = b\nval c = Mux(x, y, z)\nval d = RegNext(c)\nval e = a"


def test_proposals(frame):
    texts = frame("run_id string, file string, text string", ("r", "f", TEXT))
    edits = frame("run_id string, file string, old string, new string", *[
        ("r", "f", o, n) for o, n in [("RegNext(c)", "c"), ("RegNxt(c)", "c"), ("val", "def"), ("Mux(x", "Mux(x")]
    ])
    got = {r.old: (r.status, r.line_no) for r in evidence.validate_proposals(edits, texts).collect()}
    assert got == {"RegNext(c)": ("registered", 3), "RegNxt(c)": ("no match", None), "val": ("4 matches", None), "Mux(x": ("no-op", None)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("cutoff", [0.3, 0.5, 0.6, 0.7, 0.8, 0.95])
def test_nearest_lines_are_those_of_all_pairs(frame, cutoff):
    rng = random.Random(3)
    pool = ["".join(rng.choice("abc ()=") for _ in range(rng.randrange(1, 30))).strip() or "x" for _ in range(90)]
    pool += pool[:5] + ["val c = Mux(x, y, z)", "val d = RegNext(c)", "aaaaaaaaaaaa", "aaaaaaaaaaab", "é" * 9]
    probes = [pool[0] + "x", "val c = Mux(x, y)", "zzzz", pool[7][2:], pool[3], "aaaaaaaaaaaaa", "a", "ab", "é" * 8, *(p[:4] + p[5:] for p in pool[10:40])]
    texts = frame("run_id string, file string, text string", ("r", "f", "\n".join(pool)), ("r", "g", "val c = Mux(x, y)"))
    asked = frame("run_id string, file string, probe string", *[("r", "f", p) for p in probes])
    got = evidence.nearest_lines(asked, evidence.split_lines(texts, 1), 3, cutoff).collect()
    for p in {p for p in probes if p}:
        near = sorted(((1 - edits(p, x) / max(len(p), len(x)), x) for x in set(pool)), reverse=True)
        want, room = [], 3
        for s, x in near:
            if s >= cutoff and room > 0:
                want.append((x, pytest.approx(s), min(room, pool.count(x))))
                room -= pool.count(x)
        have = sorted(((r.line, r.similarity, r.places) for r in got if r.probe == p), key=lambda r: (-r[1], [-ord(c) for c in r[0]]))
        assert sorted(have) == sorted(want, key=lambda w: w[0]), (cutoff, p)


def test_grep_context_and_flag(frame):
    texts = frame("run_id string, file string, text string", ("r", "f", "\n".join(["x", "hit", "hit", "y"])))
    lines = evidence.split_lines(texts)
    got = evidence.grep(lines, "hit", context=1, limit=10)
    assert bag(got, "match", "line_no") == [(1, 0), (1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]
    assert {r.truncated for r in got.collect()} == {False}
    assert {r.truncated for r in evidence.grep(lines, "hit", limit=1).collect()} == {True}
    assert {r.truncated for r in evidence.grep(lines, "hit", limit=2).collect()} == {False}


def test_token_sites_take_whole_tokens(frame):
    src = "when (a === b && c < d) { x := y << 2; z <> w; q <= r }\nio.out.fire()  && io.fired"
    texts = frame("path string, text string", ("f", src))
    got = sites.token_sites(texts).collect()
    assert sorted((r.before, r.after) for r in got) == [("&&", "||"), ("&&", "||"), ("<", "<="), ("<=", "<"), ("===", "=/=")]
    assert all(src[r.start : r.end] == r.before for r in got)
    fires = sites.constant_sites(texts).collect()
    assert [(r.before, r.after, r.line, r.col) for r in fires] == [(".fire()", ".valid", 2, 7)]


def test_draw_ignores_input_order(spark, frame):
    pool = spark.range(300).select(F.col("id").alias("key"), F.concat(F.lit("c"), F.col("id") % 7).alias("cls"))
    pool = pool.where("cls <> 'c6' or key < 20")
    one = bag(sites.class_balanced(pool, 5, 1))
    assert one == bag(sites.class_balanced(pool.orderBy(F.rand(4)).repartition(7), 5, 1))
    assert one != bag(sites.class_balanced(pool, 5, 2))
    assert sum(1 for _, c in one if c == "c6") == 2


def test_screen_order(frame):
    runs = frame(
        "mutant string, ladder_pos int, oracle_active boolean, diverged boolean, asserted boolean, timed_out boolean, passed boolean",
        ("a", 1, True, False, True, False, False), ("a", 2, True, True, False, False, False), ("b", 1, False, False, False, False, True),
        ("c", 1, True, False, False, False, True), ("d", 1, False, False, True, False, False), ("d", 2, False, False, True, False, False),
        ("e", 1, True, False, False, False, True), ("e", 2, True, False, False, False, False),
    )
    assert bag(outcome.screen_verdict(runs), "mutant", "verdict", "kill_kind", "stimulus") == [
        ("a", "killed", "divergence", 2), ("b", "invalid", None, None), ("c", "survived", None, None),
        ("d", "killed", "assertion", 1), ("e", "killed", "crash", 2),
    ]


def test_window_reaches_the_hang(frame):
    commits = frame("run_id string, seq long, cycle long, pc long", *[("h", i, i * 2, i % 4) for i in range(700)], *[("d", i, i, 9) for i in range(10)])
    kinds = frame("run_id string, kind string", ("h", "assertion"), ("d", "divergence"))
    got = {r.run_id: r for r in outcome.plan_window(commits, kinds).collect()}
    assert (got["h"].anchor_seq, got["h"].occurrence, got["h"].cycles) == (187, 47, 1024 + 8192 + 1024)
    assert (got["d"].anchor_seq, got["d"].occurrence, got["d"].cycles) == (0, 1, 512)


def test_lost_rows_are_no_failures(frame):
    rows = frame("task int, arm string, stop string, verdict string", (1, "x", None, "fixed"), (1, "x", "error", "not-fixed"), (2, "x", "done", "lost"), (3, "x", None, None))
    assert study.scored(rows).count() == 2


def test_permutation_baseline_by_brute_force(frame):
    import random

    rng = random.Random(5)
    named = {t: {f"f{rng.randrange(6)}" for _ in range(rng.randrange(0, 4))} for t in range(25)}
    bug = {t: f"f{rng.randrange(6)}" for t in named}
    n = frame("task int, item string", *[(t, f) for t, fs in named.items() for f in fs])
    b = frame("task int, item string", *bug.items())
    got = study.localization(n, b).first()
    pairs = [bug[i] in named[j] for i in bug for j in named if i != j]
    assert got.hits == sum(bug[t] in named[t] for t in bug)
    assert got.permuted == pytest.approx(sum(pairs) / len(pairs))


def mixed_weight(rep, key):
    """Poisson weight of a row, one step after the other."""
    mask = 0xFFFFFFFF
    x = (rep * 2654435761 + key * 40503) & mask
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 0x45D9F3B) & mask
    u = ((x ^ (x >> 16)) >> 16) / 65536
    upto, term, k = 0.0, math.exp(-1), 0
    while True:
        upto += term
        if u < round(upto * 65536) / 65536:
            return k
        k += 1
        term /= k


def test_bootstrap_agrees_with_a_loop(frame):
    values = {3: 0.0, 8: 0.25, 9: 0.5, 12: 1.0, 40: 1.0, 41: 0.125}
    groups = {1: values, 2: {7: 0.5}, 3: {k: -v - 4e8 for k, v in values.items()}}
    df = frame("g int, task int, v double", *[(g, k, v) for g, rows in groups.items() for k, v in rows.items()]).repartition(4)
    got = {r.g: (r.v_lo, r.v_hi) for r in bootstrap_ci(df, ["g"], "task", ["v"], reps=1000).collect()}
    for g, rows in groups.items():
        means = []
        for rep in range(1000):
            w = {k: mixed_weight(rep, k) for k in rows}
            # a replicate without weight stands for the rows as they are
            w = w if sum(w.values()) else dict.fromkeys(rows, 1)
            means.append(sum(w[k] * v for k, v in rows.items()) / sum(w.values()))
        means.sort()
        assert got[g] == (pytest.approx(means[25]), pytest.approx(means[975])), g


def test_weighted_sums_are_whole():
    keys = np.arange(10_000)
    values = np.array([keys * 10**11 - 3 * 10**14, np.where(keys % 2, -1, 1)], np.int64)
    got = weighted_sums(keys, values, 7)
    for rep in (0, 6):
        w = [mixed_weight(rep, int(k)) for k in keys]
        assert got[:, rep].tolist() == [sum(w), *(sum(a * int(v) for a, v in zip(w, row)) for row in values)]
    assert abs(got[0].mean() - 10_000) < 300


def test_bootstrap_of_nothing(frame):
    assert bootstrap_ci(frame("g int, task int, v double"), ["g"], "task", ["v"], reps=100).collect() == []


def test_follow_queue(spark, tmp_path):
    """Each step is a restart: late tasks, late verdicts, cells proposed again."""
    import json

    from hindsight.streaming.queue import follow_queue

    schema = "task string, arm string, seed long, note string"
    folders = {n: tmp_path / n for n in ("proposals", "verified", "tasks")}
    for folder in folders.values():
        folder.mkdir()

    def step(number, **arrived):
        for name, rows in arrived.items():
            (folders[name] / f"{number}.json").write_text("\n".join(map(json.dumps, rows)))
        query = follow_queue(
            spark, str(folders["proposals"]), schema, str(folders["verified"]), "task string, arm string, seed long", str(folders["tasks"]),
            str(tmp_path / "o"), str(tmp_path / "c"),
        )
        query.awaitTermination()
        return bag(spark.read.schema(schema).json(str(tmp_path / "o")), "task", "seed")

    cell = lambda task, seed, **more: {"task": task, "arm": "x", "seed": seed} | more
    wanted = [cell(t, s, note=f"{t}{s}") for t in ("a", "b") for s in (1, 2)]
    assert step(1, proposals=wanted, verified=[cell("a", 1)], tasks=[{"task": "a"}]) == [("a", 2)]
    # a task that comes late releases what waited, but for the cell that has a verdict by now
    assert step(2, verified=[cell("b", 1)], tasks=[{"task": "b"}]) == [("a", 2), ("b", 2)]
    # a verdict after the fact changes nothing, and no cell is queued twice
    assert step(3, verified=[cell("a", 2)], proposals=[cell("a", 2, note="again"), cell("a", 3), cell("c", 1)]) == [("a", 2), ("a", 3), ("b", 2)]
    assert step(4, tasks=[{"task": "c"}]) == [("a", 2), ("a", 3), ("b", 2), ("c", 1)]
    assert step(5) == [("a", 2), ("a", 3), ("b", 2), ("c", 1)]


def test_blame_fields_and_scores(frame):
    from hindsight.operators import score

    rows = frame(
        "answer string, true_module string, true_before string, true_context string, true_cycle long",
        ("Module: the Rob unit\nSIGNAL: com_idx\nCYCLE: 1,234\nCYCLE: 9", "Rob", "rob_tail", "val com_idx = Mux(a, rob_tail)", 1200),
        ("MODULE: RobIo\nSIGNAL: io val\nCYCLE: 161", "Rob", "io", "val io = x", 353), ("no idea", "Rob", "", "", None),
        ("MODULE: UNKNOWN\nSIGNAL: n/a\nCYCLE: UNKNOWN", "Rob", "a", "a", 5),
    )
    got = [tuple(r) for r in score.score_blame(rows).select("module_hit", "signal_hit", "cycle_hit", "answered").collect()]
    assert got == [(True, True, True, True), (False, False, False, True), (False, False, False, False), (False, False, False, False)]
    assert [r[0] for r in rows.select(score.cycle_any_base(F.col("answer"), F.col("true_cycle"))).collect()] == [False, True, False, False]


def test_evaluation_says_what_it_cannot_hold(frame):
    """64-bit gates, overflowing shifts and recorded values of 2^63 and above are NULL with a reason; long chains settle."""
    top = 2**63 - 1
    env = [("one", 1), ("three", 3), ("seventy", 70), ("zero", 0), ("big", 2**63), ("odd", 2**53 + 1), ("top", top), ("sixty", 60)]
    env = frame("node string, value decimal(20,0)", *[(n, Decimal(v)) for n, v in env])
    gates, operands = gate_tables(
        frame, ("not64", "~", 64, 0, 0, ["zero"]), ("not63", "~", 63, 0, 0, ["zero"]), ("far", "<<", 63, 0, 0, ["three", "seventy"]), ("near", "<<", 63, 0, 0, ["three", "sixty"]),
        ("nil", "<<", 63, 0, 0, ["zero", "seventy"]), ("quotient", "/", 63, 0, 0, ["odd", "one"]), ("sum", "+", 63, 0, 0, ["top", "one"]), ("reads", "&&", 1, 0, 0, ["big", "one"]),
        ("gone", ">>", 63, 0, 0, ["top", "seventy"]), ("a", "&", 1, 0, 0, ["b", "one"]), ("b", "&", 1, 0, 0, ["a", "one"]),
        ("s0", "~", 1, 0, 0, ["zero"]), *[(f"s{i}", "~", 1, 0, 0, [f"s{i - 1}"]) for i in range(1, 9)],
    )
    wide = frame(GATES, ("cat", "concat", 65, 0, 0), ("cat0", "concat", 65, 0, 0))
    parts = frame(OPERANDS, ("cat", 0, "one", 64, 1), ("cat", 1, "zero", 0, 64), ("cat0", 0, "zero", 64, 1), ("cat0", 1, "three", 0, 63))
    got = {r.node: (r.value, r.reason) for r in blame.evaluate(gates.unionByName(wide), operands.unionByName(parts), env).collect()}
    assert got["not64"] == (None, "wide") and got["not63"] == (top, None)
    assert got["far"][0] is None and got["near"][0] == 3 << 60 and got["nil"] == (0, None)
    assert got["quotient"] == (2**53 + 1, None) and got["sum"][0] is None and got["gone"] == (0, None)
    assert got["big"] == (None, "wide") and got["reads"] == (None, "unknown") and got["a"] == got["b"] == (None, "loop")
    assert got["cat"] == (None, "wide") and got["cat0"] == (3, None)
    assert got["s8"] == (1, None)


def test_paths_end_on_a_cycle_of_parents(frame):
    nodes = frame("id long, parent long, name string, module string", (1, None, "top", "T"), (2, 1, "a", "A"), (3, 2, "b", "B"), (7, 8, "x", "X"), (8, 7, "y", "Y"), (9, 8, "z", "Z"))
    got = bag(graph.instance_paths(nodes), "id", "path")
    assert got == [(1, "top"), (2, "top.a"), (3, "top.a.b"), (7, None), (8, None), (9, None)]


def test_errors_that_must_fire(frame):
    roots, dep = frame("root string, node string", ("a", "a"), ("z", "z")), frame("node string, operand string, via string", ("a", "b", "data"))
    steps = graph.backward_slice(roots, dep)
    with pytest.raises(ValueError, match="nothing drives z"):
        graph.require_drivers(roots, steps)
    assert graph.require_drivers(roots.where("root = 'a'"), steps.where("root = 'a'")).count() == 2
    with pytest.raises(ValueError, match="no site for task t2"):
        sites.require_rederived(frame("task string, mutant_id string", ("t1", "x"), ("t2", None)))
    runs = "stimulus string, passed boolean, oracle_active boolean"
    with pytest.raises(ValueError, match="s2"):
        outcome.require_clean_baseline(frame(runs, ("s1", True, True), ("s2", True, False)))
    outcome.require_clean_baseline(frame(runs, ("s1", True, True)))


def test_ledger_round_trip(spark, frame, tmp_path):
    rows = frame("task string, n long", ("a", 1), ("b", None))
    ledger.append_ledger(rows, str(tmp_path / "led"))
    ledger.append_ledger(rows, str(tmp_path / "led"))
    back = ledger.read_ledger(spark, str(tmp_path / "led"), rows.schema)
    assert bag(back, "task", "n") == [("a", 1), ("a", 1), ("b", None), ("b", None)] and back.select("file").distinct().count() >= 2
    ledger.write_summary(rows.groupBy().count(), str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).first()["count"] == 2


def test_queue_retries_what_waited(spark, frame, tmp_path):
    """A proposal whose task comes later is queued with the batch after it."""
    folder = {k: str(tmp_path / k) for k in ("in", "done", "out", "check", "tasks")}
    schema = "task string, arm string, seed long, patch string"
    frame(schema, ("none", "a", 1, "x")).where("false").write.json(folder["done"])
    frame("task string", "t1").write.json(folder["tasks"])
    frame(schema, ("t1", "a", 1, "p"), ("t2", "a", 1, "q")).coalesce(1).write.mode("append").json(folder["in"])

    def follow():
        queue.follow_queue(spark, folder["in"], schema, folder["done"], schema, folder["tasks"], folder["out"], folder["check"]).awaitTermination()
        return bag(spark.read.schema(schema).json(folder["out"]), "task", "patch")

    assert follow() == [("t1", "p")]
    frame("task string", "t2").write.mode("append").json(folder["tasks"])
    frame(schema, ("t1", "b", 1, "r")).coalesce(1).write.mode("append").json(folder["in"])
    assert follow() == [("t1", "p"), ("t1", "r"), ("t2", "q")]


def plain_sites(text, rules):
    out = []
    for pattern, after, operator, cls in rules:
        for m in re.finditer(pattern, text):
            line = text.count("\n", 0, m.start()) + 1
            col = m.start() - (text.rfind("\n", 0, m.start()) + 1) + 1
            out.append((m.start(), m.end(), m[0], after, operator, cls, line, col, text.split("\n")[line - 1].strip()))
    return out


def test_sites_like_a_loop(frame):
    rng = random.Random(5)
    parts = [".fire", ".fire()", ".fire(", ".firex", "+ 1.U", "+\n1.U", "-\n\n 1.U", "-1.U", "true.B", "xtrue.B", "false.B_", "false.B", "\n", " ", "\t", "é", "a<=b", "==="]
    texts = {f"f{i}": "".join(rng.choices(parts, k=rng.randrange(60))) for i in range(20)} | {"empty": "", "lf": "\n+ 1.U\n"}
    got = bag(sites.constant_sites(frame("path string, text string", *texts.items())))
    assert got == sorted((p, *x) for p, t in texts.items() for x in plain_sites(t, sites.CONSTANT_RULES))


def test_a_file_of_many_sites(frame):
    text = "\n".join(f"  a{i} := b + 1.U" for i in range(100_000))
    t0 = time.monotonic()
    got = sites.constant_sites(frame("path string, text string", ("big", text))).agg(F.count("*"), F.max("line"), F.max("start"), F.sum("col"), F.max("context")).first()
    assert tuple(got) == (100_000, 100_000, text.rfind("+"), sum(f"  a{i} := b + 1.U".index("+") + 1 for i in range(100_000)), "a99999 := b + 1.U")
    assert time.monotonic() - t0 < 60


def plain_slice(roots, dep, depth):
    """(root, node, depth, via, parent, truncated), breadth first."""
    out = []
    for root, node in roots:
        seen, frontier = {node: (0, "root", None)}, [node]
        for d in range(1, depth + 1):
            reached = {}
            for p in frontier:
                for _, operand, via in (e for e in dep if e[0] == p):
                    if operand not in seen:
                        reached[operand] = min(reached.get(operand, (p, via)), (p, via))
            seen |= {n: (d, via, p) for n, (p, via) in reached.items()}
            frontier = list(reached)
        more = any(e[0] == p and e[1] not in seen for p in frontier for e in dep)
        out += [(root, n, *x, more) for n, x in seen.items()]
    return sorted(out, key=order)


@pytest.mark.parametrize("depth", [1, 2, 8])
@pytest.mark.parametrize("hot", [1_000_000, 2])
def test_slices_like_a_loop(frame, depth, hot):
    """Also where a hub's operands are dealt to several tasks, on cycles and where depth ends the walk."""
    rng = random.Random(depth)
    names = [f"n{i}" for i in range(25)]
    dep = sorted({(rng.choice(names), rng.choice(names[:9] if rng.random() < 0.5 else names), rng.choice(["data", "control"])) for _ in range(45)})
    roots = [(f"r{i}", rng.choice(names)) for i in range(12)] + [("lone", "nothing")]
    got = graph.backward_slice(frame("root string, node string", *roots), frame("node string, operand string, via string", *dep), depth, hot=hot)
    assert bag(got, "root", "node", "depth", "via", "parent", "truncated") == plain_slice(roots, dep, depth)
    capped = graph.cap_nodes(got, 4)
    flags = {r.root: r.truncated for r in capped.collect()}
    sizes = {}
    for root, *_, more in plain_slice(roots, dep, depth):
        sizes[root] = (sizes.get(root, (0, False))[0] + 1, more)
    assert flags == {root: n > 4 or more for root, (n, more) in sizes.items()}


def test_buckets_are_read_without_a_shuffle(spark, frame, capsys):
    from hindsight.session import Bucketed

    table = Bucketed(spark, ["k"])
    assert table.append(frame("k long, v long", *[(i % 7, i) for i in range(50)])) == 50
    assert table.append(frame("k long, v long", (1, 100))) == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame("k long, w long", (1, 2)).join(table.table(), "k").explain()
        assert capsys.readouterr().out.count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert bag(table.table(1)) == [(1, 100)]
    rows = table.rows()
    table.drop()
    assert rows.count() == 51 and not spark.catalog.tableExists(table.name)
