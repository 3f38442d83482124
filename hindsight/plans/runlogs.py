"""Run logs rendered from ``lineitem``: a supplier is a run, a line item a commit.

The queries parse the text back; the SQL works on the columns it was made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.operators import outcome
from hindsight.operators.ordered import position
from hindsight.plans.registry import query, table
from hindsight.sources import runlog

ORDER = [
    "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate",
]

SQL = """
WITH c AS (
  SELECT *, l_suppkey AS run_id, CAST(round(l_tax * 100) AS INTEGER) AS tax, CAST(round(l_discount * 100) AS INTEGER) AS disc,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice,
           l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS seq FROM lineitem),
commits AS (
  SELECT run_id, seq, 4 * seq + 10 AS line_no, CASE WHEN disc <> 3 THEN 10 * seq + l_linenumber END AS cycle,
         CASE l_linestatus WHEN 'F' THEN 3 ELSE 0 END AS priv, 2147483648 + l_partkey * 4 AS pc, l_orderkey AS insn,
         CASE WHEN l_returnflag <> 'N' THEN CASE l_linenumber WHEN 7 THEN 'f' ELSE 'x' END END AS regfile,
         CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS rd, CASE WHEN l_returnflag <> 'N' THEN cents END AS wdata FROM c),
mm0 AS (SELECT *, 4 * seq + 11 AS line_no, CASE l_linenumber % 3 WHEN 0 THEN 'pc' WHEN 1 THEN 'wdata' ELSE 'unknown' END AS kind,
               printf('%x', 10 * seq) AS token FROM c WHERE tax = 8 AND disc = 10),
mm AS (
  SELECT run_id, line_no, kind,
         CASE kind WHEN 'pc' THEN 'Cosim: ' || token || ' PC mismatch spike ' || printf('%x', l_partkey) || ' != DUT ' || printf('%x', l_orderkey)
           WHEN 'wdata' THEN 'Cosim: ' || token || ' wdata mismatch reg ' || l_linenumber || ' ' || printf('%x', cents) || ' != ' || printf('%x', l_orderkey)
           ELSE 'odd wdata mismatch near ' || l_orderkey END AS line,
         CASE kind WHEN 'pc' THEN '0x' || printf('%x', l_partkey) WHEN 'wdata' THEN '0x' || printf('%x', cents) END AS spike,
         CASE WHEN kind <> 'unknown' THEN '0x' || printf('%x', l_orderkey) END AS dut,
         CASE kind WHEN 'wdata' THEN l_linenumber END AS reg, CASE WHEN kind <> 'unknown' THEN token END AS cycle_token,
         CASE WHEN kind <> 'unknown' THEN 10 * seq END AS cycle_hex,
         CASE WHEN kind <> 'unknown' AND regexp_full_match(token, '[0-9]+') THEN CAST(token AS BIGINT) END AS cycle_dec
  FROM mm0),
div AS (SELECT * FROM mm QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_no) = 1),
asr AS (
  SELECT run_id, 4 * seq + 11 AS line_no, 'Assertion failed: Pipeline ' || l_partkey || ' has hung.' AS message,
         CASE WHEN l_linenumber <> 3 THEN 'core' || l_linenumber || '.scala:' || l_partkey END AS src,
         CASE WHEN l_linenumber <> 3 THEN 'assert (idle ' || l_orderkey || ')' END AS expr FROM c WHERE tax = 7 AND disc = 9),
flags AS (
  SELECT s_suppkey AS run_id, s_suppkey % 5 <> 0 AS oracle_active, EXISTS (SELECT 1 FROM mm WHERE mm.run_id = s_suppkey) AS diverged,
         EXISTS (SELECT 1 FROM asr WHERE asr.run_id = s_suppkey) AS asserted, s_suppkey % 11 = 0 AS timed_out,
         CASE WHEN s_suppkey % 3 = 0 THEN 1000 + s_suppkey END AS sim_cycles,
         (SELECT count(*) FROM c WHERE c.run_id = s_suppkey) AS commits, CASE WHEN s_nationkey % 3 = 0 THEN 1 ELSE 0 END AS rc FROM supplier),
finding AS (
  SELECT run_id, line_no, kind, cycle_dec AS cycle, spike, dut, reg, line AS raw FROM div
  UNION ALL SELECT run_id, line_no, 'assertion', NULL, src, NULL, NULL, message FROM asr)
"""


def sequenced(spark, folder) -> DataFrame:
    li = table(spark, folder, "lineitem").withColumn("run_id", F.col("l_suppkey"))
    numbered = position(li, ["run_id"], ORDER, 1 << 20, "n")
    pct = lambda c: F.round(F.col(c) * 100)
    return numbered.select(
        "*", (F.col("n") - 1).alias("seq"), pct("l_tax").cast("int").alias("tax"), pct("l_discount").cast("int").alias("disc"),
        pct("l_extendedprice").cast("long").alias("cents"),
    )


def log_lines(spark, folder) -> DataFrame:
    """(run_id, line_no, text)"""
    rows = sequenced(spark, folder)
    hexed = lambda c: F.lower(F.hex(c))
    wide = lambda c, n: F.concat(F.lit("0x"), F.lpad(hexed(c), n, "0"))
    cycle = F.col("seq") * 10 + F.col("l_linenumber")
    prefix = F.when(F.col("disc") == 3, "").otherwise(F.concat(F.lit("C"), F.lpad(cycle.cast("string"), 20, " "), F.lit(": ")))
    reg = F.concat(F.when(F.col("l_linenumber") == 7, "f").otherwise("x"), F.lpad(F.col("l_linenumber").cast("string"), 2, " "))
    body = F.when(F.col("l_returnflag") == "N", "sd      t3, -64(t5)").otherwise(
        F.concat(F.lit("auipc   a0, 0x0 "), reg, F.lit(" "), wide(F.col("cents"), 16))
    )
    commit = F.concat(
        prefix, F.when(F.col("l_linestatus") == "F", "3").otherwise("0"), F.lit(" "),
        wide(F.col("l_partkey") * 4 + 2147483648, 16), F.lit(" ("), wide(F.col("l_orderkey"), 8), F.lit(") "), body,
    )
    token, third = hexed(F.col("seq") * 10), F.col("l_linenumber") % 3
    mismatch = (
        F.when(third == 0, F.concat(F.lit("Cosim: "), token, F.lit(" PC mismatch spike "), hexed("l_partkey"), F.lit(" != DUT "), hexed("l_orderkey")))
        .when(third == 1, F.concat(F.lit("Cosim: "), token, F.lit(" wdata mismatch reg "), "l_linenumber", F.lit(" "), hexed("cents"), F.lit(" != "), hexed("l_orderkey")))
        .otherwise(F.concat(F.lit("odd wdata mismatch near "), "l_orderkey"))
    )
    hung = (F.col("tax") == 7) & (F.col("disc") == 9)
    second = F.when((F.col("tax") == 8) & (F.col("disc") == 10), mismatch).when(hung, F.concat(
        F.lit("[123] %Error: core.sv:9: Assertion failed in top.core: Assertion failed: Pipeline "), "l_partkey", F.lit(" has hung.")
    ))
    third_line = F.when(hung & (F.col("l_linenumber") != 3), F.concat(
        F.lit("    at core"), "l_linenumber", F.lit(".scala:"), "l_partkey", F.lit(" assert (idle "), "l_orderkey", F.lit(")")
    ))
    at = lambda i, t: F.struct((F.col("seq") * 4 + 10 + i).alias("line_no"), t.alias("text"))
    steps = rows.select("run_id", F.inline(F.array(at(0, commit), at(1, second), at(2, third_line))))
    key = F.col("s_suppkey")
    own = lambda i, t: F.struct(F.lit(i).cast("long").alias("line_no"), t.alias("text"))
    ends = table(spark, folder, "supplier").select(key.alias("run_id"), F.inline(F.array(
        own(1, F.when(key % 5 != 0, "Cosim: Configuring spike cosim")),
        own(2, F.when(key % 11 == 0, "*** FAILED *** (timeout) gave up")),
        own(3, F.when(key % 3 == 0, F.concat(F.lit("Completed after "), key + 1000, F.lit(" simulation cycles")))),
    )))
    return steps.unionByName(ends).where("text IS NOT NULL")


def golden(spark, folder) -> DataFrame:
    off = F.col("l_orderkey") % 97 == 0
    g = sequenced(spark, folder)
    pc = F.col("l_partkey") * 4 + 2147483648 + F.when(off & (F.col("l_linenumber") < 4), 4).otherwise(0)
    wdata = F.when(F.col("l_returnflag") != "N", F.col("cents") + F.when(off & (F.col("l_linenumber") >= 4), 1).otherwise(0))
    return g.select("run_id", "seq", pc.alias("pc"), wdata.alias("wdata"))


def commit_rows(spark, folder) -> DataFrame:
    parsed = runlog.parse_commits(log_lines(spark, folder))
    long = [F.col(c).cast("long").alias(c) for c in ("pc", "insn", "wdata")]
    return parsed.select("run_id", "line_no", F.floor((F.col("line_no") - 10) / 4).alias("seq"), "cycle", "priv", "regfile", "rd", *long)


@query("A13_parse_commit_log", SQL + "SELECT run_id, line_no, cycle, priv, pc, insn, regfile, rd, wdata FROM commits")
def a13(spark, folder):
    return commit_rows(spark, folder).drop("seq")


@query("A14_parse_divergence", SQL + "SELECT * FROM div")
def a14(spark, folder):
    return runlog.parse_divergence(log_lines(spark, folder))


@query("A15_parse_assertion", SQL + "SELECT * FROM asr")
def a15(spark, folder):
    return runlog.parse_assertions(log_lines(spark, folder))


@query("A16_run_flags", SQL + """
SELECT run_id, oracle_active, diverged, asserted, timed_out, sim_cycles, commits,
       rc = 0 AND NOT diverged AND NOT asserted AND NOT timed_out AND oracle_active AS passed FROM flags
""")
def a16(spark, folder):
    rc = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("run_id"), F.when(F.col("s_nationkey") % 3 == 0, 1).otherwise(0).alias("rc")
    )
    flags = runlog.run_flags(log_lines(spark, folder)).join(rc, "run_id")
    return flags.withColumn("passed", runlog.passed(F.col("rc"), F.lit(True))).drop("rc")


LOCATORS = """
WITH d AS (SELECT *, 'M' || (p_partkey % 20) AS module, 'p_' || (p_partkey % 50) AS signal FROM part),
refs AS (
  SELECT module, p_partkey AS line_no, signal, unnest(CASE WHEN p_size % 5 = 0 THEN
     [{'ref_no': 0, 'file': 'gen/c.scala', 'line': p_size, 'col': 2}]
   ELSE [{'ref_no': 0, 'file': 'a' || (p_size % 3) || '.scala', 'line': p_size, 'col': 3}, {'ref_no': 1, 'file': 'a' || (p_size % 3) || '.scala', 'line': p_size + 1, 'col': 9},
         {'ref_no': 2, 'file': 'x-y/b.scala', 'line': 4, 'col': 1}, {'ref_no': 3, 'file': 'x-y/b.scala', 'line': 4, 'col': 2},
         {'ref_no': 4, 'file': 'x-y/b.scala', 'line': 77, 'col': NULL}] END) AS r FROM d)
"""


def declared(spark, folder) -> DataFrame:
    """(module, line_no, text): one declaration per part."""
    s, k = F.col("p_size"), F.col("p_partkey")
    refs = F.when(s % 5 == 0, F.concat(F.lit(":7:1, gen/c.scala:"), s, F.lit(":2"))).otherwise(
        F.concat(F.lit("a"), s % 3, F.lit(".scala:"), s, F.lit(":3, :"), s + 1, F.lit(":9, x-y/b.scala:4:{1,2}, :77"))
    )
    text = F.concat(F.lit("  wire [7:0]  p_"), k % 50, F.lit(";\t// @["), refs, F.lit("]"))
    return table(spark, folder, "part").select(F.concat(F.lit("M"), k % 20).alias("module"), k.alias("line_no"), text.alias("text"))


@query("A17_parse_locators", LOCATORS + "SELECT module, line_no, r.ref_no, r.file, r.line, r.col FROM refs")
def a17(spark, folder):
    return runlog.parse_locators(declared(spark, folder))


@query("A18_decl_map", LOCATORS + """
, first AS (SELECT module, signal, min(line_no) AS line_no FROM refs GROUP BY ALL)
SELECT module, signal, r.file, r.line, r.col FROM refs SEMI JOIN first USING (module, signal, line_no)
""")
def a18(spark, folder):
    return runlog.declarations(declared(spark, folder))


@query("B03_first_divergence", SQL + """
SELECT run_id, line_no, kind, cycle, spike, dut, reg, raw, rank, truncated FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY cycle ASC NULLS LAST, line_no) AS INTEGER) AS rank,
         count(*) OVER (PARTITION BY run_id) > 10 AS truncated FROM finding) WHERE rank <= 10
""")
def b03(spark, folder):
    lines = log_lines(spark, folder)
    found = runlog.findings(runlog.parse_divergence(lines), runlog.parse_assertions(lines))
    return outcome.first_findings(found).drop("tolerated")


@query("B22_lockstep_diff", SQL + """
, g AS (SELECT run_id, seq, 2147483648 + l_partkey * 4 + CASE WHEN l_orderkey % 97 = 0 AND l_linenumber < 4 THEN 4 ELSE 0 END AS g_pc,
               CASE WHEN l_returnflag <> 'N' THEN cents + CASE WHEN l_orderkey % 97 = 0 AND l_linenumber >= 4 THEN 1 ELSE 0 END END AS g_wdata FROM c),
b AS (SELECT run_id, seq, CASE WHEN pc IS DISTINCT FROM g_pc THEN 'pc' WHEN wdata IS DISTINCT FROM g_wdata THEN 'wdata' END AS kind,
             pc, g_pc, wdata, g_wdata FROM commits FULL JOIN g USING (run_id, seq))
SELECT *, count(*) OVER (PARTITION BY run_id) AS mismatches FROM b WHERE kind IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq) = 1
""")
def b22(spark, folder):
    return outcome.lockstep_diff(commit_rows(spark, folder), golden(spark, folder))


STIMULI = """
WITH r AS (SELECT o_orderkey AS run_id, unnest([1, 2, 3, 4, 5, 6, 7])::INTEGER AS stimulus FROM orders),
l AS (SELECT l_orderkey AS run_id, l_linenumber AS stimulus, bool_or(l_returnflag <> 'A') AS oracle,
             bool_or(CAST(round(l_tax * 100) AS INTEGER) = 8) AS diverged, bool_or(CAST(round(l_discount * 100) AS INTEGER) = 10) AS asserted,
             bool_or(l_quantity > 45) AS timed_out FROM lineitem GROUP BY ALL),
o AS (SELECT r.run_id, r.stimulus, CASE WHEN oracle IS NULL THEN 'missing' WHEN NOT oracle THEN 'no-cosim' WHEN diverged THEN 'diverged'
             WHEN asserted THEN 'assertion' WHEN timed_out THEN 'timeout' ELSE 'passed' END AS outcome
      FROM r LEFT JOIN l USING (run_id, stimulus))
"""


def stimulus_lines(spark, folder) -> DataFrame:
    """(run_id, stimulus, line_no, text): an order is a mutant, a line number a stimulus."""
    li = table(spark, folder, "lineitem")
    at = lambda i, cond, t: F.struct(F.lit(i).alias("line_no"), F.when(cond, t).otherwise("quiet").alias("text"))
    return li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stimulus"), F.inline(F.array(
        at(1, F.col("l_returnflag") != "A", "Cosim: isa string: rv64imafdczicsr"),
        at(2, F.round(F.col("l_tax") * 100) == 8, "Cosim: 1c PC mismatch spike 10000 != DUT 0"),
        at(3, F.round(F.col("l_discount") * 100) == 10, "[9] %Error: core.sv:7: Assertion failed: Pipeline has hung."),
        at(4, F.col("l_quantity") > 45, "*** FAILED *** (timeout)"),
    )))


def outcomes(spark, folder) -> DataFrame:
    keys = ["run_id", "stimulus"]
    expected = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("stimulus")
    )
    flags = runlog.run_flags(stimulus_lines(spark, folder), keys).withColumn("found", F.lit(True))
    joined = expected.join(flags, keys, "left")
    return joined.select(*keys, runlog.outcome_of(F.coalesce("found", F.lit(False))).alias("outcome"))


@query("F09_classify_outcome", STIMULI + "SELECT run_id, stimulus, outcome FROM o")
def f09(spark, folder):
    return outcomes(spark, folder)


@query("F14_baseline_passes", STIMULI + """
SELECT run_id AS mutant, count(*) FILTER (outcome = 'passed') AS passed, count(*) AS total,
       coalesce(string_agg(stimulus || ':' || outcome, ', ' ORDER BY stimulus) FILTER (outcome <> 'passed'), '') AS failing FROM o GROUP BY 1
""")
def f14(spark, folder):
    return outcome.baseline_passes(outcomes(spark, folder).withColumnRenamed("run_id", "mutant"))


@query("F14_baseline_range", STIMULI + """
, p AS (SELECT run_id, count(*) FILTER (outcome = 'passed') AS passed, count(*) AS total FROM o GROUP BY 1)
SELECT min(passed) AS least, max(passed) AS most, max(total) AS of FROM p
""")
def f14_range(spark, folder):
    return outcome.baseline_range(outcome.baseline_passes(outcomes(spark, folder).withColumnRenamed("run_id", "mutant")))


@query("F11_divergence_cycle", SQL + "SELECT run_id, arg_max(cycle, seq) AS cycle FROM commits WHERE cycle IS NOT NULL GROUP BY 1")
def f11(spark, folder):
    return outcome.divergence_cycle(commit_rows(spark, folder))


PLAN = SQL + """
, e AS (SELECT run_id, max(seq) AS "end" FROM commits GROUP BY 1),
pl AS (SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'assertion' ELSE 'divergence' END AS kind, "end",
              greatest(0, "end" - CASE WHEN run_id % 2 = 0 THEN 512 ELSE 64 END) AS anchor_seq FROM e),
an AS (SELECT pl.*, a.pc, a.cycle AS anchor_cycle, z.cycle AS failure_cycle FROM pl
       JOIN commits a ON a.run_id = pl.run_id AND a.seq = anchor_seq JOIN commits z ON z.run_id = pl.run_id AND z.seq = pl."end"),
plan AS (
  SELECT run_id, kind, pc, anchor_seq, (SELECT count(*) FROM commits c WHERE c.run_id = an.run_id AND c.pc = an.pc AND c.seq <= anchor_seq) AS occurrence,
         failure_cycle, CAST(CASE kind WHEN 'assertion' THEN greatest(512, CASE WHEN coalesce(failure_cycle, 0) <> 0
           THEN failure_cycle - coalesce(anchor_cycle, failure_cycle) ELSE 0 END + 8192 + 1024) ELSE 512 END AS BIGINT) AS cycles FROM an)
"""


def planned(spark, folder) -> DataFrame:
    kinds = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("run_id"), F.when(F.col("s_suppkey") % 2 == 0, "assertion").otherwise("divergence").alias("kind")
    )
    return outcome.plan_window(commit_rows(spark, folder), kinds)


@query("F12_plan_window", PLAN + "SELECT * FROM plan")
def f12(spark, folder):
    return planned(spark, folder)


WINDOWS = """
WITH w AS (
  SELECT o_orderkey AS run_id, o_custkey AS task, year(o_orderdate) % 3 + 1 AS draw,
         'draw' || (year(o_orderdate) % 3 + 1) || '.jsonl' AS file, CASE o_orderstatus WHEN 'F' THEN 'divergence' ELSE 'assertion' END AS kind,
         o_custkey AS lo, o_custkey + 8190 + CAST(floor(o_totalprice) AS BIGINT) % 7 AS hi, CAST(floor(o_totalprice) AS BIGINT) % 20000 AS failure_cycle,
         o_custkey AS last_commit, o_orderstatus = 'O' AS hung, o_orderpriority LIKE '1%' AS asserted FROM orders),
v AS (SELECT *, coalesce(CASE WHEN kind = 'divergence' THEN failure_cycle BETWEEN lo AND hi WHEN hung THEN abs(hi - (last_commit + 8192)) <= 3 ELSE asserted END, FALSE) AS covered FROM w)
"""


def windows(spark, folder) -> DataFrame:
    draw = F.year("o_orderdate") % 3 + 1
    price = F.floor("o_totalprice")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("task"), draw.alias("draw"),
        F.concat(F.lit("draw"), draw, F.lit(".jsonl")).alias("file"),
        F.when(F.col("o_orderstatus") == "F", "divergence").otherwise("assertion").alias("kind"), F.col("o_custkey").alias("lo"),
        (F.col("o_custkey") + 8190 + price % 7).alias("hi"), (price % 20000).alias("failure_cycle"), F.col("o_custkey").alias("last_commit"),
        (F.col("o_orderstatus") == "O").alias("hung"), F.col("o_orderpriority").startswith("1").alias("asserted"),
    )


@query("F13_verify_windows", WINDOWS + "SELECT run_id, kind, hung, lo, hi, covered FROM v")
def f13(spark, folder):
    return outcome.verify_windows(windows(spark, folder)).select("run_id", "kind", "hung", "lo", "hi", "covered")


@query("G22_window_totals", WINDOWS + """
SELECT CAST(draw AS INTEGER) AS draw, count(*) FILTER (covered) AS ok, count(*) AS n FROM v
WHERE NOT (draw = 3 AND task IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) GROUP BY 1
""")
def g22(spark, folder):
    from hindsight.operators.study import drop_overlap

    dup = table(spark, folder, "customer").where("c_nationkey = 3").select(F.lit("draw3").alias("tag"), F.col("c_custkey").alias("id"))
    return outcome.window_totals(outcome.verify_windows(drop_overlap(windows(spark, folder), dup)))


@query("F18_build_failure_audit", """
WITH li AS (SELECT *, CAST(round(l_tax * 100) AS INTEGER) AS tax FROM lineitem),
err AS (SELECT l_orderkey AS run_id, CASE tax WHEN 0 THEN '/w/src/f' || (l_partkey % 3) || '.scala' WHEN 1 THEN 'f' || (l_partkey % 3) || '.scala'
          ELSE 'rtl/f' || (l_partkey % 3) || '.scala' END AS file, l_linenumber FROM li WHERE tax IN (0, 1, 2)),
fr AS (SELECT l_orderkey AS run_id, arg_min('f' || (l_partkey % 3) || '.scala', (l_linenumber, l_partkey)) AS file FROM li WHERE tax = 3 GROUP BY 1),
e AS (SELECT DISTINCT run_id, file FROM err UNION SELECT run_id, file FROM fr),
p AS (SELECT o_orderkey AS run_id, 'src/f' || (o_custkey % 3) || '.scala' AS path FROM orders),
j AS (SELECT p.run_id, path, count(*) FILTER (file IS NOT NULL AND split_part(file, '/', -1) = split_part(path, '/', -1)) AS own,
             count(*) FILTER (file IS NOT NULL AND split_part(file, '/', -1) <> split_part(path, '/', -1)) AS other FROM p LEFT JOIN e USING (run_id) GROUP BY ALL)
SELECT run_id, path, CASE WHEN run_id NOT IN (SELECT l_orderkey FROM lineitem) THEN 'no-log' WHEN own > 0 AND other = 0 THEN 'own'
       WHEN other > 0 THEN 'contaminated' ELSE 'no-error-line' END AS tag, own, other FROM j
""")
def f18(spark, folder):
    li = table(spark, folder, "lineitem").withColumn("tax", F.round(F.col("l_tax") * 100).cast("int"))
    name = F.concat(F.lit("f"), F.col("l_partkey") % 3, F.lit(".scala"))
    text = (
        F.when(F.col("tax") == 0, F.concat(F.lit("\x1b[31m[error]\x1b[0m /w/src/"), name, F.lit(":12:3: not found")))
        .when(F.col("tax") == 1, F.concat(F.lit("%Error: "), name, F.lit(":44 bad width")))
        .when(F.col("tax") == 2, F.concat(F.lit("rtl/"), name, F.lit(":9:1: error: detected combinational cycle")))
        .when(F.col("tax") == 3, F.concat(F.lit("\tat boom.v3.exu.Core.<init>("), name, F.lit(":215)")))
        .otherwise("compiling")
    )
    logs = li.select(F.col("l_orderkey").alias("run_id"), F.struct("l_linenumber", "l_partkey").alias("line_no"), text.alias("text"))
    patches = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.concat(F.lit("src/f"), F.col("o_custkey") % 3, F.lit(".scala")).alias("path")
    )
    return outcome.build_failure_audit(patches, runlog.build_errors(logs), logs)


LADDER = """
WITH runs AS (
  SELECT l_orderkey AS mutant, l_linenumber AS ladder_pos, l_returnflag <> 'A' OR l_quantity > 10 AS oracle_active,
         CAST(round(l_tax * 100) AS INTEGER) = 8 AS diverged, CAST(round(l_discount * 100) AS INTEGER) = 10 OR l_quantity <= 5 AS asserted,
         l_quantity > 47 AS timed_out, CAST(round(l_tax * 100) AS INTEGER) <> 8 AND CAST(round(l_discount * 100) AS INTEGER) <> 10 AND l_quantity > 5
           AND l_quantity <= 47 AND l_linestatus = 'F' AS passed FROM lineitem)
"""


def ladder(spark, folder) -> DataFrame:
    tax, disc = F.round(F.col("l_tax") * 100).cast("int"), F.round(F.col("l_discount") * 100).cast("int")
    q = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("mutant"), F.col("l_linenumber").alias("ladder_pos"),
        ((F.col("l_returnflag") != "A") | (q > 10)).alias("oracle_active"), (tax == 8).alias("diverged"),
        ((disc == 10) | (q <= 5)).alias("asserted"), (q > 47).alias("timed_out"),
        ((tax != 8) & (disc != 10) & (q > 5) & (q <= 47) & (F.col("l_linestatus") == "F")).alias("passed"),
    )


@query("F10_screen_verdict", LADDER + """
, k AS (SELECT *, CASE WHEN diverged THEN 0 WHEN asserted THEN 1 WHEN timed_out THEN 2 WHEN NOT passed THEN 3 END AS rk FROM runs),
m AS (SELECT mutant, count(*) AS runs, bool_or(NOT oracle_active AND NOT asserted) AS invalid, NOT bool_or(oracle_active) AND NOT bool_or(passed) AS silent,
             min(rk) AS rk, min(rk * 10 + ladder_pos) AS kp, min(ladder_pos) FILTER (NOT passed) AS sp FROM k GROUP BY 1)
SELECT mutant, runs, CASE WHEN invalid THEN 'invalid' WHEN kp IS NOT NULL THEN 'killed' ELSE 'survived' END AS verdict,
       CASE WHEN invalid OR kp IS NULL THEN NULL WHEN silent THEN 'assertion' ELSE ['divergence', 'assertion', 'timeout', 'crash'][rk + 1] END AS kill_kind,
       CASE WHEN invalid OR kp IS NULL THEN NULL WHEN silent THEN sp ELSE kp % 10 END AS stimulus FROM m
""")
def f10(spark, folder):
    return outcome.screen_verdict(ladder(spark, folder))


@query("F15_baseline_gate", LADDER + """
SELECT ladder_pos AS stimulus, count(*) AS violations, count(*) FILTER (NOT oracle_active) AS unchecked FROM runs WHERE NOT passed OR NOT oracle_active GROUP BY 1
""")
def f15(spark, folder):
    return outcome.baseline_violations(ladder(spark, folder).withColumnRenamed("ladder_pos", "stimulus"))


@query("F16_fix_verdict", LADDER + """
, r AS (SELECT l_orderkey AS task, l_linestatus AS arm, l_linenumber AS ladder_pos, l_returnflag <> 'A' OR l_quantity > 10 AS oracle_active,
               l_quantity > 8 AS passed, CASE WHEN l_linenumber > 2 THEN 'bad ' || l_partkey END AS reason FROM lineitem),
w AS (SELECT *, NOT oracle_active OR NOT passed AS bad, CASE WHEN NOT oracle_active THEN 'cosim did not run' ELSE coalesce(reason, 'failed without a stated reason') END AS why FROM r)
SELECT task, arm, CASE WHEN bool_or(bad) THEN 'not-fixed' ELSE 'fixed' END AS verdict,
       min(ladder_pos) FILTER (bad) AS first_failure, arg_min(why, (ladder_pos, why)) FILTER (bad) AS reason,
       count(*) FILTER (passed AND oracle_active) AS passed, count(*) AS total FROM w GROUP BY ALL
""")
def f16(spark, folder):
    runs = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("task"), F.col("l_linestatus").alias("arm"), F.col("l_linenumber").alias("ladder_pos"),
        ((F.col("l_returnflag") != "A") | (F.col("l_quantity") > 10)).alias("oracle_active"), (F.col("l_quantity") > 8).alias("passed"),
        F.when(F.col("l_linenumber") > 2, F.concat(F.lit("bad "), "l_partkey")).alias("reason"),
    )
    return outcome.fix_verdict(runs)
