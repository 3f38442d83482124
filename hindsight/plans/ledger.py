"""Study statistics over an episode ledger made from ``lineitem``.

A supplier is a task, the line status an arm, the line number a seed. Ten-percent
discounts are verified on two machines, so their rows come twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.functions.mixing import mix32_sql
from hindsight.operators import study
from hindsight.operators.resample import bootstrap_ci, weight_sql
from hindsight.plans.registry import query, table

ARMS = ("O", "F")
SPAN = 1 << 16

SQL = """
WITH led0 AS (
  SELECT *, CAST(round(l_tax * 100) AS INTEGER) AS tax, CAST(round(l_discount * 100) AS INTEGER) AS disc,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qty,
         unnest(CASE WHEN round(l_discount * 100) = 10 THEN ['A', 'B'] ELSE ['A'] END) AS copy
  FROM lineitem),
led AS (
  SELECT l_suppkey AS task, l_linestatus AS arm, l_linenumber AS seed, l_orderkey AS episode, l_partkey, disc, tax,
         concat_ws('|', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), l_linenumber, lpad(CAST(l_partkey AS VARCHAR), 12, '0'),
           lpad(CAST(l_suppkey AS VARCHAR), 12, '0'), qty, cents, disc, tax, l_returnflag, l_linestatus,
           year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate), copy) AS eid,
         CASE l_returnflag WHEN 'R' THEN 'fixed' WHEN 'A' THEN CASE WHEN tax = 7 THEN 'build-failed' ELSE 'not-fixed' END
           ELSE CASE WHEN tax = 6 THEN 'lost' ELSE 'no-proposal' END END AS verdict,
         CASE WHEN tax = 8 THEN 'error' WHEN tax >= 4 THEN 'done' END AS stop,
         qty * 1000 AS tokens, qty * 700 AS prompt, qty * disc * 20 AS cached, qty * 200 AS out_tokens, qty * 100 AS thought,
         qty AS queries, cents AS seconds, year(l_shipdate) % 3 + 1 AS draw,
         'episodes-draw' || (year(l_shipdate) % 3 + 1) || '-' || copy || '.jsonl' AS file
  FROM led0),
overlap AS (SELECT 'draw3' AS tag, s_suppkey AS id FROM supplier WHERE s_nationkey = 3),
kept AS (SELECT * FROM led WHERE NOT (draw = 3 AND task IN (SELECT id FROM overlap))),
ok AS (SELECT * FROM kept WHERE coalesce(stop <> 'error', TRUE) AND coalesce(verdict <> 'lost', TRUE)),
ep AS (
  SELECT task, arm, seed, tokens, queries, seconds, arg_min(verdict, eid) AS verdict, arg_min(l_partkey, eid) AS l_partkey,
         arg_min(episode, eid) AS episode, min(eid) AS eid, arg_min(draw, eid) AS draw, arg_min(disc, eid) AS disc,
         arg_min(prompt, eid) AS prompt, arg_min(cached, eid) AS cached, arg_min(out_tokens, eid) AS out_tokens,
         arg_min(thought, eid) AS thought, count(*) AS copies
  FROM ok GROUP BY ALL),
epx AS (
  SELECT e.*, p_size % 3 = 0 AS same_file, p_type AS cls, p_brand AS model,
         CASE WHEN s_nationkey % 2 = 0 THEN 'divergence' ELSE 'assertion' END AS kind
  FROM ep e JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = task),
cells AS (SELECT task, arm, CAST(count(*) FILTER (verdict = 'fixed') / count(*) AS DECIMAL(18,9)) AS rate, count(*) AS n FROM ep GROUP BY ALL),
pairs AS (SELECT o.task, o.rate AS a, f.rate AS b, o.rate - f.rate AS diff FROM cells o JOIN cells f ON o.task = f.task AND o.arm = 'O' AND f.arm = 'F')
"""


def boot(source: str, group: str, cols: str) -> str:
    """SQL of the resampled sums of ``source`` (group, task, cols)."""
    names = [c.strip() for c in cols.split(",")]
    drawn = ", ".join(f"sum(w * {c}) AS {c}" for c in names)
    plain = ", ".join(f"sum({c}) AS {c}" for c in names)
    chosen = ", ".join(f"CASE WHEN d.n = 0 THEN p.{c} ELSE d.{c} END AS {c}" for c in ["n", *names])
    return f"""
, vals AS (SELECT {group} AS grp, task, {cols} FROM {source}),
mixed AS (SELECT v.*, r.rep, {mix32_sql('r.rep', 'task')} >> 16 AS u FROM vals v CROSS JOIN (SELECT unnest(range(10000)) AS rep) r),
weighed AS (SELECT grp, rep, {cols}, {weight_sql('u')} AS w FROM mixed),
drawn AS (SELECT grp, rep, sum(w) AS n, {drawn} FROM weighed GROUP BY grp, rep),
plain AS (SELECT grp, count(*) AS n, {plain} FROM vals GROUP BY grp),
sums AS (SELECT d.grp, d.rep, {chosen} FROM drawn d JOIN plain p ON p.grp = d.grp)
"""


def draws(source: str, group: str, cols: str) -> str:
    """SQL of the sums of ``source`` (group, task, cols) resampled with replacement."""
    sums = ", ".join(f"sum(v.{c.strip()}) AS {c.strip()}" for c in cols.split(","))
    return f"""
, vals AS (SELECT {group} AS grp, {cols}, row_number() OVER (PARTITION BY {group} ORDER BY task) - 1 AS slot,
                  count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
draws AS (SELECT grp, n, r.rep, {mix32_sql('r.rep', 'slot')} % n AS j
          FROM vals CROSS JOIN (SELECT unnest(range(10000)) AS rep) r),
sums AS (SELECT d.grp, d.rep, d.n, {sums} FROM draws d JOIN vals v ON v.grp = d.grp AND v.slot = d.j GROUP BY d.grp, d.rep, d.n)
"""


def ends(name: str, stat: str, lo: int = 250, hi: int = 9750) -> str:
    return f"""
, {name}_r AS (SELECT grp, {stat} AS v, row_number() OVER (PARTITION BY grp ORDER BY {stat}) - 1 AS pos FROM sums),
{name}_e AS (SELECT grp, max(v) FILTER (pos = {lo}) AS lo, max(v) FILTER (pos = {hi}) AS hi FROM {name}_r GROUP BY 1)
"""


def mean_ends() -> str:
    return "".join(ends(c, f"CAST({c} AS DOUBLE) / n") for c in ("a", "b", "diff"))


def ledger(spark, folder) -> DataFrame:
    li = table(spark, folder, "lineitem")
    cents = lambda c: F.round(F.col(c) * 100)
    rows = li.select(
        "*", cents("l_tax").cast("int").alias("tax"), cents("l_discount").cast("int").alias("disc"),
        cents("l_extendedprice").cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("qty"),
        F.explode(F.when(cents("l_discount") == 10, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))).alias("copy"),
    )
    day = F.year("l_shipdate") * 10000 + F.month("l_shipdate") * 100 + F.dayofmonth("l_shipdate")
    pad = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    draw = F.year("l_shipdate") % 3 + 1
    flag = F.col("l_returnflag")
    verdict = (
        F.when(flag == "R", "fixed")
        .when(flag == "A", F.when(F.col("tax") == 7, "build-failed").otherwise("not-fixed"))
        .otherwise(F.when(F.col("tax") == 6, "lost").otherwise("no-proposal"))
    )
    return rows.select(
        F.col("l_suppkey").alias("task"), F.col("l_linestatus").alias("arm"), F.col("l_linenumber").alias("seed"),
        F.col("l_orderkey").alias("episode"), "l_partkey", "disc", "tax",
        F.concat_ws("|", pad("l_orderkey"), "l_linenumber", pad("l_partkey"), pad("l_suppkey"), "qty", "cents", "disc", "tax",
                    "l_returnflag", "l_linestatus", day, "copy").alias("eid"),
        verdict.alias("verdict"),
        F.when(F.col("tax") == 8, "error").when(F.col("tax") >= 4, "done").alias("stop"),
        (F.col("qty") * 1000).alias("tokens"), (F.col("qty") * 700).alias("prompt"),
        (F.col("qty") * F.col("disc") * 20).alias("cached"), (F.col("qty") * 200).alias("out_tokens"),
        (F.col("qty") * 100).alias("thought"), F.col("qty").alias("queries"), F.col("cents").alias("seconds"),
        draw.alias("draw"), F.concat(F.lit("episodes-draw"), draw, F.lit("-"), "copy", F.lit(".jsonl")).alias("file"),
    )


def overlap(spark, folder) -> DataFrame:
    s = table(spark, folder, "supplier").where("s_nationkey = 3")
    return s.select(F.lit("draw3").alias("tag"), F.col("s_suppkey").alias("id"))


def episodes(spark, folder, *keep: str) -> DataFrame:
    """Episodes with the columns of their identity and those to ``keep``."""
    return study.clean(ledger(spark, folder), overlap(spark, folder), keep)


def described(rows: DataFrame, spark, folder) -> DataFrame:
    """Episodes with class, model and file outcome of their part and kind of their task."""
    p = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 3 == 0).alias("same_file"),
        F.col("p_type").alias("cls"), F.col("p_brand").alias("model"),
    )
    s = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("task"),
        F.when(F.col("s_nationkey") % 2 == 0, "divergence").otherwise("assertion").alias("kind"),
    )
    return rows.join(p, "l_partkey").join(s, "task")


def pairs(spark, folder) -> DataFrame:
    return study.paired(study.cell_rates(episodes(spark, folder, "verdict"), F.col("verdict") == "fixed"), ARMS)


@query("G04_scored_rows", SQL + """
SELECT arm, count(*) FILTER (coalesce(stop = 'error', FALSE) OR coalesce(verdict = 'lost', FALSE)) AS lost,
       count(*) FILTER (NOT (coalesce(stop = 'error', FALSE) OR coalesce(verdict = 'lost', FALSE))) AS scored
FROM led GROUP BY 1
""")
def g04(spark, folder):
    return study.lost_by_arm(ledger(spark, folder))


@query("G05_overlap_exclusion", SQL + "SELECT eid, task, arm, file FROM kept")
def g05(spark, folder):
    return study.drop_overlap(ledger(spark, folder), overlap(spark, folder)).select("eid", "task", "arm", "file")


SCREEN = SQL + """
, scr0 AS (
  SELECT eid, l_partkey AS task, draw, file, tax = 5 AS rescreen,
         CASE verdict WHEN 'fixed' THEN 'killed' WHEN 'not-fixed' THEN 'survived' WHEN 'lost' THEN 'error'
           WHEN 'build-failed' THEN 'build-failed' ELSE CASE WHEN disc > 5 THEN 'killed' ELSE 'invalid' END END AS verdict,
         CASE WHEN disc < 4 THEN 'divergence' WHEN disc < 9 THEN 'assertion' ELSE 'timeout' END AS kind
  FROM led)
"""


def screening(spark, folder) -> DataFrame:
    kill = F.when(F.col("disc") > 5, "killed").otherwise("invalid")
    v = F.col("verdict")
    return ledger(spark, folder).select(
        "eid", F.col("l_partkey").alias("task"), "draw", "file", (F.col("tax") == 5).alias("rescreen"),
        F.when(v == "fixed", "killed").when(v == "not-fixed", "survived").when(v == "lost", "error")
        .when(v == "build-failed", "build-failed").otherwise(kill).alias("verdict"),
        F.when(F.col("disc") < 4, "divergence").when(F.col("disc") < 9, "assertion").otherwise("timeout").alias("kind"),
    )


@query("G06_supersede", SCREEN + """
, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY rescreen DESC, eid DESC) AS rn FROM scr0)
SELECT task, eid, verdict, rescreen FROM r WHERE rn = 1
""")
def g06(spark, folder):
    return study.supersede(screening(spark, folder), ["task"]).select("task", "eid", "verdict", "rescreen")


@query("G07_episode_dedupe", SQL + "SELECT task, arm, seed, tokens, queries, seconds, eid, copies FROM ep")
def g07(spark, folder):
    return episodes(spark, folder, "eid").select("task", "arm", "seed", "tokens", "queries", "seconds", "eid", "copies")


@query("G08_cell_rates", SQL + "SELECT task, arm, CAST(rate AS DOUBLE) AS rate, n FROM cells")
def g08(spark, folder):
    return study.cell_rates(episodes(spark, folder, "verdict"), F.col("verdict") == "fixed").withColumn("rate", F.col("rate").cast("double"))


SUMMARY = mean_ends() + """
, m AS (SELECT count(*) AS paired, CAST(sum(a) AS DOUBLE) / count(*) AS a, CAST(sum(b) AS DOUBLE) / count(*) AS b,
               CAST(sum(diff) AS DOUBLE) / count(*) AS diff FROM pairs)
SELECT m.*, a_e.lo AS a_lo, a_e.hi AS a_hi, b_e.lo AS b_lo, b_e.hi AS b_hi, diff_e.lo AS diff_lo, diff_e.hi AS diff_hi
FROM m, a_e, b_e, diff_e
"""


@query("G08_paired_diff", SQL + boot("pairs", "1", "a, b, diff") + SUMMARY)
def g08b(spark, folder):
    return study.paired_summary(pairs(spark, folder))


@query("G09_bootstrap_ci", """
WITH pairs AS (SELECT c_nationkey AS nation, c_custkey AS task, CAST(c_acctbal AS DECIMAL(18,2)) AS a FROM customer)
""" + draws("pairs", "nation", "a") + ends("a", "CAST(a AS DOUBLE) / n") + "SELECT grp AS nation, lo AS a_lo, hi AS a_hi FROM a_e")
def g09(spark, folder):
    c = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("task"), F.col("c_acctbal").cast("decimal(18,2)").alias("a")
    )
    return bootstrap_ci(c, ["nation"], "task", ["a"], drawn=True)


@query("G10_loc_paired", SQL.replace("cells AS (SELECT task, arm, CAST(count(*) FILTER (verdict = 'fixed') / count(*) AS DECIMAL(18,9)) AS rate, count(*) AS n FROM ep",
    "cells AS (SELECT task, arm, CAST(count(*) FILTER (same_file) / count(*) AS DECIMAL(18,9)) AS rate, count(*) AS n FROM epx")
    + draws("pairs", "1", "a, b, diff") + SUMMARY)
def g10(spark, folder):
    rows = described(episodes(spark, folder, "l_partkey"), spark, folder)
    return study.paired_summary(study.paired(study.cell_rates(rows, F.col("same_file")), ARMS), drawn=True)


@query("G11_token_cost", SQL + """
SELECT arm, count(*) AS episodes, count(*) FILTER (verdict = 'fixed') AS fixed,
       CAST(sum(tokens) AS BIGINT) / count(*) AS tokens_per_episode,
       CAST(sum(tokens) AS BIGINT) / nullif(count(*) FILTER (verdict = 'fixed'), 0) AS tokens_per_fix,
       count(*) FILTER (verdict IN ('fixed', 'not-fixed', 'build-failed')) AS patches_verified
FROM ep GROUP BY 1
""")
def g11(spark, folder):
    return study.token_cost(episodes(spark, folder, "verdict"))


@query("G12_token_ratio", SQL.replace("pairs AS (SELECT o.task", """tmean AS (
  SELECT task, arm, CAST(CAST(sum(tokens) AS BIGINT) / count(*) AS DECIMAL(24,6)) AS rate FROM ep WHERE tokens > 0 GROUP BY ALL),
pairs AS (SELECT o.task""").replace("FROM cells o JOIN cells f", "FROM tmean o JOIN tmean f")
    + boot("pairs", "1", "a, b") + ends("r", "CAST(a AS DOUBLE) / CAST(b AS DOUBLE)", 249, 9750) + """
SELECT count(*) AS tasks, CAST(sum(a) AS DOUBLE) / CAST(sum(b) AS DOUBLE) AS ratio, count(*) FILTER (a < b) AS below,
       any_value(r_e.lo) AS ratio_lo, any_value(r_e.hi) AS ratio_hi FROM pairs, r_e
""")
def g12(spark, folder):
    return study.token_ratio(episodes(spark, folder), ARMS)  # identity alone


@query("G13_by_kind", SQL + """
, kc AS (SELECT kind, task, arm, CAST(count(*) FILTER (verdict = 'fixed') / count(*) AS DECIMAL(18,9)) AS rate FROM epx GROUP BY ALL),
kp AS (SELECT o.kind, o.task, o.rate AS a, f.rate AS b FROM kc o JOIN kc f ON o.kind = f.kind AND o.task = f.task AND o.arm = 'O' AND f.arm = 'F'),
kr AS (SELECT kind, count(*) AS tasks, CAST(sum(a) AS DOUBLE) / count(*) AS a, CAST(sum(b) AS DOUBLE) / count(*) AS b FROM kp GROUP BY 1),
kt AS (SELECT kind, CAST(sum(tokens) FILTER (arm = 'O') AS BIGINT) / count(*) FILTER (arm = 'O') AS tok_a,
              CAST(sum(tokens) FILTER (arm = 'F') AS BIGINT) / count(*) FILTER (arm = 'F') AS tok_b FROM epx WHERE tokens > 0 GROUP BY 1)
SELECT kind, tok_a, tok_b, tasks, a, b FROM kt LEFT JOIN kr USING (kind)
""")
def g13(spark, folder):
    return study.by_kind(described(episodes(spark, folder, "verdict", "l_partkey"), spark, folder), ARMS)


# Tool names in the order calls cycle through them.
TOOLS = ("why", "state_at", "read_source", "search_source", "propose_fix")


def with_calls(rows: DataFrame) -> DataFrame:
    tools = F.array(*[F.lit(t) for t in TOOLS])
    n = F.floor(F.col("queries") / 10) + 1
    pick = lambda i: F.element_at(tools, ((i * F.col("l_partkey")) % 5 + 1).cast("int"))
    return rows.withColumn("tool_calls", F.transform(F.sequence(F.lit(1), n), pick))


@query("G14_behaviour", SQL + """
, e AS (SELECT *, list_transform(range(1, queries // 10 + 2), lambda i:
          ['why', 'state_at', 'read_source', 'search_source', 'propose_fix'][(i * l_partkey) % 5 + 1]) AS calls FROM ep),
c AS (SELECT arm, tool, count(*) AS calls FROM (SELECT arm, unnest(calls) AS tool FROM e) GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY calls DESC, tool) AS rn FROM c),
s AS (SELECT arm, CAST(sum(calls) FILTER (tool = 'why') AS BIGINT) / CAST(sum(calls) AS BIGINT) AS tool_share,
             string_agg(tool || ':' || calls, ', ' ORDER BY rn) FILTER (rn <= 5) AS top_tools FROM t GROUP BY 1)
SELECT arm, count(*) AS n, count(*) FILTER (verdict <> 'no-proposal') / count(*) AS proposed,
       count(*) FILTER (queries >= 30) / count(*) AS capped, count(*) FILTER (list_contains(calls, 'why')) / count(*) AS tool_episodes,
       CAST(median(queries) AS DOUBLE) AS median_queries, any_value(tool_share) AS tool_share, any_value(top_tools) AS top_tools
FROM e JOIN s USING (arm) GROUP BY arm
""")
def g14(spark, folder):
    return study.behaviour(with_calls(episodes(spark, folder, "verdict", "l_partkey")), "why")


@query("G15_per_class", SCREEN + """
, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY rescreen DESC, eid DESC) AS rn FROM scr0),
sc AS (SELECT r.task, r.verdict, p_type AS cls FROM r JOIN part ON p_partkey = r.task WHERE rn = 1),
pc AS (SELECT l_partkey AS task, arm, CAST(count(*) FILTER (verdict = 'fixed') / count(*) AS DECIMAL(18,9)) AS rate FROM ep GROUP BY ALL),
pp AS (SELECT o.task, o.rate AS a, f.rate AS b FROM pc o JOIN pc f ON o.task = f.task AND o.arm = 'O' AND f.arm = 'F'),
rt AS (SELECT cls, count(*) AS paired, CAST(sum(a) AS DOUBLE) / count(*) AS a, CAST(sum(b) AS DOUBLE) / count(*) AS b FROM pp JOIN sc USING (task) GROUP BY 1)
SELECT cls, count(*) AS screened, count(*) FILTER (verdict = 'killed') AS killed, any_value(coalesce(paired, 0)) AS paired,
       any_value(a) AS a, any_value(b) AS b FROM sc LEFT JOIN rt USING (cls) GROUP BY cls
""")
def g15(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("task"), F.col("p_type").alias("cls"))
    screened = study.supersede(screening(spark, folder).select("task", "eid", "rescreen", "verdict"), ["task"]).join(p, "task")
    rows = episodes(spark, folder, "verdict", "l_partkey").withColumn("task", F.col("l_partkey"))
    return study.per_class(rows, screened, ARMS)


@query("G16_corpus_counts", SCREEN + """
, r AS (SELECT *, row_number() OVER (PARTITION BY draw, task ORDER BY rescreen DESC, eid DESC) AS rn FROM scr0)
SELECT draw, count(*) AS screened, count(*) FILTER (verdict = 'killed') AS killed,
       count(*) FILTER (verdict = 'killed' AND kind <> 'timeout') AS tasks,
       count(*) FILTER (verdict = 'killed' AND kind = 'divergence') AS divergence,
       count(*) FILTER (verdict = 'killed' AND kind = 'assertion') AS assertion,
       count(*) FILTER (verdict = 'killed' AND kind = 'timeout') AS other_kill,
       count(*) FILTER (verdict = 'survived') AS survived, count(*) FILTER (verdict = 'build-failed') AS build_failed,
       count(*) FILTER (verdict = 'invalid') AS invalid, count(*) FILTER (verdict = 'error') AS error
FROM r WHERE rn = 1 GROUP BY draw
""".replace("SELECT draw,", "SELECT CAST(draw AS INTEGER) AS draw,"))
def g16(spark, folder):
    return study.corpus_counts(study.supersede(screening(spark, folder), ["draw", "task"]))


@query("G17_funnel", SQL + """
, d AS (SELECT 'arm' AS dim, arm AS key, * FROM epx UNION ALL SELECT 'model', model, * FROM epx)
SELECT dim, key, count(*) AS episodes, count(*) FILTER (verdict <> 'no-proposal') AS proposed,
       count(*) FILTER (same_file) AS right_file, count(*) FILTER (verdict = 'fixed') AS fixed,
       count(*) FILTER (same_file AND verdict = 'fixed') AS right_file_fixed FROM d GROUP BY ALL
""")
def g17(spark, folder):
    return study.funnel(described(episodes(spark, folder, "verdict", "l_partkey"), spark, folder))


@query("G18_trajectory", SQL + """
, st AS (SELECT s.stage, k.* FROM ok k JOIN (SELECT unnest([1, 2, 3])::INTEGER AS stage) s ON k.draw <= s.stage),
se AS (SELECT stage, task, arm, seed, tokens, queries, seconds, arg_min(verdict, eid) AS verdict FROM st GROUP BY ALL),
sc AS (SELECT stage, task, arm, CAST(count(*) FILTER (verdict = 'fixed') / count(*) AS DECIMAL(18,9)) AS rate FROM se GROUP BY ALL),
sp AS (SELECT o.stage, o.task, o.rate - f.rate AS diff FROM sc o JOIN sc f ON o.stage = f.stage AND o.task = f.task AND o.arm = 'O' AND f.arm = 'F')
""" + boot("sp", "stage", "diff") + ends("d", "CAST(diff AS DOUBLE) / n") + """
SELECT sp.stage, any_value(n) AS episodes, count(*) AS paired, CAST(sum(diff) AS DOUBLE) / count(*) AS diff,
       any_value(d_e.lo) AS diff_lo, any_value(d_e.hi) AS diff_hi
FROM sp JOIN d_e ON d_e.grp = sp.stage JOIN (SELECT stage, count(*) AS n FROM se GROUP BY 1) c ON c.stage = sp.stage GROUP BY sp.stage
""")
def g18(spark, folder):
    return study.trajectory(ledger(spark, folder), overlap(spark, folder), ARMS, 3)


LOC = """
WITH named AS (SELECT DISTINCT l_orderkey AS task, 'f' || lpad(CAST(l_partkey % 40 AS VARCHAR), 2, '0') AS item, 'd' || ((l_partkey % 40) % 7) AS dir FROM lineitem),
bugs AS (SELECT o_orderkey AS task, o_orderstatus AS status, 'f' || lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0') AS item, 'd' || ((o_custkey % 40) % 7) AS dir FROM orders),
first_draw AS (SELECT task FROM bugs WHERE status = 'F'),
ndir AS (SELECT DISTINCT task, dir AS item FROM named),
bdir AS (SELECT task, dir AS item FROM bugs),
size AS (SELECT b.task, count(n.item) AS size FROM bugs b LEFT JOIN named n USING (task) GROUP BY 1),
k AS (SELECT CAST(floor(median(size)) AS BIGINT) AS k FROM size WHERE task IN (FROM first_draw)),
top AS (SELECT item, count(*) AS n FROM named WHERE task IN (FROM first_draw) GROUP BY 1),
statics AS (SELECT item, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, item) AS rn FROM top) WHERE rn <= (SELECT k FROM k))
"""


def loc(spark, folder):
    item = lambda c: F.concat(F.lit("f"), F.lpad((F.col(c) % 40).cast("string"), 2, "0"))
    folder_of = lambda c: F.concat(F.lit("d"), (F.col(c) % 40) % 7)
    named = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("task"), item("l_partkey").alias("item"), folder_of("l_partkey").alias("dir")
    ).distinct()
    bugs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("status"), item("o_custkey").alias("item"),
        folder_of("o_custkey").alias("dir"),
    )
    return named, bugs


@query("G19_loc_metrics", LOC + """
, counts AS (
  SELECT 'file' AS level, b.item, count(*) AS nb, any_value((SELECT count(*) FROM named n WHERE n.item = b.item)) AS nn,
         any_value((SELECT count(*) FROM statics s WHERE s.item = b.item)) AS st FROM bugs b GROUP BY b.item
  UNION ALL SELECT 'dir', b.item, count(*), any_value((SELECT count(*) FROM ndir n WHERE n.item = b.item)), 0 FROM bdir b GROUP BY b.item),
hits AS (SELECT 'file' AS level, count(*) AS hits FROM bugs SEMI JOIN named USING (task, item)
         UNION ALL SELECT 'dir', count(*) FROM bdir SEMI JOIN ndir USING (task, item))
SELECT level, CAST(sum(nb) AS BIGINT) AS n, any_value(hits) AS hits, CAST(sum(nb * st) AS BIGINT) AS static_hits,
       (CAST(sum(nb * nn) AS BIGINT) - any_value(hits)) / (CAST(sum(nb) AS BIGINT) * (CAST(sum(nb) AS BIGINT) - 1)) AS permuted,
       (SELECT CAST(median(size) AS DOUBLE) FROM size) AS median_named
FROM counts JOIN hits USING (level) GROUP BY level
""")
def g19(spark, folder):
    named, bugs = loc(spark, folder)
    first = bugs.where("status = 'F'").select("task")
    early = named.join(first, "task", "left_semi")
    statics = study.static_baseline(early, study.list_sizes(early, first))
    files = study.localization(named, bugs, statics).withColumn("level", F.lit("file"))
    in_dirs = study.localization(
        named.select("task", F.col("dir").alias("item")).distinct(), bugs.select("task", F.col("dir").alias("item"))
    ).withColumn("level", F.lit("dir"))
    both = files.unionByName(in_dirs).withColumn("static_hits", F.col("static_hits").cast("long")).withColumn("_all", F.lit(1))
    sizes = study.list_sizes(named, bugs).withColumn("_all", F.lit(1))
    return both.join(study.exact_median(sizes, ["_all"], "size", "median_named"), "_all").drop("_all")


@query("G20_static_baseline", LOC + "SELECT item, n FROM statics")
def g20(spark, folder):
    named, bugs = loc(spark, folder)
    first = bugs.where("status = 'F'").select("task")
    early = named.join(first, "task", "left_semi")
    return study.static_baseline(early, study.list_sizes(early, first))


# How verdicts are shown.
LABELS = {"fixed": "fixed", "not-fixed": "wrong", "no-proposal": "none", "build-failed": "no build", "rejected": "rejected"}


@query("G21_task_table", SQL + """
, p AS (SELECT task, arm, CASE verdict WHEN 'not-fixed' THEN 'wrong' WHEN 'no-proposal' THEN 'none' WHEN 'build-failed' THEN 'no build' ELSE verdict END AS v,
               row_number() OVER (PARTITION BY task, arm ORDER BY episode, eid) AS pos FROM ep)
SELECT task, arm, (pos - 1) // 64 AS page, string_agg(v, ', ' ORDER BY pos) AS verdicts FROM p GROUP BY ALL
""")
def g21(spark, folder):
    return study.task_table(episodes(spark, folder, "episode", "eid", "verdict"), LABELS, SPAN)


@query("G23_integrity_audit", SQL + """
, q AS (SELECT DISTINCT 'draw' || draw AS tag, l_partkey AS task, arm, seed FROM led WHERE verdict IN ('fixed', 'not-fixed', 'build-failed')),
f AS (SELECT 'draw' || draw AS tag, l_partkey AS task, arm, seed, count(*) AS n,
             count(*) FILTER (coalesce(stop = 'error', FALSE) OR coalesce(verdict = 'lost', FALSE)) AS lost FROM led WHERE queries > 3 GROUP BY ALL)
SELECT tag, count(q.tag) AS queued, count(f.n) AS final, count(*) FILTER (f.n IS NULL) AS stranded, count(*) FILTER (f.n > 1) AS doubled,
       CAST(coalesce(sum(f.lost), 0) AS BIGINT) AS lost
FROM q FULL JOIN f USING (tag, task, arm, seed) GROUP BY tag
""".replace("count(q.tag)", "count(q.arm)"))
def g23(spark, folder):
    rows = ledger(spark, folder).withColumn("tag", F.concat(F.lit("draw"), "draw")).withColumn("task", F.col("l_partkey"))
    queued = rows.where(F.col("verdict").isin("fixed", "not-fixed", "build-failed"))
    return study.integrity_audit(queued, rows.where("queries > 3"))


@query("G23_arm_coverage", SQL + """
, a AS (SELECT l_partkey AS task, count(DISTINCT arm) AS arms FROM led WHERE coalesce(verdict <> 'lost', TRUE) AND coalesce(stop <> 'error', TRUE) GROUP BY 1)
SELECT coalesce(arms, 0) AS arms, count(*) AS tasks FROM part LEFT JOIN a ON task = p_partkey GROUP BY 1
""")
def g23b(spark, folder):
    rows = ledger(spark, folder).withColumn("task", F.col("l_partkey"))
    return study.arm_coverage(table(spark, folder, "part").select(F.col("p_partkey").alias("task")), rows)


def prices(spark) -> DataFrame:
    """Twenty of the brands have a price, every second one a cache price."""
    return spark.range(1, 21).select(
        F.concat(F.lit("Brand#"), "id").alias("model"), (F.col("id") * F.lit(0.25).cast("decimal(6,2)")).alias("input"),
        (F.col("id") * F.lit(2).cast("decimal(6,2)")).alias("output"),
        F.when(F.col("id") % 2 == 0, F.col("id") * F.lit(0.05).cast("decimal(6,2)")).alias("cache"),
    )


COST = SQL + """
, px AS (SELECT 'Brand#' || i AS model, i * 0.25::DECIMAL(6,2) AS inp, i * 2::DECIMAL(6,2) AS outp,
                CASE WHEN i % 2 = 0 THEN i * 0.05::DECIMAL(6,2) ELSE i * 0.25::DECIMAL(6,2) END AS cache FROM range(1, 21) r(i)),
cost AS (SELECT e.eid, e.model, e.tokens, CAST(round(greatest(0, prompt - cached) * inp + cached * cache + (out_tokens + thought) * outp) AS BIGINT) AS micros
         FROM epx e LEFT JOIN px ON px.model = e.model)
"""


def costed(spark, folder, *keep: str) -> DataFrame:
    keep = ("l_partkey", "prompt", "cached", "out_tokens", "thought", *keep)
    rows = described(episodes(spark, folder, *keep), spark, folder).withColumn("model", F.concat(F.lit("vendor/"), "model"))
    return study.episode_cost(rows, prices(spark))


@query("G24_episode_cost", COST + "SELECT eid, 'vendor/' || model AS model, micros FROM cost")
def g24(spark, folder):
    return costed(spark, folder, "eid").select("eid", "model", F.round(F.col("usd") * 1_000_000).cast("long").alias("micros"))


@query("G25_cost_rollup", COST + """
SELECT 'vendor/' || model AS model, count(*) AS episodes, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(micros) AS BIGINT) AS micros FROM cost
GROUP BY ROLLUP (model)
""")
def g25(spark, folder):
    return study.cost_rollup(costed(spark, folder)).select(
        "model", "episodes", "tokens", F.round(F.col("usd") * 1_000_000).cast("long").alias("micros")
    )


@query("G25_machine_cost", """
SELECT s_nationkey AS machine, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS hours,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) * 4172 AS milli_usd
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1
""")
def g25b(spark, folder):
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("machine"))
    used = table(spark, folder, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("hours")).join(s, "l_suppkey")
    return study.machine_cost(used, F.lit(4172)).withColumnRenamed("usd", "milli_usd")
