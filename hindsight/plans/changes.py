"""Change-log queries over the ``events`` table.

Four users make a run; a user is a scope and an event type a signal in it. Every
seventh user's signals have a second name on the same id. Cycles are hours.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.functions.names import file_of, to_absolute, to_relative
from hindsight.operators import asof, discover, results
from hindsight.operators.ordered import position
from hindsight.plans.registry import query, table
from hindsight.session import own_folder
from hindsight.sources import changes, dump, lines
from hindsight.sources.keyframes import KeyframeStore

CORE, TILE, TILE_SCOPES = "top.core", "top.tile", ("lsu",)
HOUR = 3_600_000_000
CUT = 360

SQL = """
WITH base AS (
  SELECT user_id // 4 AS run_id, user_id, event_type, event_id AS seq,
         user_id * 5 + CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1
           WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS signal_id,
         epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS "time",
         CAST(round(value * 100) AS BIGINT) AS value,
         CASE WHEN value >= 35 THEN 1::BIGINT ELSE 0::BIGINT END AS bit,
         CASE event_type WHEN 'error' THEN 1 ELSE 32 END AS bitwidth, CASE WHEN event_type IN ('click', 'view') THEN 'wire' ELSE 'reg' END AS var_type
  FROM events),
wave AS (SELECT *, "time" // 3600000000 AS cycle FROM base),
signal AS (
  SELECT DISTINCT run_id, signal_id, 'top.core.u' || user_id || '.' || event_type AS path,
         'top.core.u' || user_id AS scope, event_type AS name, bitwidth, var_type FROM base
  UNION ALL
  SELECT DISTINCT run_id, signal_id, 'top.tile.lsu.u' || user_id || '.' || event_type,
         'top.tile.lsu.u' || user_id, event_type, bitwidth, var_type FROM base WHERE user_id % 7 = 0),
named AS (SELECT w.*, s.path, s.scope, s.name FROM wave w JOIN signal s USING (run_id, signal_id)),
stored AS (SELECT * REPLACE (CASE WHEN seq % 17 <> 0 AND seq % 19 <> 0 THEN value END AS value),
                  CASE WHEN seq % 17 = 0 THEN 'bx' || seq WHEN seq % 19 = 0 THEN CAST(18446744073709551616::HUGEINT + value AS VARCHAR) END AS value_str,
                  struct_pack(v := CASE WHEN seq % 17 <> 0 AND seq % 19 <> 0 THEN value END, s := value_str) AS vs FROM named),
commits AS (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS cseq, cycle,
         value AS pc, seq AS insn, signal_id AS wdata FROM wave WHERE event_type = 'purchase')
"""


def base(spark, folder) -> DataFrame:
    e = table(spark, folder, "events")
    kind = F.expr(
        "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
    )
    micros = F.expr(
        "cast(cast(cast(ts - timestamp_ntz'2024-01-01' as interval second) as decimal(20,6)) * 1000000 as bigint)"
    )
    return e.select(
        F.floor(F.col("user_id") / 4).alias("run_id"), "user_id", "event_type", F.col("event_id").alias("seq"),
        (F.col("user_id") * 5 + kind).alias("signal_id"), micros.alias("time"),
        F.round(F.col("value") * 100).cast("long").alias("value"),
        F.when(F.col("value") >= 35, 1).otherwise(0).cast("long").alias("bit"),
    ).withColumn("cycle", F.floor(F.col("time") / HOUR))


def wave(spark, folder) -> DataFrame:
    return base(spark, folder).select("run_id", "signal_id", "time", "cycle", "value", "seq")


def stored(spark, folder) -> DataFrame:
    """The log as recorded: every 17th change is no number, every 19th needs more than 64 bits."""
    top = F.lit("18446744073709551616").cast("decimal(38,0)")
    raw = F.when(F.col("seq") % 17 == 0, F.concat(F.lit("bx"), "seq")).when(F.col("seq") % 19 == 0, (top + F.col("value")).cast("string"))
    told = wave(spark, folder).withColumn("raw", F.coalesce(raw, F.col("value").cast("string")))
    return changes.decode_values(told).withColumn("value", F.col("value").cast("long"))


def bits(spark, folder) -> DataFrame:
    return base(spark, folder).select("run_id", "signal_id", "time", "cycle", F.col("bit").alias("value"), "seq")


def metas(spark, folder) -> DataFrame:
    """Every name a change row stands for, aliases included."""
    b = base(spark, folder)
    own = F.concat(F.lit(CORE + ".u"), F.col("user_id"), F.lit("."), F.col("event_type"))
    alias = F.concat(F.lit(TILE + ".lsu.u"), F.col("user_id"), F.lit("."), F.col("event_type"))
    names = F.when(F.col("user_id") % 7 == 0, F.array(own, alias)).otherwise(F.array(own))
    width = F.when(F.col("event_type") == "error", 1).otherwise(32).alias("bitwidth")
    kind = F.when(F.col("event_type").isin("click", "view"), "wire").otherwise("reg").alias("var_type")
    return b.select("run_id", "signal_id", "event_type", "value", width, kind, F.explode(names).alias("path"))


def signal(spark, folder) -> DataFrame:
    return changes.signal_catalog(metas(spark, folder))


def commits(spark, folder) -> DataFrame:
    c = base(spark, folder).where("event_type = 'purchase'")
    return position(c, ["run_id"], ["seq"], 1 << 20, "n").select(
        "run_id", (F.col("n") - 1).alias("seq"), "cycle", F.col("value").alias("pc"),
        F.col("seq").alias("insn"), F.col("signal_id").alias("wdata"),
    )


def both(spark, folder):
    return wave(spark, folder), signal(spark, folder)


# ---- ingest -----------------------------------------------------------------

@query("A01_signal_catalog", SQL + """
, metas AS (
  SELECT run_id, path, min(CASE WHEN value >= 6000 THEN signal_id + 1000000 ELSE signal_id END) AS signal_id, bitwidth, var_type
  FROM named GROUP BY ALL)
SELECT run_id, path, signal_id, bitwidth, var_type, regexp_replace(path, '\\.[^.]*$', '') AS scope,
       split_part(path, '.', -1) AS name
FROM metas WHERE NOT path LIKE '%.signup'
""")
def a01(spark, folder):
    m = metas(spark, folder).withColumn(
        "signal_id", F.when(F.col("value") >= 6000, F.col("signal_id") + 1_000_000).otherwise(F.col("signal_id"))
    )
    stored = changes.signal_catalog(metas(spark, folder).where("event_type = 'signup'"))
    return changes.signal_catalog(m, existing=stored)


@query("A02_path_split", SQL + "SELECT DISTINCT run_id, path, scope, name FROM signal")
def a02(spark, folder):
    return changes.split_path(metas(spark, folder).select("run_id", "path").distinct())


@query("A03_change_load", SQL + 'SELECT run_id, signal_id, "time", cycle, value, seq FROM wave')
def a03(spark, folder):
    path = own_folder(spark)
    changes.write_changes(wave(spark, folder), path)
    return changes.read_changes(spark, path).select(F.col("run_id").cast("long").alias("run_id"), "signal_id", "time", "cycle", "value", "seq")


@query("A04_wide_value", """
WITH raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         CASE l_linenumber WHEN 1 THEN CAST(l_partkey AS VARCHAR)
           WHEN 2 THEN CAST(18446744073709551615::HUGEINT - l_partkey AS VARCHAR)
           WHEN 3 THEN '0x' || printf('%x', l_partkey)
           WHEN 4 THEN '0x1' || printf('%016x', l_partkey)
           WHEN 5 THEN 'x' || l_partkey
           WHEN 6 THEN CAST(18446744073709551616::HUGEINT + l_partkey AS VARCHAR)
           ELSE '0xffffffff' || printf('%08x', l_partkey) END AS raw,
         CASE l_linenumber WHEN 1 THEN l_partkey::HUGEINT
           WHEN 2 THEN 18446744073709551615::HUGEINT - l_partkey
           WHEN 3 THEN l_partkey::HUGEINT
           WHEN 7 THEN 18446744069414584320::HUGEINT + l_partkey END AS v
  FROM lineitem)
SELECT l_orderkey, l_linenumber, raw, CAST(v AS VARCHAR) AS value, CASE WHEN v IS NULL THEN raw END AS value_str
FROM raw
""")
def a04(spark, folder):
    top = "cast(18446744073709551615 as decimal(20,0))"
    raw = F.expr(f"""
        CASE l_linenumber WHEN 1 THEN cast(l_partkey AS string)
          WHEN 2 THEN cast({top} - l_partkey AS string)
          WHEN 3 THEN concat('0x', lower(hex(l_partkey)))
          WHEN 4 THEN concat('0x1', lpad(lower(hex(l_partkey)), 16, '0'))
          WHEN 5 THEN concat('x', l_partkey)
          WHEN 6 THEN cast({top} + 1 + l_partkey AS string)
          ELSE concat('0xffffffff', lpad(lower(hex(l_partkey)), 8, '0')) END""")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return changes.decode_values(lines).withColumn("value", F.col("value").cast("string"))


@query("A05_dump_ingest", SQL + """
SELECT run_id, 's' || signal_id AS symbol, "time",
       CASE WHEN event_type = 'error' THEN bit ELSE value END AS value, 2 * seq + 1 AS seq FROM wave
""")
def a05(spark, folder):
    return dump.parse_dump(dump_lines(spark, folder), 1 << 20).select(
        "run_id", "symbol", "time", F.col("value").cast("long").alias("value"), "seq"
    )


def dump_lines(spark, folder) -> DataFrame:
    b = base(spark, folder)
    mark = F.concat(F.lit("#"), F.col("time"))
    body = F.when(F.col("event_type") == "error", F.concat(F.col("bit"), F.lit("s"), F.col("signal_id"))).otherwise(
        F.concat(F.lit("b"), F.bin("value"), F.lit(" s"), F.col("signal_id"))
    )
    return b.select(
        "run_id",
        F.inline(F.array(
            F.struct((F.col("seq") * 2).alias("line_no"), mark.alias("text")),
            F.struct((F.col("seq") * 2 + 1).alias("line_no"), body.alias("text")),
        )),
    )


@query("A05_dump_files", SQL + """
SELECT run_id, 's' || signal_id AS symbol, "time", CASE WHEN event_type = 'error' THEN bit ELSE value END AS value,
       2 * row_number() OVER (PARTITION BY run_id ORDER BY seq) AS seq FROM wave
""")
def a05_files(spark, folder):
    """The same dumps as text files, one for each run."""
    path = own_folder(spark)
    told = dump_lines(spark, folder).repartition("run_id").sortWithinPartitions("run_id", "line_no").select("run_id", "text")
    told.write.partitionBy("run_id").text(path)
    numbered = lines.read_lines(spark, path).withColumn("run_id", F.regexp_extract("file", r"run_id=(\d+)/", 1).cast("long"))
    return dump.parse_dump(numbered.drop("file"), 1 << 20).select("run_id", "symbol", "time", F.col("value").cast("long").alias("value"), "seq")


@query("A06_scope_select", SQL + """
SELECT run_id, path FROM signal
WHERE path LIKE 'top.tile.%' OR (path LIKE 'top.core.u1.%' AND NOT substr(path, 13) LIKE '%.%')
   OR path LIKE 'top.core.u2.%'
""")
def a06(spark, folder):
    return discover.select_strict(
        signal(spark, folder), ["top.tile", "top.core.u1.*", "top.core.u2"]
    ).select("run_id", "path")


@query("A07_row_cap", SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM wave)
SELECT run_id, signal_id, cycle, value, seq, n > 200 AS truncated FROM r WHERE rn <= 200
""")
def a07(spark, folder):
    return results.capped_per_key(wave(spark, folder), ["run_id"], [F.col("seq")], 200).select(
        "run_id", "signal_id", "cycle", "value", "seq", "truncated"
    )


@query("A08_resolve_names", SQL + """
, asked AS (
  SELECT DISTINCT run_id, event_type AS leaf, CASE WHEN value >= 6000 THEN 'top.x' || user_id || '.' || event_type
    ELSE 'top.core.u' || user_id || '.' || event_type END AS name FROM wave),
hints AS (
  SELECT run_id, name AS leaf, path, row_number() OVER (PARTITION BY run_id, name ORDER BY path) AS rn FROM signal)
SELECT a.run_id, a.name, a.name LIKE 'top.core.%' AS found, h.path AS suggestion
FROM asked a LEFT JOIN hints h
  ON h.run_id = a.run_id AND h.leaf = a.leaf AND h.rn <= 3 AND NOT a.name LIKE 'top.core.%'
""")
def a08(spark, folder):
    who = F.concat(F.col("user_id"), F.lit("."), F.col("event_type"))
    asked = base(spark, folder).select(
        "run_id",
        F.when(F.col("value") >= 6000, F.concat(F.lit("top.x"), who)).otherwise(F.concat(F.lit(CORE + ".u"), who)).alias("name"),
    )
    return discover.resolve_names(asked, signal(spark, folder))


EDGES = SQL + """
, steps AS (SELECT *, lag(bit) OVER (PARTITION BY signal_id ORDER BY seq) AS before FROM wave),
edges AS (SELECT run_id, signal_id, "time", seq FROM steps WHERE before = 0 AND bit = 1)
"""


@query("A09_rising_edges", EDGES + 'SELECT run_id, signal_id, "time" FROM edges')
def a09(spark, folder):
    return asof.rising_edges(bits(spark, folder)).drop("seq")


def counter(spark, folder) -> DataFrame:
    ticks = wave(spark, folder).join(
        base(spark, folder).where("event_type = 'signup'").select("seq"), "seq", "left_semi"
    )
    return position(ticks, ["run_id"], ["time", "seq"], None, "n").withColumn("value", F.col("n")).drop("n")


COUNTER = SQL + """
, idx AS (SELECT run_id, "time", seq, row_number() OVER (PARTITION BY run_id ORDER BY "time", seq) AS cyc
          FROM wave WHERE event_type = 'signup')
"""


@query("A10_cycle_index_counter", COUNTER + 'SELECT run_id, "time", cyc AS cycle FROM idx')
def a10(spark, folder):
    return asof.cycle_index_counter(counter(spark, folder)).drop("seq")


@query("A11_cycle_index_edges", EDGES + """
, g AS (SELECT *, "time" - lag("time") OVER (PARTITION BY signal_id ORDER BY seq) AS gap,
               row_number() OVER (PARTITION BY signal_id ORDER BY seq) - 1 AS cycle FROM edges),
p AS (SELECT signal_id, CASE WHEN min(gap) = max(gap) THEN min(gap) END AS period FROM g GROUP BY 1)
SELECT run_id, signal_id, "time", cycle, period FROM g JOIN p USING (signal_id)
""")
def a11(spark, folder):
    return asof.cycle_index_edges(bits(spark, folder))


@query("A12_assign_cycle", COUNTER + """
SELECT w.run_id, w.signal_id, w."time", w.seq, i.cyc AS cycle
FROM wave w ASOF LEFT JOIN idx i ON w.run_id = i.run_id AND w."time" >= i."time"
""")
def a12(spark, folder):
    index = asof.cycle_index_counter(counter(spark, folder))
    return asof.assign_cycle(wave(spark, folder), index).select("run_id", "signal_id", "time", "seq", "cycle")


@query("A27_run_artifact", SQL + """
, m AS (SELECT run_id, event_type AS key, arg_max(CAST(value AS VARCHAR), seq) AS v FROM wave GROUP BY ALL),
mp AS (SELECT run_id, max(CASE WHEN key = 'view' THEN v END) AS last_view, max(CASE WHEN key = 'click' THEN v END) AS last_click FROM m GROUP BY 1)
SELECT run_id, min(cycle) AS lo, max(cycle) AS hi,
       (SELECT count(*) FROM signal s WHERE s.run_id = w.run_id) AS signals, count(*) AS changes,
       count(*) FILTER (event_type = 'purchase') AS commits, count(*) FILTER (event_type = 'error') AS findings,
       any_value(last_view) AS last_view, any_value(last_click) AS last_click
FROM wave w LEFT JOIN mp USING (run_id) GROUP BY run_id
""")
def a27(spark, folder):
    b = base(spark, folder)
    facts = changes.run_artifact(
        signal(spark, folder), wave(spark, folder), b.where("event_type = 'purchase'"), b.where("event_type = 'error'")
    )
    meta = changes.meta_latest(
        b.select("run_id", F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"), "seq")
    )
    wide = meta.groupBy("run_id").pivot("key", ["view", "click"]).agg(F.first("value"))
    return facts.join(
        wide.select("run_id", F.col("view").alias("last_view"), F.col("click").alias("last_click")), "run_id", "left"
    )


# ---- discovery and point-in-time -----------------------------------------------

@query("B01_find_signals", SQL + """
, r AS (SELECT run_id, path, bitwidth, var_type, row_number() OVER (PARTITION BY run_id ORDER BY path) AS rn, count(*) OVER (PARTITION BY run_id) > 50 AS truncated FROM signal
        WHERE regexp_matches(path, 'u[0-9]*[02468]\\.(view|click)$'))
SELECT run_id, path, bitwidth, var_type, truncated FROM r WHERE rn <= 50
""")
def b01(spark, folder):
    return discover.find_signals(signal(spark, folder), r"u[0-9]*[02468]\.(view|click)$").drop("rank")


@query("B02_scopes", SQL + "SELECT run_id, scope, count(*) AS signals FROM signal WHERE scope LIKE 'top.core%' GROUP BY ALL")
def b02(spark, folder):
    return discover.scopes(signal(spark, folder), CORE)


STATE = """
, state AS (SELECT run_id, path, name, scope, arg_max(value, seq) AS value, arg_max(bit, seq) AS bit,
                   max(cycle) AS last_change FROM named WHERE cycle <= 360 GROUP BY ALL)
"""


KEPT = """
, kept AS (SELECT run_id, path, arg_max(vs, seq) AS b, max(cycle) AS last_change FROM stored WHERE cycle <= 360 GROUP BY ALL)
SELECT run_id, path, b.v AS value, b.s AS value_str, last_change FROM kept
"""


@query("B04_state_at", SQL + KEPT)
def b04(spark, folder):
    return asof.state_at(stored(spark, folder), signal(spark, folder), CUT)


EVERY = 100


def framed(spark, folder) -> KeyframeStore:
    """The recorded log with a keyframe each hundred cycles, stored in two goes."""
    store, log = KeyframeStore(spark, own_folder(spark), EVERY), stored(spark, folder).drop("raw")
    store.write(log.where(F.col("cycle") < 2 * EVERY))
    store.extend(log.where(F.col("cycle") >= 2 * EVERY))
    return store


@query("A03_keyframes", SQL + f"""
, e AS (SELECT unnest(range(1, (SELECT max(cycle) // {EVERY} + 2 FROM wave)))::BIGINT AS epoch),
k AS (SELECT DISTINCT run_id, signal_id, cycle, seq FROM wave)
SELECT run_id, signal_id, epoch, arg_max(cycle, seq) AS cycle, max(seq) AS seq FROM k JOIN e ON cycle < epoch * {EVERY} GROUP BY ALL
""")
def a03_keyframes(spark, folder):
    frames = framed(spark, folder).keyframes()
    return frames.select("run_id", "signal_id", F.col("epoch").cast("long").alias("epoch"), "cycle", "seq")


@query("B04_state_from_keyframe", SQL + KEPT)
def b04_keyframe(spark, folder):
    return asof.state_at(framed(spark, folder).upto(CUT), signal(spark, folder), CUT)


@query("B05_changed_only", SQL + KEPT + "WHERE last_change = 360")
def b05(spark, folder):
    return asof.changed_at(stored(spark, folder), signal(spark, folder), CUT)


@query("B06_scope_filter", SQL + STATE + """
SELECT run_id, path, value, last_change FROM state
WHERE (path LIKE 'top.tile.lsu.%' OR path LIKE 'top.core.u3.%')
  AND path IN ('top.core.u3.view', 'top.core.u4.view', 'top.tile.lsu.u7.click', 'top.tile.lsu.u14.error')
""")
def b06(spark, folder):
    names = ["top.core.u3.view", "top.core.u4.view", "top.tile.lsu.u7.click", "top.tile.lsu.u14.error"]
    chosen = asof.in_scopes(signal(spark, folder), ["top.tile.lsu", "top.core.u3"], names)
    return asof.state_at(wave(spark, folder), chosen, CUT)


@query("B07_window", SQL + 'SELECT run_id, path, cycle, "time", value, value_str FROM stored WHERE cycle BETWEEN 100 AND 420')
def b07(spark, folder):
    return asof.in_window(stored(spark, folder), signal(spark, folder), 100, 420)


@query("B08_trace_signal", SQL + """
, e AS (SELECT run_id, path, arg_max(cycle, seq) AS cycle, arg_max("time", seq) AS "time", arg_max(vs, seq) AS b
         FROM stored WHERE cycle <= 200 GROUP BY ALL)
SELECT run_id, path, cycle, "time", b.v AS value, b.s AS value_str, TRUE AS entering FROM e
UNION ALL SELECT run_id, path, cycle, "time", value, value_str, FALSE FROM stored WHERE cycle > 200 AND cycle <= 500
""")
def b08(spark, folder):
    return asof.trace(stored(spark, folder), signal(spark, folder), 200, 500)


@query("B08_trace_from_keyframe", SQL + """
, e AS (SELECT run_id, path, arg_max(cycle, seq) AS cycle, arg_max("time", seq) AS "time", arg_max(vs, seq) AS b
         FROM stored WHERE cycle <= 200 GROUP BY ALL)
SELECT run_id, path, cycle, "time", b.v AS value, b.s AS value_str, TRUE AS entering FROM e
UNION ALL SELECT run_id, path, cycle, "time", value, value_str, FALSE FROM stored WHERE cycle > 200 AND cycle <= 500
""")
def b08_keyframe(spark, folder):
    return asof.trace(framed(spark, folder).between(200, 500), signal(spark, folder), 200, 500)


@query("B09_commits_near", SQL + """
, anchors AS (SELECT DISTINCT run_id, cycle AS at FROM wave WHERE event_type = 'error' AND bit = 1)
SELECT a.run_id, a.at, c.cseq AS seq, c.cycle, printf('0x%x', c.pc) AS pc, printf('0x%x', c.insn) AS insn,
       '0x' || lpad(printf('%x', CAST(c.wdata + 8 AS BIGINT)), 16, '8000000000000000') AS wdata,
       CAST(c.cseq % 4 AS INTEGER) AS priv, CASE WHEN c.wdata % 3 = 0 THEN 'f' ELSE 'x' END AS regfile, CAST(c.wdata % 32 AS INTEGER) AS rd
FROM anchors a JOIN commits c ON a.run_id = c.run_id AND c.cycle BETWEEN a.at - 10 AND a.at + 10
""")
def b09(spark, folder):
    anchors = base(spark, folder).where("event_type = 'error' AND bit = 1").select(
        "run_id", F.col("cycle").alias("at")
    ).distinct()
    # written registers hold sign-extended addresses
    high = (F.lit("9223372036854775808").cast("decimal(20,0)") + F.col("wdata") + 8).cast("decimal(20,0)")
    rows = commits(spark, folder).select(
        "run_id", "seq", "cycle", "pc", "insn", high.alias("wdata"), (F.col("seq") % 4).cast("int").alias("priv"),
        F.when(F.col("wdata") % 3 == 0, "f").otherwise("x").alias("regfile"), (F.col("wdata") % 32).cast("int").alias("rd"),
    )
    return asof.commits_near(rows, anchors, 10)


@query("B10_inflight", SQL + STATE + """
SELECT run_id, path, name, bit AS value, last_change FROM state
WHERE (name LIKE 'cl%' AND bit = 1) OR name IN ('view', 'signup')
""")
def b10(spark, folder):
    return asof.inflight(bits(spark, folder), signal(spark, folder), CUT, "cl", ["view", "signup"])


@query("B11_last_change", SQL + STATE + "SELECT run_id, path, last_change FROM state")
def b11(spark, folder):
    return asof.last_change(*both(spark, folder), CUT)


@query("B12_snapshot", SQL + """
, cuts AS (SELECT unnest([120, 360, 600])::BIGINT AS "at")
, k AS (SELECT run_id, path, "at", arg_max(vs, seq) AS b, max(cycle) AS last_change FROM stored JOIN cuts ON cycle <= "at" GROUP BY ALL)
SELECT run_id, path, "at", b.v AS value, b.s AS value_str, last_change FROM k
""")
def b12(spark, folder):
    return asof.snapshot(stored(spark, folder), signal(spark, folder), [120, 360, 600])


@query("B14_sql", SQL + """
SELECT s.run_id, s.name, count(*) AS n, CAST(sum(w.value) AS BIGINT) AS total
FROM wave w JOIN signal s ON w.run_id = s.run_id AND w.signal_id = s.signal_id GROUP BY ALL
""")
def b14(spark, folder):
    views = {"wave": wave(spark, folder), "signal": signal(spark, folder)}
    return results.read_only_sql(spark, views, """
        SELECT s.run_id, s.name, count(*) AS n, sum(w.value) AS total
        FROM wave w JOIN signal s ON w.run_id = s.run_id AND w.signal_id = s.signal_id
        GROUP BY s.run_id, s.name""")


@query("B15_capped_result", SQL + """
SELECT run_id, signal_id, cycle, value, seq, TRUE AS truncated FROM wave ORDER BY cycle, seq LIMIT 500
""")
def b15(spark, folder):
    return results.capped(
        wave(spark, folder).select("run_id", "signal_id", "cycle", "value", "seq"), [F.col("cycle"), F.col("seq")], 500
    )


@query("B16_char_budget", SQL + """
, l0 AS (SELECT run_id, seq, signal_id || ' | ' || cycle || ' | ' || value || CASE WHEN seq % 5 = 0 THEN repeat(' .', 60) ELSE '' END AS line FROM wave),
l AS (SELECT *, substr(line, 1, 120) AS shown, length(line) > 120 AS cut FROM l0),
u AS (SELECT *, sum(length(shown) + 1) OVER (PARTITION BY run_id ORDER BY seq) AS used,
             sum(length(shown) + 1) OVER (PARTITION BY run_id) AS total FROM l)
SELECT run_id, seq, line, shown, cut, total - 1 > 2000 - 24 AS truncated FROM u WHERE used <= 2000 - 24 OR total - 1 <= 2000 - 24
""")
def b16(spark, folder):
    head = "signal | cycle | value "
    lines = wave(spark, folder).select(
        "run_id", "seq", F.concat(F.concat_ws(" | ", "signal_id", "cycle", "value"), F.when(F.col("seq") % 5 == 0, " ." * 60).otherwise("")).alias("line")
    )
    return results.char_budget(lines, ["run_id"], ["seq"], "line", head, 2000, 1 << 20).drop("used")


@query("B17_query_log", SQL + """
SELECT run_id, event_type AS op, count(*) AS calls, count(*) FILTER (value >= 6000) AS truncated,
       CAST(sum(value // 100) AS BIGINT) AS rows_out, CAST(sum(value) AS BIGINT) AS ms FROM wave GROUP BY ALL
""")
def b17(spark, folder):
    log = base(spark, folder).select(
        "run_id", F.col("event_type").alias("op"), F.floor(F.col("value") / 100).alias("rows_out"),
        (F.col("value") >= 6000).alias("truncated"), F.col("value").alias("ms"),
    )
    path = own_folder(spark)
    for part in (log.where("NOT truncated"), log.where("truncated")):
        results.append_log(part, path)
    return results.query_log_summary(spark.read.schema(log.schema).parquet(path))


@query("B18_path_alias", SQL + """
SELECT run_id, path, CASE WHEN path LIKE 'top.core.%' THEN substr(path, 10) ELSE substr(path, 10) END AS rel,
       path AS back, 'u.scala:' || run_id AS base FROM signal
""")
def b18(spark, folder):
    rel = to_relative(F.col("path"), CORE, TILE)
    ref = F.concat(F.lit("generators/a/u.scala:"), F.col("run_id"))
    return signal(spark, folder).select(
        "run_id", "path", rel.alias("rel"), to_absolute(rel, CORE, TILE, TILE_SCOPES).alias("back"),
        file_of(ref).alias("base"),
    )


@query("B19_memory_hop", SQL + """
, rd AS (SELECT run_id, user_id, arg_max(value // 5000, seq) AS addr FROM wave
         WHERE event_type = 'purchase' AND cycle <= 600 GROUP BY ALL),
en AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'W0' ELSE 'W1' END AS port, cycle, seq FROM wave
       WHERE event_type IN ('click', 'error') AND bit = 1 AND cycle <= 600),
ad AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'W0' ELSE 'W1' END AS port, cycle, seq, value // 5000 AS addr FROM wave
       WHERE event_type IN ('view', 'signup') AND cycle <= 600),
m AS (SELECT en.user_id, en.port, en.cycle, en.seq, arg_max(ad.addr, ad.seq) AS addr
      FROM en JOIN ad ON en.user_id = ad.user_id AND en.port = ad.port AND ad.cycle <= en.cycle GROUP BY ALL),
p AS (SELECT rd.run_id, rd.user_id, rd.addr, m.port, max(m.cycle) AS c FROM m JOIN rd ON m.user_id = rd.user_id AND m.addr = rd.addr GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, port) AS rn FROM p)
SELECT run_id, 'u' || user_id AS mem, addr AS read_addr, c AS write_cycle, port FROM b WHERE rn = 1
""")
def b19(spark, folder):
    b = base(spark, folder).withColumn("mem", F.concat(F.lit("u"), "user_id")).withColumn(
        "addr", F.floor(F.col("value") / 5000)
    )

    def ports(first, second):
        kept = b.where(F.col("event_type").isin(first, second))
        return kept.withColumn("port", F.when(F.col("event_type") == first, "W0").otherwise("W1"))

    enables = ports("click", "error").select("run_id", "mem", "port", "cycle", "seq", F.col("bit").alias("value"))
    addresses = ports("view", "signup").select("run_id", "mem", "port", "cycle", "seq", "addr")
    reads = b.where("event_type = 'purchase'").select("run_id", "mem", "cycle", "seq", "addr")
    return asof.memory_hop(reads, enables, addresses, 600)


@query("B20_join_check", SQL + """
, s AS (SELECT DISTINCT run_id, cycle FROM wave WHERE event_type = 'signup'),
o AS (SELECT unnest([-1, 0, 1])::INTEGER AS "offset")
SELECT "offset", count(*) AS commits, count(s.cycle) AS matched
FROM commits c CROSS JOIN o LEFT JOIN s ON s.run_id = c.run_id AND s.cycle = c.cycle + o."offset" GROUP BY ALL
""")
def b20(spark, folder):
    samples = base(spark, folder).where("event_type = 'signup'")
    return asof.join_check(base(spark, folder).where("event_type = 'purchase'"), samples)


@query("B21_window_coverage", SQL + """
, i AS (SELECT run_id, min(cycle) AS lo, max(cycle) AS hi FROM wave WHERE event_type = 'signup' GROUP BY 1),
f AS (SELECT run_id, max(cycle) AS "at" FROM wave WHERE event_type = 'error' GROUP BY 1)
SELECT run_id, lo, hi, "at", coalesce("at" BETWEEN lo AND hi, FALSE) AS covered FROM i LEFT JOIN f USING (run_id)
""")
def b21(spark, folder):
    b = base(spark, folder)
    failures = b.where("event_type = 'error'").groupBy("run_id").agg(F.max("cycle").alias("at"))
    return asof.window_coverage(b.where("event_type = 'signup'"), failures)


# Path prefix to block, first fit wins.
BLOCKS = (("lsu.u1", "LSU-1"), ("lsu.", "LSU"), ("u1.", "One"), ("u1", "Teens"), ("u2", "Twenties"))


@query("D13_block_map", SQL + """
, r AS (SELECT run_id, path, substr(path, 10) AS rel FROM signal)
SELECT run_id, path, CASE WHEN rel LIKE 'lsu.u1%' THEN 'LSU-1' WHEN rel LIKE 'lsu.%' THEN 'LSU' WHEN rel LIKE 'u1.%' THEN 'One'
  WHEN rel LIKE 'u1%' THEN 'Teens' WHEN rel LIKE 'u2%' THEN 'Twenties' ELSE 'Core' END AS block FROM r
""")
def d13(spark, folder):
    rel = to_relative(F.col("path"), CORE, TILE)
    return signal(spark, folder).select("run_id", "path", discover.block_of(rel, BLOCKS, "Core").alias("block"))
