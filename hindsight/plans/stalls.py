"""Stall sections over ``events``: four users share a run's queue.

``view`` and ``click`` are the valid and busy bits of a user's entry, ``error`` and
``signup`` a valid/ready pair in the user's scope, ``purchase`` retires and moves the
head pointer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hindsight.operators import stall
from hindsight.plans import changes as ev
from hindsight.plans.registry import query
from hindsight.sources.changes import signal_catalog

ROB = "top.core.rob."
REPORT = dict(
    pointers=[ROB + "rob_head", ROB + "rob_tail", ROB + "rob_state"], valid_prefix=ROB + "rob_val_",
    busy_prefix=ROB + "rob_bsy_", head=ROB + "rob_head", banks=["", "1_", "2_", "3_"], upstream=ROB + "io_enq_valids_0",
)

SQL = ev.SQL + """
, sw AS (
  SELECT run_id, cycle, seq, event_type,
         CASE event_type WHEN 'view' THEN 'top.core.rob.rob_val_' || (user_id % 4)
           WHEN 'click' THEN 'top.core.rob.rob_bsy_' || (user_id % 4)
           WHEN 'error' THEN 'top.core.u' || user_id || '.q_valid'
           WHEN 'signup' THEN 'top.core.u' || user_id || '.q_ready'
           ELSE 'top.core.rob.rob_head' END AS path,
         CASE event_type WHEN 'purchase' THEN user_id % 4 ELSE bit END AS value
  FROM wave),
b0 AS (SELECT run_id, max(cycle) FILTER (event_type = 'purchase') AS onset, max(cycle) AS hi FROM sw GROUP BY 1),
bounds AS (SELECT *, hi - onset AS stalled, onset + greatest(1, (hi - onset) // 2) AS mid, onset IS NULL AS no_commits FROM b0),
st AS (
  SELECT run_id, path, regexp_replace(path, '\\.[^.]*$', '') AS scope, split_part(path, '.', -1) AS name,
         arg_max(value, seq) FILTER (cycle <= mid) AS value, bool_or(cycle > onset) AS moved
  FROM sw JOIN bounds USING (run_id) WHERE onset IS NOT NULL GROUP BY ALL HAVING bool_or(cycle <= mid)),
en AS (
  SELECT v.run_id, CAST(split_part(v.path, '_', -1) AS INTEGER) AS entry, coalesce(b.value, 0) <> 0 AS busy
  FROM st v LEFT JOIN st b ON v.run_id = b.run_id AND b.path = replace(v.path, 'rob_val_', 'rob_bsy_')
  WHERE v.name LIKE 'rob_val_%' AND v.value <> 0),
occ AS (
  SELECT r.run_id, count(e.entry) AS entries_valid, count(e.entry) FILTER (busy) AS entries_valid_and_busy,
         '[' || coalesce(string_agg(CAST(e.entry AS VARCHAR), ', ' ORDER BY e.entry), '') || ']' AS entries
  FROM (SELECT DISTINCT run_id FROM st) r LEFT JOIN en e USING (run_id) GROUP BY 1),
hs AS (
  SELECT v.run_id, replace(v.path, '_valid', '') AS stem,
         CASE WHEN v.value = 1 AND r.value = 0 THEN 'blocked' WHEN v.value = 0 AND r.value = 1 THEN 'starved' END AS kind
  FROM st v JOIN st r ON v.run_id = r.run_id AND r.path = replace(v.path, '_valid', '_ready')
  WHERE v.name = 'q_valid' AND NOT v.moved AND NOT r.moved),
hp AS (SELECT * FROM hs WHERE kind IS NOT NULL),
sm AS (SELECT run_id, scope, count(*) FILTER (moved) AS moved, count(*) AS total FROM st GROUP BY ALL),
act AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY moved DESC, scope) AS rn FROM sm WHERE moved > 0),
fz AS (
  SELECT run_id, count(*) FILTER (moved = 0) AS frozen,
         coalesce(array_to_string((array_agg(scope ORDER BY scope) FILTER (moved = 0))[1:8], ', '), '') AS scopes
  FROM sm GROUP BY 1),
cz AS (
  SELECT h.run_id, CASE WHEN v.value = 1 THEN 'stuck_entry' ELSE 'rob_empty' END AS item,
         CASE WHEN v.value = 1 AND coalesce(b.value, 0) <> 0 THEN b.path WHEN v.value = 1 THEN v.path
           ELSE 'top.core.rob.io_enq_valids_0' END AS root,
         CASE WHEN v.value = 1 AND coalesce(b.value, 0) <> 0 THEN 'head entry is valid and busy'
           WHEN v.value = 1 THEN 'head entry is valid and not busy' ELSE 'nothing is waiting: look upstream' END AS note
  FROM st h LEFT JOIN st v ON v.run_id = h.run_id AND v.path = 'top.core.rob.rob_val_' || h.value
  LEFT JOIN st b ON b.run_id = h.run_id AND b.path = 'top.core.rob.rob_bsy_' || h.value
  WHERE h.name = 'rob_head')
"""


def parts(spark, folder):
    b = ev.base(spark, folder)
    entry = F.col("user_id") % 4
    path = (
        F.when(F.col("event_type") == "view", F.concat(F.lit(ROB + "rob_val_"), entry))
        .when(F.col("event_type") == "click", F.concat(F.lit(ROB + "rob_bsy_"), entry))
        .when(F.col("event_type") == "error", F.concat(F.lit("top.core.u"), "user_id", F.lit(".q_valid")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("top.core.u"), "user_id", F.lit(".q_ready")))
        .otherwise(ROB + "rob_head")
    )
    head = F.col("event_type") == "purchase"
    # the head pointer is one signal of the whole run
    rows = b.withColumn("path", path).withColumn(
        "signal_id", F.when(head, -1 - F.col("run_id")).otherwise(F.col("signal_id"))
    ).withColumn("value", F.when(head, entry).otherwise(F.col("bit")))
    wave = rows.select("run_id", "signal_id", "time", "cycle", "value", "seq")
    signal = signal_catalog(rows.select("run_id", "signal_id", "path"))
    commits = b.where("event_type = 'purchase'").select("run_id", "cycle")
    bounds = stall.stall_bounds(wave, commits)
    return bounds, stall.stall_state(wave, signal, bounds)


@query("C01_stall_bounds", SQL + "SELECT run_id, onset, hi, stalled, mid, no_commits FROM bounds")
def c01(spark, folder):
    return parts(spark, folder)[0]


@query("C02_moved_since", SQL + "SELECT run_id, path FROM st WHERE moved")
def c02(spark, folder):
    return stall.moved_since(parts(spark, folder)[1])


@query("C03_occupancy", SQL + "SELECT * FROM occ")
def c03(spark, folder):
    return stall.occupancy(parts(spark, folder)[1], REPORT["valid_prefix"], REPORT["busy_prefix"])


@query("C04_handshakes", SQL + """
, c AS (SELECT run_id, count(*) FILTER (kind = 'blocked') AS blocked, count(*) FILTER (kind = 'starved') AS starved FROM hp GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY stem) AS rn FROM hp)
SELECT run_id, kind, stem, blocked, starved FROM r JOIN c USING (run_id) WHERE rn <= 20
""")
def c04(spark, folder):
    pairs = stall.handshakes(parts(spark, folder)[1])
    return stall.handshake_names(pairs).join(stall.handshake_counts(pairs), "run_id").drop("rank")


@query("C05_scope_activity", SQL + "SELECT run_id, scope, moved, total, (SELECT count(*) FROM act a WHERE a.run_id = act.run_id) > 10 AS truncated FROM act WHERE rn <= 10")
def c05(spark, folder):
    return stall.scope_activity(parts(spark, folder)[1]).drop("rank")


@query("C06_frozen_scopes", SQL + "SELECT run_id, frozen, scopes FROM fz")
def c06(spark, folder):
    return stall.frozen_scopes(parts(spark, folder)[1])


@query("C07_stall_cause_root", SQL + "SELECT run_id, item, root, note FROM cz")
def c07(spark, folder):
    return stall.cause_root(
        parts(spark, folder)[1], REPORT["head"], REPORT["valid_prefix"], REPORT["busy_prefix"], REPORT["banks"],
        REPORT["upstream"],
    )


@query("C08_stall_report", SQL + """
SELECT run_id, 1 AS section, 'stall' AS kind, 'last_retired_cycle' AS item, CAST(onset AS VARCHAR) AS value, 'after this, nothing committed' AS note FROM bounds WHERE NOT no_commits
UNION ALL SELECT run_id, 1, 'stall', 'last_recorded_cycle', CAST(hi AS VARCHAR), '' FROM bounds WHERE NOT no_commits
UNION ALL SELECT run_id, 1, 'stall', 'stalled_cycles', CAST(stalled AS VARCHAR), '' FROM bounds WHERE NOT no_commits
UNION ALL SELECT run_id, 2, 'rob', name, CAST(value AS VARCHAR), CASE WHEN moved THEN 'moving' ELSE 'frozen' END FROM st WHERE name = 'rob_head'
UNION ALL SELECT run_id, 3, 'rob', 'entries_valid', CAST(entries_valid AS VARCHAR), entries FROM occ
UNION ALL SELECT run_id, 3, 'rob', 'entries_valid_and_busy', CAST(entries_valid_and_busy AS VARCHAR), 'issued but not yet written back' FROM occ
UNION ALL SELECT r.run_id, 4, 'handshake', k, CAST(count(h.kind) AS VARCHAR), CASE k WHEN 'blocked' THEN 'the receiver refused' ELSE 'nothing was offered' END
  FROM (SELECT DISTINCT run_id, unnest(['blocked', 'starved']) AS k FROM st) r LEFT JOIN hp h ON h.run_id = r.run_id AND h.kind = k GROUP BY r.run_id, k
UNION ALL SELECT run_id, 5, 'handshake', kind || '_at', stem, CASE kind WHEN 'blocked' THEN 'look downstream of this' ELSE 'look upstream of this' END FROM hp
UNION ALL SELECT run_id, 6, 'activity', scope, moved || '/' || total, 'signals still changing' FROM act WHERE rn <= 10
UNION ALL SELECT run_id, 7, 'activity', 'fully_frozen_scopes', CAST(frozen AS VARCHAR), scopes FROM fz
UNION ALL SELECT run_id, 8, 'cause', item, root, note FROM cz
""")
def c08(spark, folder):
    bounds, state = parts(spark, folder)
    return stall.stall_report(bounds, state, **REPORT)
