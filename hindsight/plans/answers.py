"""Blame answers written from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.operators import score
from hindsight.plans.registry import query, table

SQL = """
WITH a AS (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Rob' || (o_custkey % 5) WHEN 'O' THEN 'the rob3 unit' END AS module,
         CASE WHEN o_custkey % 9 <> 0 THEN 'io_' || (o_custkey % 20) || '.x' END AS signal,
         CASE o_orderkey % 3 WHEN 0 THEN o_orderkey WHEN 1 THEN CAST(nullif(regexp_extract(printf('%x', o_orderkey), '[0-9]+'), '') AS BIGINT) END AS cycle,
         CASE o_orderkey % 3 WHEN 0 THEN format('{:,}', o_orderkey) WHEN 1 THEN printf('%x', o_orderkey) ELSE 'UNKNOWN' END AS said,
         'Rob' || (o_custkey % 4) AS true_module, o_orderkey + o_custkey % 120 - 60 AS true_cycle, 'io_' || (o_orderkey % 20) AS target FROM orders),
s AS (
  SELECT *, coalesce(list_contains(regexp_extract_all(lower(module), '[a-z0-9_$]+'), lower(true_module)), FALSE) AS module_hit,
         coalesce(split_part(signal, '.', 1) = target, FALSE) AS signal_hit, coalesce(abs(cycle - true_cycle) <= 50, FALSE) AS cycle_hit,
         module IS NOT NULL OR signal IS NOT NULL OR cycle IS NOT NULL AS answered, regexp_extract(said, '^[0-9a-f]+') AS tok FROM a)
"""


def answers(spark, folder) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    module = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Rob"), c % 5)).when(F.col("o_orderstatus") == "O", "the rob3 unit").otherwise("UNKNOWN")
    signal = F.when(c % 9 == 0, "n/a").otherwise(F.concat(F.lit("io_"), c % 20, F.lit(".x")))
    cycle = F.when(k % 3 == 0, F.format_number(k, 0)).when(k % 3 == 1, F.lower(F.hex(k))).otherwise("UNKNOWN")
    return table(spark, folder, "orders").select(
        "o_orderkey", F.concat(F.lit("I think\nmodule: "), module, F.lit("\n Signal : "), signal, F.lit("\nCYCLE: "), cycle, F.lit("\nMODULE: Late")).alias("answer"),
        F.concat(F.lit("Rob"), c % 4).alias("true_module"), F.lit("val x2").alias("true_before"),
        F.concat(F.lit("when (io_"), k % 20, F.lit(") of io")).alias("true_context"), (k + c % 120 - 60).alias("true_cycle"),
    )


@query("G01_parse_blame", SQL + "SELECT o_orderkey, module, signal, cycle FROM s")
def g01(spark, folder):
    return score.parse_blame(answers(spark, folder)).select("o_orderkey", "module", "signal", "cycle")


@query("G02_score_blame", SQL + "SELECT o_orderkey, module_hit, signal_hit, cycle_hit, answered FROM s")
def g02(spark, folder):
    return score.score_blame(answers(spark, folder)).select("o_orderkey", "module_hit", "signal_hit", "cycle_hit", "answered")


@query("G03_cycle_any_base", SQL + """
SELECT o_orderkey, coalesce(abs(TRY_CAST(tok AS BIGINT) - true_cycle) <= 50, FALSE) OR coalesce(abs(TRY_CAST('0x' || tok AS BIGINT) - true_cycle) <= 50, FALSE) AS hit FROM s
""")
def g03(spark, folder):
    return answers(spark, folder).select("o_orderkey", score.cycle_any_base(F.col("answer"), F.col("true_cycle")).alias("hit"))
