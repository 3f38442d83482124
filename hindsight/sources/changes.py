"""Change logs: catalogue, load, partitioned store, per-run facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindsight.functions.names import leaf_of, scope_of
from hindsight.functions.values import narrow_value, wide_value


def split_path(metas: DataFrame) -> DataFrame:
    return metas.withColumn("scope", scope_of(F.col("path"))).withColumn("name", leaf_of(F.col("path")))


def signal_catalog(metas: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per name with its lowest id, and its width and kind if known; names already stored are left alone.

    A name is never dropped because another name has the same id.
    """
    known = [F.min_by(c, F.struct("signal_id", c)).alias(c) for c in ("bitwidth", "var_type") if c in metas.columns]
    one = metas.groupBy("run_id", "path").agg(F.min("signal_id").alias("signal_id"), *known)
    if existing is not None:
        one = one.join(existing.select("run_id", "path"), ["run_id", "path"], "left_anti")
    return split_path(one)


def decode_values(raw: DataFrame, text: str = "raw") -> DataFrame:
    """``value`` for unsigned 64-bit, ``value_str`` for anything wider or not a number."""
    return raw.withColumn("value", narrow_value(F.col(text))).withColumn("value_str", wide_value(F.col(text)))


def write_changes(wave: DataFrame, path: str) -> None:
    """Append changes, one folder per run, sorted so files prune by signal and cycle."""
    (
        wave.repartition(F.col("run_id"), F.floor(F.col("seq") / 10_000_000))
        .sortWithinPartitions("run_id", "signal_id", "cycle")
        .write.mode("append").partitionBy("run_id").parquet(path)
    )


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def meta_latest(meta: DataFrame) -> DataFrame:
    """Per run and key the value written last."""
    return meta.groupBy("run_id", "key").agg(F.max_by("value", "seq").alias("value"))


def run_artifact(signal: DataFrame, wave: DataFrame, commits: DataFrame, findings: DataFrame) -> DataFrame:
    """Row counts and recorded window per run.

    Each input is reduced to one row per run before anything is joined.
    """
    def tally(df: DataFrame, name: str, *extra: Column) -> DataFrame:
        return df.groupBy("run_id").agg(F.count("*").alias(name), *extra)

    out = tally(wave, "changes", F.min("cycle").alias("lo"), F.max("cycle").alias("hi"))
    for df, name in ((signal, "signals"), (commits, "commits"), (findings, "findings")):
        out = out.join(tally(df, name), "run_id", "full")
    return out.select(
        "run_id", "lo", "hi",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("signals", "changes", "commits", "findings")],
    )
