"""Ledgers and manifests: JSON lines in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_ledger(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """JSON lines with the name of the file each row came from."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path).withColumn("file", F.col("_metadata.file_name"))


def ledger_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def append_ledger(rows: DataFrame, path: str) -> None:
    ledger_lines(rows).write.mode("append").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A one-row summary as one JSON file."""
    ledger_lines(summary).coalesce(1).write.mode("overwrite").text(path)


def load_tasks(
    manifest: DataFrame, recaptures: DataFrame, kinds: Sequence[str] = ("divergence", "assertion")
) -> DataFrame:
    """Killed mutants of the wanted kinds, one row each from their first draw.

    manifest (task, draw, seq, verdict, kind, dump); a re-captured dump (task, dump)
    takes the place of the first one.
    """
    killed = manifest.where((F.col("verdict") == "killed") & F.col("kind").isin(list(kinds)))
    first = killed.groupBy("task").agg(F.min_by(F.struct("draw", "kind", "dump"), F.struct("draw", "seq")).alias("t"))
    newer = recaptures.groupBy("task").agg(F.max("dump").alias("_dump"))
    return first.join(newer, "task", "left").select(
        "task", "t.draw", "t.kind", F.coalesce("_dump", "t.dump").alias("dump")
    )
