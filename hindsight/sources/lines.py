"""Text files as numbered lines, without reading a file in one piece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text), line numbers from 1.

    Files are read split by split. Lines are numbered within their split and moved up
    by the sizes of the splits before it, so a huge file is numbered by many tasks.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("text"),
    )
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = F.row_number().over(W.partitionBy("file", "block").orderBy("at"))
    return (
        raw.withColumn("k", within)
        .join(shift, ["file", "block"])
        .select("file", (F.col("shift") + F.col("k")).alias("line_no"), "text")
    )
