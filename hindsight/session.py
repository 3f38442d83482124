"""Session settings and lineage cutting shared by the iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "hindsight", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and the clock pinned to UTC."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """A new folder of this application below the shared one."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


class Bucketed:
    """A table in the shared folder that is dealt out by ``keys`` once, so that joins and sums by them need no shuffle.

    It has as many buckets as the session has shuffle partitions, which is what the other side of a join is dealt into.
    Rows may be appended, each time under the next number of ``step``; they are dealt out before they are written, so that
    a step has one file a bucket, however many tasks made it. ``drop`` takes the name out of the catalogue; the
    files stay with the other copies of the application, and what ``rows`` returned goes on reading them.
    """

    def __init__(self, spark: SparkSession, keys: list[str]):
        self.spark, self.keys, self.steps = spark, keys, 0
        self.path, self.name = own_folder(spark), f"bucketed_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, df: DataFrame) -> int:
        """Add the rows of the next step; how many they are."""
        seen = Observation()
        dealt = df.repartition(self.buckets, *self.keys)  # no shuffle where they are dealt so already
        counted = dealt.observe(seen, F.count(F.lit(1)).alias("rows")).withColumn("step", F.lit(self.steps))
        with freed(self.spark):
            writer = counted.write.mode("append").format("parquet").option("path", self.path)
            writer.partitionBy("step").bucketBy(self.buckets, *self.keys).saveAsTable(self.name)
        self.steps += 1
        return seen.get["rows"]

    def table(self, step: int | None = None, before: int | None = None) -> DataFrame:
        """All rows, those of one step, or those of the steps before one; for joins by the keys."""
        rows = self.spark.table(self.name)
        rows = rows if before is None else rows.where(F.col("step") < before)
        return (rows if step is None else rows.where(F.col("step") == step)).drop("step")

    def rows(self) -> DataFrame:
        """All rows, independent of the catalogue."""
        schema = self.spark.table(self.name).schema
        return self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it has ended, and not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read on from there.

    The copy outlives any executor, so a lost one costs a re-read and not the rounds
    that led up to it; and its size is known to the joins that follow. All copies of an
    application are in one subfolder, which may go when the application has ended.
    """
    spark = df.sparkSession
    path = own_folder(spark)
    for noted in _NOTED:
        noted.append(path)
    with freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``cut_lineage``, dealt out by ``keys``, so that joins and sums by them need no shuffle.

    The name leaves the catalogue at once; what is returned goes on reading the files, by their buckets.
    """
    spark, path, name = df.sparkSession, own_folder(df.sparkSession), f"dealt_{uuid.uuid4().hex}"
    for noted in _NOTED:
        noted.append(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with freed(spark):
        df.repartition(buckets, *keys).write.format("parquet").option("path", path).bucketBy(buckets, *keys).saveAsTable(name)
    copy = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return copy


#: Rows that a join may broadcast; the driver holds them, what is built of them and what is sent, several at a time.
SENT = 10_000


def by_rows(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows, as a side of joins: broadcast up to ``SENT`` rows, merged beyond.

    Left to itself, Spark takes the compressed size of a file for that of its rows, and millions
    of them would be built into one table on the driver.
    """
    return F.broadcast(df) if rows <= SENT else df.hint("merge")


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_lineage``, and how many rows were written."""
    seen = Observation()
    copy = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return copy, seen.get["rows"]


#: Where ``cut_lineage`` and ``cut_dealt`` note their folders, if anywhere.
_NOTED: list[list[str]] = []


@contextmanager
def noted_copies() -> Iterator[list[str]]:
    """The folders that ``cut_lineage`` and ``cut_dealt`` write inside, for ``remove_copies``."""
    _NOTED.append([])
    try:
        yield _NOTED[-1]
    finally:
        _NOTED.pop()


def remove_copies(spark: SparkSession, folders: list[str]) -> None:
    """Remove written copies; only for when whatever was made of them is stored elsewhere."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
