"""A change store with keyframes: full states at regular cycles, written beside the changes.

The axis is cut into epochs of ``every`` cycles. Changes lie in one folder for each epoch, and so do keyframes: that of an
epoch holds the newest change before it of every signal that has one. What was in effect at a cycle is then in one
keyframe and the changes since, so a question about late cycles reads no more than one about early ones.

What ``upto`` and ``between`` return is a change log again, shorter but with the same answers, and goes wherever a log does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ID = ["run_id", "signal_id"]


class KeyframeStore:
    """Changes and keyframes below ``path``; columns run_id, signal_id, cycle, seq and whatever else changes have."""

    def __init__(self, spark: SparkSession, path: str, every: int | None = None):
        self.spark, self.path = spark, path
        self._every = every

    def _known(self) -> tuple[int, int]:
        """Cycles of an epoch and the last epoch, of which there may be several entries as the store grew."""
        row = self.spark.read.parquet(f"{self.path}/epochs").agg(F.max("every"), F.max("last")).first()
        return row[0], row[1]

    def write(self, wave: DataFrame) -> None:
        """Store a first log."""
        if not self._every:
            raise ValueError("a new store needs the number of cycles of an epoch")
        self._add(wave, self._every, None, None)

    def extend(self, wave: DataFrame) -> None:
        """Add a log whose changes all lie in epochs after those that are stored."""
        every, last = self._known()
        if not wave.where(F.col("cycle") < (last + 1) * every).isEmpty():
            raise ValueError(f"changes before cycle {(last + 1) * every} are stored already")
        self._add(wave, every, last, self._frame(last + 1))

    def _add(self, wave: DataFrame, every: int, before: int | None, carried: DataFrame | None) -> None:
        rows = wave.withColumn("epoch", F.floor(F.col("cycle") / F.lit(every)))
        last = rows.agg(F.max("epoch")).first()[0]
        if last is None:
            return
        rows.repartitionByRange("epoch", *ID).sortWithinPartitions("epoch", *ID, "cycle").write.mode("append").partitionBy("epoch").parquet(f"{self.path}/changes")
        rest = [c for c in wave.columns if c not in ID]
        ended = rows.groupBy(*ID, "epoch").agg(F.max_by(F.struct(*rest), "seq").alias("newest"))
        if carried is not None:
            ended = ended.unionByName(carried.select(*ID, F.lit(before).cast("long").alias("epoch"), F.struct(*rest).alias("newest")))
        # a state holds from the epoch after its change up to that of the next one
        until = F.coalesce(F.lead("epoch").over(W.partitionBy(*ID).orderBy("epoch")), F.lit(last + 1))
        first = F.col("epoch") + 1 if before is None else F.greatest(F.col("epoch") + 1, F.lit(before + 2))
        held = ended.withColumn("until", until).withColumn("first", first).where("first <= until")
        frames = held.select(*ID, "newest.*", F.explode(F.sequence("first", "until")).alias("epoch"))
        frames.repartitionByRange("epoch", *ID).write.mode("append").partitionBy("epoch").parquet(f"{self.path}/keyframes")
        self.spark.range(1).select(F.lit(every).cast("long").alias("every"), F.lit(last).cast("long").alias("last")).write.mode("append").parquet(f"{self.path}/epochs")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _frame(self, epoch: int) -> DataFrame:
        return self._table("keyframes").where(F.col("epoch") == epoch).drop("epoch")

    def keyframes(self) -> DataFrame:
        """All keyframes, by epoch."""
        return self._table("keyframes")

    def upto(self, cycle: int) -> DataFrame:
        """Changes with the same newest one of every signal at or before ``cycle`` as the whole log, none later."""
        return self.between(cycle, cycle)

    def between(self, lo: int, hi: int) -> DataFrame:
        """Changes in (lo, hi], and before them what a log needs to tell the state at ``lo``."""
        every, last = self._known()
        begin = min(lo // every, last + 1)
        changes = self._table("changes").where(F.col("epoch").between(begin, hi // every) & (F.col("cycle") <= hi))
        return self._frame(begin).unionByName(changes.drop("epoch"))
