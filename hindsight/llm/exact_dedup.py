"""Exact deduplication against a persistent digest index.

The index is a table of one row for each text seen so far, bucketed and sorted by digest. A batch of new
documents is reduced to its digests, a sort-merge anti-join leaves the digests the index lacks, and those are
appended. Only digests and ids move; texts stay where they were read.

Defined results: a null text is an empty one; texts are equal when they agree after lower-casing A-Z. Of
equal texts in one batch the largest id stays, null being the smallest; across batches the first batch wins.
Rows that repeat id and text count in the group, and one of them stays. An empty batch adds nothing. Other
columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindsight.llm.text import ascii_lower, whole
from hindsight.session import cut_lineage, shared_folder

#: Parts of a group that are joined apart from each other, so that no group of copies meets in one task.
SALTS = 64


def digest_of(text: str = "text") -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(whole(text)), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest: one row for each row of ``docs``, written once since what follows reads it several times."""
    return cut_lineage(docs.select(F.col(id_col).alias("doc_id"), digest_of(text_col).alias("digest")))


class DigestIndex:
    """A bucketed, sorted table of (digest, keep_id, batch).

    ``path`` may hold an index of an earlier run, which is then carried on.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64, id_type: str = "bigint"):
        self.spark = spark
        self.buckets = buckets
        self.path = path or f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/digests-{uuid.uuid4().hex}"
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, found: DataFrame, batch: str) -> None:
        """Append the digests of ``found`` (doc_id, digest) that the index lacks, each with its largest id."""
        new = found.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        fresh = new.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        # by bucket, so that a batch adds one file to each whatever the number of tasks
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        out = fresh.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, bucket)
        out.write.insertInto(self.name)


def decide(found: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for each row of ``found``; all its digests are in the index.

    Group sizes are summed in two steps and handed back along (digest, salt): a group of any size is
    joined in ``SALTS`` parts, and the second step sees at most that many rows of a digest.
    """
    rows = found.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("digest", "salt").agg(F.sum("n").alias("part"))
    sized = parts.withColumn("group_size", F.sum("part").over(Window.partitionBy("digest"))).drop("part")
    known = sized.join(index.rows().select("digest", "keep_id").hint("merge"), "digest")
    each = salted.join(known, ["digest", "salt"])
    out = each.select("doc_id", "keep_id", "group_size", "digest", F.posexplode(F.expr("sequence(1, n)")).alias("copy", "_"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """Decide on every row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    The rows reach the index in ``batches``, those with the largest ids first, so that the first to come
    is the one to stay.
    """
    spark = docs.sparkSession
    found = digests(docs, id_col, text_col)
    if index is None:
        index = DigestIndex(spark, id_type=dict(found.dtypes)["doc_id"])
    cuts = found.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    edges = [None, *sorted(set(cuts or []), reverse=True), None]
    for i, (upper, lower) in enumerate(zip(edges, edges[1:], strict=False)):
        part = found
        if upper is not None:
            part = part.where((F.col("doc_id") <= F.lit(upper)) | F.col("doc_id").isNull())
        if lower is not None:
            part = part.where(F.col("doc_id") > F.lit(lower))
        index.add(part, f"batch-{i}")
    return decide(found, index)
