"""Running values along an ordered axis that stay balanced when one key is hot.

A plain window over ``partitionBy(key)`` puts a whole key into one task. Here the
axis is cut into chunks; every chunk is a window partition of its own and what
earlier chunks hand over is a one-row summary per chunk, built with a map-side
combine. The largest sort is one chunk of one key.

Chunks are ``span`` wide where the axis is known to be filled evenly, as line numbers
and positions are. Without a span they are ranges of about as many rows each: the rows
are dealt out by key and order and written, so that ranges stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindsight.session import cut_lineage

CHUNK = "_chunk"


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    span: int | None,
    *,
    last: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    strict: bool = False,
    reverse: bool = False,
) -> DataFrame:
    """Add the latest non-null value of each ``last`` and the sum of each ``total``.

    ``order[0]`` is the axis, numeric if there is a span, never NULL; together ``order`` must be a
    total order within a key. ``strict`` leaves the current row out, ``reverse``
    looks at the rows after it.
    """
    last, total, keys = dict(last or {}), dict(total or {}), list(keys)
    if span is None:
        cut = cut_lineage(df.repartitionByRange(*keys, *order).withColumn(CHUNK, F.spark_partition_id()))
    else:
        cut = df.withColumn(CHUNK, F.floor(F.col(order[0]) / F.lit(span)))
    place = F.struct(*order)
    pick = F.min_by if reverse else F.max_by
    parts = cut.groupBy(*keys, CHUNK).agg(
        *[pick(e, F.when(e.isNotNull(), place)).alias(f"_p_{n}") for n, e in last.items()],
        *[F.sum(e).alias(f"_p_{n}") for n, e in total.items()],
    )
    towards = F.desc if reverse else F.asc
    earlier = W.partitionBy(*keys).orderBy(towards(CHUNK)).rowsBetween(W.unboundedPreceding, -1)
    carry = parts.select(
        *keys,
        CHUNK,
        *[F.last(f"_p_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in last],
        *[F.sum(f"_p_{n}").over(earlier).alias(f"_c_{n}") for n in total],
    )
    inside = (
        W.partitionBy(*keys, CHUNK)
        .orderBy(*[towards(c) for c in order])
        .rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    )
    local = cut.select(
        "*",
        *[F.last(e, ignorenulls=True).over(inside).alias(f"_i_{n}") for n, e in last.items()],
        *[F.sum(e).over(inside).alias(f"_i_{n}") for n, e in total.items()],
    )
    return local.join(carry, [*keys, CHUNK]).select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(f"_i_{n}", f"_c_{n}").alias(n) for n in last],
        *[
            (F.coalesce(f"_i_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n)
            for n in total
        ],
    )


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], span: int | None, out: str
) -> DataFrame:
    """1-based dense position of every row within its key."""
    return running(df, keys, order, span, total={out: F.lit(1).cast("long")})


def ranked(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """1-based dense position of every row of the whole table, by columns of any type.

    The table is dealt out by range and written, so that ranges stay as they are; each is
    numbered on its own and begins after the rows of the ranges before it.
    """
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    begins = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    numbered = dealt.withColumn(out, inside).join(begins, "_range")
    return numbered.select(*df.columns, (F.col("_begin") + F.col(out)).alias(out))


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], span: int | None, cols: Mapping[str, str]
) -> DataFrame:
    """``lag`` of ``cols`` (output name -> column); NULLs in the row before count."""
    box = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    boxed = running(df, keys, order, span, last={"_prev": box}, strict=True)
    return boxed.select(*df.columns, *[F.col(f"_prev.{n}").alias(n) for n in cols])


def following(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], span: int | None, cols: Mapping[str, str]
) -> DataFrame:
    """``lead`` of ``cols`` (output name -> column)."""
    box = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    boxed = running(df, keys, order, span, last={"_next": box}, strict=True, reverse=True)
    return boxed.select(*df.columns, *[F.col(f"_next.{n}").alias(n) for n in cols])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    take: Mapping[str, str],
    span: int | None,
    *,
    right_tie: Sequence[str] = (),
) -> DataFrame:
    """Every left row with the newest right row whose ``right_at <= left_at``.

    Both sides go through one shuffle on (key, chunk). ``take`` maps output names
    to right columns; they are NULL where nothing came before.
    """
    ties = [f"_t{i}" for i in range(len(right_tie))]
    row = F.struct(*[F.col(c) for c in left.columns])
    asks = left.select(
        *keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), row.alias("_left")
    )
    answers = right.where(F.col(right_at).isNotNull()).select(
        *keys,
        F.col(right_at).alias("_at"),
        F.lit(0).alias("_side"),
        *[F.col(c).alias(t) for c, t in zip(right_tie, ties)],
        F.struct(*[F.col(c).alias(n) for n, c in take.items()]).alias("_right"),
    )
    both = answers.unionByName(asks.where(F.col("_at").isNotNull()), allowMissingColumns=True)
    seen = running(both, keys, ["_at", "_side", *ties], span, last={"_hit": F.col("_right")})
    return seen.where("_side = 1").select("_left.*", *[F.col(f"_hit.{n}").alias(n) for n in take])


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every key; the rank filter also runs before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def paged(
    df: DataFrame, keys: Sequence[str], position_col: str, item: Column, out: str, page: int = 64
) -> DataFrame:
    """Ordered lists cut into pages of ``page`` items, so no list outgrows a row."""
    at = F.col(position_col) - 1
    return (
        df.withColumn("page", F.floor(at / page))
        .groupBy(*keys, "page")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(position_col).alias("p"), item.alias("v")))).alias("_l"))
        .select(*keys, "page", F.array_join(F.transform("_l", lambda s: s["v"]), ", ").alias(out))
    )
