"""Column helpers shared by the corpus operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindsight.session import cut_lineage


def whole(text: str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; text of one byte a character takes the short way to the same result."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def keep_rows(docs: DataFrame, decided: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (a row for each of ``docs``, with ``kept``) keeps, with the columns of ``docs``.

    ``keys`` maps columns of ``decided`` to what they equal in ``docs``; nulls equal nulls. Of rows that agree in all keys one
    stays if any does. Only the keys of which not every row stays are written, and meet the rows in a join that is merged
    whatever their number, so that small inputs move as much, in proportion, as large ones.
    """
    own = [f"__key_{i}" for i in range(len(keys))]
    told = decided.groupBy(*[F.col(k).alias(o) for o, k in zip(own, keys, strict=True)]).agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__n"))
    told = cut_lineage(told.where("NOT __kept OR __n > 1"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *[c.alias(o) for o, c in zip(own, keys.values(), strict=True)])

    def those(how: str, of: DataFrame) -> DataFrame:
        return rows.join(of.hint("merge"), [rows[o].eqNullSafe(of[o]) for o in own], how)

    once = those("left_semi", told.where("__kept")).groupBy(*own).agg(F.first("__row").alias("__row"))
    return those("left_anti", told).select("__row.*").unionByName(once.select("__row.*"))
