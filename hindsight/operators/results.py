"""Answers that say whether they are complete, and the log of questions asked."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindsight.operators.ordered import first_n, running


def capped(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows and whether there were more; one extra row is read."""
    top = df.orderBy(*order).limit(limit + 1)
    seen = top.select("*", F.row_number().over(W.orderBy(*order)).alias("_rn"), F.count("*").over(W.partitionBy()).alias("_n"))
    return seen.where(F.col("_rn") <= limit).select(*df.columns, (F.col("_n") > limit).alias("truncated"))


def capped_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The same answer for every key at once."""
    more = first_n(df, keys, order, limit + 1)
    flags = more.groupBy(*keys).agg((F.max("rank") > limit).alias("truncated"))
    return more.where(F.col("rank") <= limit).join(flags, list(keys))


def char_budget(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], line: str, head: str,
    max_chars: int, span: int, max_width: int = 120,
) -> DataFrame:
    """The longest run of leading lines that fits ``max_chars`` under a header.

    A line counts and shows with its first ``max_width`` characters, as ``shown``; the line itself stays as it is, and
    ``cut`` says whether the two differ.
    """
    text = F.substring(F.col(line), 1, max_width)
    cost = (F.length(text) + 1).cast("long")
    wide = df.select("*", text.alias("shown"), (F.length(F.col(line)) > max_width).alias("cut"))
    sized = running(wide, keys, order, span, total={"used": cost})
    whole = df.groupBy(*keys).agg(F.sum(F.length(text) + 1).alias("_all"))
    room = max_chars - len(head) - 1
    return (
        sized.join(whole, list(keys))
        .where((F.col("used") <= room) | (F.col("_all") - 1 <= room))
        .withColumn("truncated", F.col("_all") - 1 > room)
        .drop("_all")
    )


# what no question needs: files as tables, names made of text, functions that call into the JVM
REFUSED = {
    r"\b\w+\s*\.\s*`[^`]*[/:][^`]*`": "files are no tables here",
    r"\bidentifier\s*\(": "names must stand as they are",
    r"\b(reflect|try_reflect|java_method)\s*\(": "this function is not for questions",
}


def _bare(text: str) -> str:
    """The text without comments and quoted strings, in lower case."""
    return re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", " ", text, flags=re.DOTALL).lower()


def as_question(text: str) -> str:
    """``text`` as a subquery, which no command can be; ValueError for what is refused."""
    bare = _bare(text)
    for pattern, why in REFUSED.items():
        if re.search(pattern, bare):
            raise ValueError(why)
    if ";" in bare.rstrip().removesuffix(";"):
        raise ValueError("one question at a time")
    if bare.rstrip().endswith(";"):
        text = text[: text.rindex(";")]
    return f"SELECT * FROM (\n{text}\n) AS question"


def _foreign(spark: SparkSession, text: str, names: set[str]) -> None:
    """ValueError where a question names a table of the session that it was not given."""
    bare = _bare(text)
    others = {t.name.lower() for t in spark.catalog.listTables()} - names
    bases = {d.name.lower() for d in spark.catalog.listDatabases()} | {c.name.lower() for c in spark.catalog.listCatalogs()} - names
    for name in others:
        if re.search(rf"(?<![\w.]){re.escape(name)}(?!\w)", bare):
            raise ValueError(f"no such table here: {name}")
    for name in bases:
        if re.search(rf"(?<![\w.])`?{re.escape(name)}`?\s*\.", bare):
            raise ValueError(f"no other database here: {name}")


def read_only_sql(spark: SparkSession, views: Mapping[str, DataFrame], text: str, limit: int | None = None) -> DataFrame:
    """A question over the named tables; with a ``limit``, its first rows and whether there were more.

    The question runs as a subquery over temporary views, so commands do not parse. Views the session had under the
    names stand again after. What does not parse or resolve is a ValueError.
    """
    wrapped, names = as_question(text), {v.lower() for v in views}
    _foreign(spark, text, names)
    had = {t.name.lower(): spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and t.name.lower() in names}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        out = spark.sql(wrapped)
    except (AnalysisException, ParseException) as wrong:
        raise ValueError(f"not a question: {str(wrong).splitlines()[0]}") from wrong
    finally:
        for name in views:
            if name.lower() in had:
                had[name.lower()].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
    return out if limit is None else capped(out, [F.col(f"`{c}`") for c in out.columns], limit)


def append_log(calls: DataFrame, path: str) -> None:
    """Add calls (run_id, op, rows_out, truncated, ms) to the log of questions."""
    calls.write.mode("append").parquet(path)


def query_log_summary(log: DataFrame) -> DataFrame:
    """Calls, truncated answers, rows and time by run and operation."""
    return log.groupBy("run_id", "op").agg(
        F.count("*").alias("calls"),
        F.count_if("truncated").alias("truncated"),
        F.sum("rows_out").alias("rows_out"),
        F.sum("ms").alias("ms"),
    )
