"""Finding names: search, scopes, selection, resolution, block mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindsight.functions.names import leaf_of, under_scope
from hindsight.operators.ordered import first_n
from hindsight.operators.results import capped_per_key


def find_signals(signal: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """First ``limit`` names of each run that match a regular expression anywhere, and whether there were more."""
    known = [c for c in ("bitwidth", "var_type") if c in signal.columns]
    hits = signal.where(F.col("path").rlike(pattern)).select("run_id", "path", *known)
    return capped_per_key(hits, ["run_id"], [F.col("path")], limit)


def scopes(signal: DataFrame, under: str = "") -> DataFrame:
    """Number of names in every scope below a prefix."""
    return (
        signal.where(F.col("scope").startswith(under))
        .groupBy("run_id", "scope")
        .agg(F.count("*").alias("signals"))
    )


def scope_select(signal: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Names under any prefix, with the prefixes that took them counted."""
    taken = [under_scope(F.col("path"), p) for p in prefixes]
    n = sum((F.when(t, 1).otherwise(0) for t in taken), F.lit(0))
    return signal.withColumn("matches", n).where("matches > 0")


def unmatched_prefixes(signal: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Prefixes that select nothing in any run; strict selection wants none."""
    seen = signal.agg(*[F.coalesce(F.max(under_scope(F.col("path"), p)), F.lit(False)).alias(f"p{i}") for i, p in enumerate(prefixes)])
    flags = F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"p{i}").alias("hit")) for i, p in enumerate(prefixes)])
    return seen.select(F.inline(flags)).where("NOT hit").select("prefix")


def select_strict(signal: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    missing = [r.prefix for r in unmatched_prefixes(signal, prefixes).collect()]
    if missing:
        raise ValueError(f"no signal under {', '.join(missing)}")
    return scope_select(signal, prefixes)


def resolve_names(requests: DataFrame, signal: DataFrame, suggestions: int = 3) -> DataFrame:
    """Which requested names (run_id, name) exist; for the others, same-leaf names.

    The suggestions are cut per (run, leaf) before the join, so a common leaf never
    multiplies the requests by more than ``suggestions``.
    """
    asked = requests.select("run_id", "name").distinct()
    known = signal.select("run_id", F.col("path").alias("name"))
    found = asked.join(known, ["run_id", "name"], "left_semi").withColumn("found", F.lit(True))
    missing = asked.join(known, ["run_id", "name"], "left_anti")
    by_leaf = first_n(
        signal.select("run_id", leaf_of(F.col("path")).alias("leaf"), F.col("path").alias("suggestion")),
        ["run_id", "leaf"], [F.col("suggestion")], suggestions,
    )
    hinted = (
        missing.withColumn("leaf", leaf_of(F.col("name")))
        .join(by_leaf, ["run_id", "leaf"], "left")
        .select("run_id", "name", F.lit(False).alias("found"), "suggestion")
    )
    return found.withColumn("suggestion", F.lit(None).cast("string")).unionByName(hinted)


def block_of(path: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Block of the first rule in listed order whose prefix fits."""
    out = F
    for prefix, block in rules:
        out = out.when(path.startswith(prefix), block)
    return out.otherwise(default) if rules else F.lit(default)
