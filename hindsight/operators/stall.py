"""Why a run stopped making progress: every section of the report for all runs.

All sections read one table, :func:`stall_state`: each name of a run with its value
at the middle of the stall and whether it moved after retirement stopped. It and the
bounds are written once, so a report costs one pass over the change log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindsight.operators.ordered import first_n
from hindsight.operators.results import capped_per_key
from hindsight.session import cut_lineage


def stall_bounds(wave: DataFrame, commits: DataFrame, onset: int | None = None) -> DataFrame:
    """Last retirement, last recorded cycle, stall length and its middle per run.

    A run without commits has no stall to date: its row says so and holds NULLs.
    """
    hi = wave.groupBy("run_id").agg(F.max("cycle").alias("hi"))
    if onset is None:
        out = hi.join(commits.groupBy("run_id").agg(F.max("cycle").alias("onset")), "run_id", "left")
    else:
        out = hi.withColumn("onset", F.lit(onset).cast("long"))
    length = F.col("hi") - F.col("onset")
    half = F.floor(length / 2)
    return cut_lineage(out.select(
        "run_id", "onset", "hi", length.alias("stalled"),
        (F.col("onset") + F.greatest(F.lit(1), half)).alias("mid"),
        F.col("onset").isNull().alias("no_commits"),
    ))


def stall_state(wave: DataFrame, signal: DataFrame, bounds: DataFrame) -> DataFrame:
    """(run_id, path, scope, name, value at mid, moved since onset)."""
    dated = bounds.where("NOT no_commits").select("run_id", "onset", "mid")
    per_id = (
        wave.join(dated, "run_id")
        .groupBy("run_id", "signal_id")
        .agg(
            F.max_by("value", F.when(F.col("cycle") <= F.col("mid"), F.col("seq"))).alias("value"),
            F.coalesce(F.max(F.col("cycle") <= F.col("mid")), F.lit(False)).alias("_seen"),
            F.coalesce(F.max(F.col("cycle") > F.col("onset")), F.lit(False)).alias("moved"),
        )
        .where("_seen")
        .drop("_seen")
    )
    names = signal.select("run_id", "signal_id", "path", "scope", "name")
    return cut_lineage(per_id.join(names, ["run_id", "signal_id"]).drop("signal_id"))


def moved_since(state: DataFrame) -> DataFrame:
    return state.where("moved").select("run_id", "path")


def pointer_state(state: DataFrame, pointers: Sequence[str]) -> DataFrame:
    return state.where(F.col("path").isin(list(pointers))).select(
        "run_id", "name", "value", F.when(F.col("moved"), "moving").otherwise("frozen").alias("note")
    )


def _entries(state: DataFrame, prefix: str, out: str) -> DataFrame:
    """Per-entry bits below ``prefix``, keyed by the trailing number."""
    return state.where(F.col("path").startswith(prefix)).select(
        "run_id", F.regexp_extract("path", r"_(\d+)$", 1).cast("int").alias("entry"), F.col("value").alias(out)
    )


def occupancy(state: DataFrame, valid_prefix: str, busy_prefix: str, shown: int = 16) -> DataFrame:
    """Valid entries, those of them still busy, and the first ``shown`` valid ones."""
    valid = _entries(state, valid_prefix, "valid").where("valid <> 0")
    busy = _entries(state, busy_prefix, "busy").where("busy <> 0")
    held = valid.join(busy, ["run_id", "entry"], "left")
    counts = held.groupBy("run_id").agg(F.count("*").alias("n_valid"), F.count("busy").alias("n_busy"))
    listed = (
        first_n(valid, ["run_id"], [F.col("entry")], shown)
        .groupBy("run_id")
        .agg(F.array_sort(F.collect_list("entry")).alias("e"))
        .select("run_id", F.concat(F.lit("["), F.array_join("e", ", "), F.lit("]")).alias("entries"))
    )
    return (
        state.select("run_id").distinct()
        .join(counts, "run_id", "left").join(listed, "run_id", "left")
        .select(
            "run_id", F.coalesce("n_valid", F.lit(0)).alias("entries_valid"),
            F.coalesce("n_busy", F.lit(0)).alias("entries_valid_and_busy"),
            F.coalesce("entries", F.lit("[]")).alias("entries"),
        )
    )


def handshakes(state: DataFrame) -> DataFrame:
    """Valid/ready pairs of which neither moved: blocked (1,0) or starved (0,1)."""
    def side(suffix: str, out: str) -> DataFrame:
        return state.where(F.col("path").endswith(suffix)).select(
            "run_id", F.expr(f"substring(path, 1, length(path) - {len(suffix)})").alias("stem"),
            F.col("value").alias(out), F.col("moved").alias(f"{out}_moved"),
        )

    pairs = side("_valid", "valid").join(side("_ready", "ready"), ["run_id", "stem"])
    kind = F.when((F.col("valid") == 1) & (F.col("ready") == 0), "blocked").when(
        (F.col("valid") == 0) & (F.col("ready") == 1), "starved"
    )
    return (
        pairs.where("NOT valid_moved AND NOT ready_moved")
        .select("run_id", "stem", kind.alias("kind"))
        .where("kind IS NOT NULL")
    )


def handshake_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "blocked").alias("blocked"), F.count_if(F.col("kind") == "starved").alias("starved")
    )


def handshake_names(pairs: DataFrame, shown: int = 20) -> DataFrame:
    return first_n(pairs, ["run_id", "kind"], [F.col("stem")], shown)


def _scope_moves(state: DataFrame) -> DataFrame:
    return state.groupBy("run_id", "scope").agg(F.count_if("moved").alias("moved"), F.count("*").alias("total"))


def scope_activity(state: DataFrame, shown: int = 10) -> DataFrame:
    """The ``shown`` scopes with most names still moving, and whether there were more."""
    live = _scope_moves(state).where("moved > 0")
    return capped_per_key(live, ["run_id"], [F.desc("moved"), F.col("scope")], shown)


def frozen_scopes(state: DataFrame, shown: int = 8) -> DataFrame:
    """How many scopes have nothing moving, and the first ``shown`` of them."""
    moves = _scope_moves(state)
    dead = moves.where("moved = 0")
    counts = moves.groupBy("run_id").agg(F.count_if(F.col("moved") == 0).alias("frozen"))
    listed = (
        first_n(dead, ["run_id"], [F.col("scope")], shown)
        .groupBy("run_id").agg(F.array_sort(F.collect_list("scope")).alias("s"))
        .select("run_id", F.array_join("s", ", ").alias("scopes"))
    )
    return counts.join(listed, "run_id", "left").withColumn("scopes", F.coalesce("scopes", F.lit("")))


def cause_root(
    state: DataFrame, head: str, valid_stem: str, busy_stem: str, banks: Sequence[str], upstream: str
) -> DataFrame:
    """Which signal to explain: the stuck head entry, or what feeds an empty queue.

    ``head`` is the full path of the head pointer; an entry's bits are
    ``<stem><bank><head>``. Of the banks in listed order the first valid one counts.
    """
    heads = state.where(F.col("path") == head).select("run_id", F.col("value").alias("head"))
    wanted = heads.select("run_id", "head", F.inline(F.array(*[
        F.struct(F.lit(i).alias("bank_no"), F.lit(b).alias("bank")) for i, b in enumerate(banks)
    ])))
    values = state.select("run_id", "path", "value")

    def bit(stem: str, out: str) -> DataFrame:
        return values.select("run_id", F.col("path").alias(f"{out}_path"), F.col("value").alias(out))

    key = F.concat("bank", F.col("head").cast("string"))
    placed = (
        wanted.withColumn("v_path", F.concat(F.lit(valid_stem), key))
        .withColumn("b_path", F.concat(F.lit(busy_stem), key))
        .join(bit(valid_stem, "v"), ["run_id", "v_path"], "left")
        .join(bit(busy_stem, "b"), ["run_id", "b_path"], "left")
    )
    busy = F.coalesce(F.col("b") != 0, F.lit(False))
    pick = F.struct(
        F.lit("stuck_entry").alias("item"), F.when(busy, F.col("b_path")).otherwise(F.col("v_path")).alias("root"),
        F.when(busy, "head entry is valid and busy").otherwise("head entry is valid and not busy").alias("note"),
    )
    empty = F.struct(F.lit("rob_empty").alias("item"), F.lit(upstream).alias("root"), F.lit("nothing is waiting: look upstream").alias("note"))
    first_valid = F.min_by(pick, F.when(F.col("v") == 1, F.col("bank_no")))
    return placed.groupBy("run_id").agg(F.coalesce(first_valid, empty).alias("c")).select("run_id", "c.*")


def stall_report(
    bounds: DataFrame, state: DataFrame, *, pointers: Sequence[str], valid_prefix: str, busy_prefix: str,
    head: str, banks: Sequence[str], upstream: str, causes: DataFrame | None = None,
) -> DataFrame:
    """All sections as (run_id, section, kind, item, value, note) rows.

    ``causes`` (run_id, item, value, note) adds the links explaining the chosen root.
    """
    def rows(df: DataFrame, section: int, kind: str | Column, item: Column, value: Column, note: Column) -> DataFrame:
        return df.select(
            "run_id", F.lit(section).alias("section"), F.lit(kind).alias("kind"), item.alias("item"),
            value.cast("string").alias("value"), note.alias("note"),
        )

    def facts(df: DataFrame, section: int, kind: str, items: Sequence[tuple[str, Column, Column]]) -> DataFrame:
        packed = F.array(*[
            F.struct(F.lit(i).alias("item"), v.cast("string").alias("value"), n.alias("note")) for i, v, n in items
        ])
        return df.select("run_id", F.lit(section).alias("section"), F.lit(kind).alias("kind"), F.inline(packed))

    none = F.lit("")
    pairs = handshakes(state)
    dated = state.select("run_id").distinct()
    counts = dated.join(handshake_counts(pairs), "run_id", "left")
    names = handshake_names(pairs)
    active = scope_activity(state)
    parts = [
        facts(bounds.where("NOT no_commits"), 1, "stall", [
            ("last_retired_cycle", F.col("onset"), F.lit("after this, nothing committed")),
            ("last_recorded_cycle", F.col("hi"), none),
            ("stalled_cycles", F.col("stalled"), none),
        ]),
        rows(pointer_state(state, pointers), 2, "rob", F.col("name"), F.col("value"), F.col("note")),
        facts(occupancy(state, valid_prefix, busy_prefix), 3, "rob", [
            ("entries_valid", F.col("entries_valid"), F.col("entries")),
            ("entries_valid_and_busy", F.col("entries_valid_and_busy"), F.lit("issued but not yet written back")),
        ]),
        facts(counts, 4, "handshake", [
            ("blocked", F.coalesce("blocked", F.lit(0)), F.lit("the receiver refused")),
            ("starved", F.coalesce("starved", F.lit(0)), F.lit("nothing was offered")),
        ]),
        rows(names, 5, "handshake", F.concat("kind", F.lit("_at")), F.col("stem"),
             F.when(F.col("kind") == "blocked", "look downstream of this").otherwise("look upstream of this")),
        rows(active, 6, "activity", F.col("scope"), F.concat("moved", F.lit("/"), "total"), F.lit("signals still changing")),
        facts(frozen_scopes(state), 7, "activity", [("fully_frozen_scopes", F.col("frozen"), F.col("scopes"))]),
        rows(cause_root(state, head, valid_prefix, busy_prefix, banks, upstream), 8, "cause",
             F.col("item"), F.col("root"), F.col("note")),
    ]
    if causes is not None:
        parts.append(rows(causes, 9, "cause", F.col("item"), F.col("value"), F.col("note")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
