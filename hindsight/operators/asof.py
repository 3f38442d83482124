"""Point-in-time questions over change logs, answered for all runs at once.

``wave``   (run_id, signal_id, time, cycle, value, seq): one row per change; ``seq``
           is the position in the dump, so it is a total order that agrees with time.
           A column ``value_str``, if there is one, holds what is no 64-bit number, and
           comes along wherever ``value`` does.
``signal`` (run_id, signal_id, path, scope, name): one row per NAME; several names
           may share an id, so values are aggregated per id and joined to names last.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindsight.functions.values import hex_text
from hindsight.operators.ordered import asof_join, previous, running
from hindsight.session import cut_lineage

ID = ["run_id", "signal_id"]


def _values(wave: DataFrame) -> list[str]:
    return [c for c in ("value", "value_str") if c in wave.columns]


def _named(values: DataFrame, signal: DataFrame) -> DataFrame:
    return values.join(signal.select("run_id", "signal_id", "path"), ID)


def state_at(wave: DataFrame, signal: DataFrame, cycle: int | Column) -> DataFrame:
    """Value of every name in effect at ``cycle``: its newest change at or before it."""
    latest = (
        wave.where(F.col("cycle") <= cycle)
        .groupBy(*ID)
        .agg(*[F.max_by(c, "seq").alias(c) for c in _values(wave)], F.max("cycle").alias("last_change"))
    )
    return _named(latest, signal).select("run_id", "path", *_values(wave), "last_change")


def changed_at(wave: DataFrame, signal: DataFrame, cycle: int) -> DataFrame:
    """Only names whose newest change is exactly at ``cycle``."""
    return state_at(wave.where(F.col("cycle") == cycle), signal, cycle)


def in_window(wave: DataFrame, signal: DataFrame, lo: int, hi: int) -> DataFrame:
    """Changes with lo <= cycle <= hi."""
    if hi < lo:
        raise ValueError("the end of a window must not come before its start")
    rows = wave.where(F.col("cycle").between(lo, hi))
    return _named(rows, signal).select("run_id", "path", "cycle", "time", *_values(wave))


def trace(wave: DataFrame, signal: DataFrame, lo: int, hi: int) -> DataFrame:
    """Changes in (lo, hi] of every name, led by the value it entered with."""
    entering = (
        wave.where(F.col("cycle") <= lo)
        .groupBy(*ID)
        .agg(*[F.max_by(c, "seq").alias(c) for c in ("cycle", "time", *_values(wave))])
        .withColumn("entering", F.lit(True))
    )
    inside = wave.where((F.col("cycle") > lo) & (F.col("cycle") <= hi)).select(
        *ID, "cycle", "time", *_values(wave), F.lit(False).alias("entering")
    )
    return _named(entering.unionByName(inside), signal).select(
        "run_id", "path", "cycle", "time", *_values(wave), "entering"
    )


def last_change(wave: DataFrame, signal: DataFrame, cycle: int) -> DataFrame:
    newest = wave.where(F.col("cycle") <= cycle).groupBy(*ID).agg(F.max("cycle").alias("last_change"))
    return _named(newest, signal).select("run_id", "path", "last_change")


def snapshot(wave: DataFrame, signal: DataFrame, cycles: Sequence[int]) -> DataFrame:
    """State at several cut points from one pass over the log."""
    upto = [F.when(F.col("cycle") <= c, F.col("seq")) for c in cycles]
    wide = wave.groupBy(*ID).agg(
        *[F.max_by(v, u).alias(f"{v}{i}") for v in _values(wave) for i, u in enumerate(upto)],
        *[F.max(F.when(F.col("cycle") <= c, F.col("cycle"))).alias(f"c{i}") for i, c in enumerate(cycles)],
    )
    cuts = F.array(
        *[
            F.struct(F.lit(c).cast("long").alias("at"), *[F.col(f"{v}{i}").alias(v) for v in _values(wave)], F.col(f"c{i}").alias("last_change"))
            for i, c in enumerate(cycles)
        ]
    )
    rows = wide.select(*ID, F.inline(cuts)).where(F.col("last_change").isNotNull())
    return _named(rows, signal).select("run_id", "path", "at", *_values(wave), "last_change")


def inflight(
    wave: DataFrame, signal: DataFrame, cycle: int, valid_prefix: str, pointers: Sequence[str]
) -> DataFrame:
    """Occupied entries (valid bit 1) and the pointer registers at ``cycle``."""
    entry = F.col("name").startswith(valid_prefix)
    wanted = signal.where(entry | F.col("name").isin(list(pointers)))
    ids = wanted.select(*ID).distinct()
    now = state_at(wave.join(ids, ID, "left_semi"), wanted, cycle)
    named = now.join(wanted.select("run_id", "path", "name"), ["run_id", "path"])
    return named.where(~entry | (F.col("value") == 1)).select(
        "run_id", "path", "name", "value", "last_change"
    )


def commits_near(commits: DataFrame, anchors: DataFrame, radius: int) -> DataFrame:
    """Commits within ``radius`` cycles of every anchor (run_id, at), with privilege and register where they are known.

    Each anchor names the 2*radius+1 cycles it covers, so the range condition is an
    equi-join on (run, cycle) and no run is ever paired with itself.
    """
    covered = anchors.select(
        "run_id", "at", F.explode(F.sequence(F.col("at") - radius, F.col("at") + radius)).alias("cycle")
    )
    return covered.join(commits, ["run_id", "cycle"]).select(
        "run_id", "at", "seq", "cycle", *[hex_text(F.col(c)).alias(c) for c in ("pc", "insn", "wdata")],
        *[c for c in ("priv", "regfile", "rd") if c in commits.columns],
    )


def rising_edges(wave: DataFrame, span: int | None = None) -> DataFrame:
    """Changes from 0 to 1."""
    steps = previous(wave, ID, ["time", "seq"], span, {"before": "value"})
    return steps.where("before = 0 AND value = 1").select(*ID, "time", "seq")


def cycle_index_edges(wave: DataFrame, span: int | None = None) -> DataFrame:
    """Edges numbered from 0; ``period`` only where all gaps are equal."""
    edges = cut_lineage(rising_edges(wave, span))
    one = F.lit(1).cast("long")
    numbered = cut_lineage(
        running(edges, ID, ["time", "seq"], span, last={"before": F.col("time")}, total={"cycle": one}, strict=True)
    )
    gap = F.col("time") - F.col("before")
    period = numbered.groupBy(*ID).agg(F.when(F.min(gap) == F.max(gap), F.min(gap)).alias("period"))
    return numbered.join(period, ID).select(*ID, "time", "cycle", "period")


def cycle_index_counter(wave: DataFrame) -> DataFrame:
    """Time-to-cycle index read from a counter's own changes."""
    return wave.select("run_id", "time", "seq", F.col("value").cast("long").alias("cycle"))


def assign_cycle(wave: DataFrame, index: DataFrame, span: int | None = None) -> DataFrame:
    """Cycle in effect at each change; NULL before the first index entry."""
    return asof_join(
        wave.drop("cycle"), index, ["run_id"], "time", "time", {"cycle": "cycle"}, span, right_tie=["seq"]
    )


def memory_hop(
    reads: DataFrame, enables: DataFrame, addresses: DataFrame, cycle: int, span: int | None = None
) -> DataFrame:
    """The write that put the value a read port returns at ``cycle``.

    reads (run_id, mem, cycle, seq, addr); enables (run_id, mem, port, cycle, seq, value);
    addresses (run_id, mem, port, cycle, seq, addr). Every raised enable is matched
    as-of to its port's address; of those aimed at the read address the newest wins,
    the lowest port on a tie.
    """
    upto = F.col("cycle") <= cycle
    read = (
        reads.where(upto)
        .groupBy("run_id", "mem")
        .agg(F.max_by("addr", "seq").alias("read_addr"))
    )
    raised = enables.where(upto & (F.col("value") == 1)).select("run_id", "mem", "port", "cycle")
    aimed = asof_join(
        raised, addresses.where(upto), ["run_id", "mem", "port"], "cycle", "cycle", {"addr": "addr"},
        span, right_tie=["seq"],
    )
    per_port = (
        aimed.join(read, ["run_id", "mem"])
        .where("addr = read_addr")
        .groupBy("run_id", "mem", "read_addr", "port")
        .agg(F.max("cycle").alias("write_cycle"))
    )
    best = F.min(F.struct((-F.col("write_cycle")).alias("late"), F.col("port")))
    return per_port.groupBy("run_id", "mem", "read_addr").agg(best.alias("w")).select(
        "run_id", "mem", "read_addr", (-F.col("w.late")).alias("write_cycle"), F.col("w.port").alias("port")
    )


def join_check(commits: DataFrame, samples: DataFrame, offsets: Sequence[int] = (-1, 0, 1)) -> DataFrame:
    """Share of commits whose cycle, shifted by each offset, is in the counter samples."""
    shifted = commits.select(
        "run_id", "cycle", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset")
    ).withColumn("cycle", F.col("cycle") + F.col("offset"))
    counted = shifted.groupBy("run_id", "cycle", "offset").agg(F.count("*").alias("n"))
    known = samples.select("run_id", "cycle").distinct().withColumn("hit", F.lit(1))
    return (
        counted.join(known, ["run_id", "cycle"], "left")
        .groupBy("offset")
        .agg(F.sum("n").alias("commits"), F.sum(F.col("n") * F.coalesce("hit", F.lit(0))).alias("matched"))
    )


def window_coverage(index: DataFrame, failures: DataFrame) -> DataFrame:
    """First and last cycle recorded per run, and whether the failure lies between."""
    bounds = index.groupBy("run_id").agg(F.min("cycle").alias("lo"), F.max("cycle").alias("hi"))
    inside = F.coalesce(F.col("at").between(F.col("lo"), F.col("hi")), F.lit(False))
    return bounds.join(failures.select("run_id", "at"), "run_id", "left").select(
        "run_id", "lo", "hi", "at", inside.alias("covered")
    )


def in_scopes(signal: DataFrame, scopes: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """Names under any of ``scopes`` and, when given, also among ``names``."""
    keep = F.lit(True)
    if scopes:
        keep = keep & reduce(lambda a, b: a | b, [F.col("path").startswith(s + ".") for s in scopes])
    if names:
        keep = keep & F.col("path").isin(list(names))
    return signal.where(keep)
