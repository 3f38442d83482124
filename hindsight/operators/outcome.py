"""What a run's evidence says about it: first faults, windows, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindsight.operators.ordered import first_n
from hindsight.operators.results import capped_per_key
from hindsight.session import cut_lineage

# Idle cycles before the liveness check fires, commits of lead for a
# hang, slack after it, and the tolerance when a window's end is checked.
HANG_IDLE, HANG_LEAD, HANG_SLACK, HANG_TOLERANCE = 8192, 512, 1024, 3


def first_findings(findings: DataFrame, limit: int = 10) -> DataFrame:
    """Per run the earliest findings that are not tolerated, those without a cycle last, and whether there were more."""
    return capped_per_key(findings.where("NOT tolerated"), ["run_id"], [F.asc_nulls_last("cycle"), F.col("line_no")], limit)


def lockstep_diff(commits: DataFrame, golden: DataFrame) -> DataFrame:
    """The first position of every run where two commit logs disagree.

    Both logs meet on (run, seq); a row missing on one side is a pc mismatch.
    """
    g = golden.select("run_id", "seq", F.col("pc").alias("g_pc"), F.col("wdata").alias("g_wdata"))
    both = commits.select("run_id", "seq", "pc", "wdata").join(g, ["run_id", "seq"], "full")
    kind = F.when(~F.col("pc").eqNullSafe(F.col("g_pc")), "pc").when(~F.col("wdata").eqNullSafe(F.col("g_wdata")), "wdata")
    bad = both.withColumn("kind", kind).where("kind IS NOT NULL")
    row = F.struct("seq", "kind", "pc", "g_pc", "wdata", "g_wdata")
    return bad.groupBy("run_id").agg(F.min_by(row, "seq").alias("d"), F.count("*").alias("mismatches")).select("run_id", "d.*", "mismatches")


def divergence_cycle(commits: DataFrame) -> DataFrame:
    """Cycle of the last commit that has one."""
    return commits.where("cycle IS NOT NULL").groupBy("run_id").agg(F.max_by("cycle", "seq").alias("cycle"))


def plan_window(commits: DataFrame, kinds: DataFrame, lead: int = 64, cycles: int = 512) -> DataFrame:
    """Where a recording of each run should start and how long it should be.

    commits (run_id, seq dense from 0, cycle, pc); kinds (run_id, kind). The anchor is
    ``lead`` commits before the end, named by its pc and how often that pc has retired.
    """
    commits = cut_lineage(commits.select("run_id", "seq", "cycle", "pc"))
    hang = F.col("kind") == "assertion"
    back = F.when(hang, F.greatest(F.lit(lead), F.lit(HANG_LEAD))).otherwise(lead)
    ends = commits.groupBy("run_id").agg(F.max("seq").alias("end"), F.max_by("cycle", "seq").alias("failure_cycle"))
    plan = ends.join(kinds, "run_id").select(
        "run_id", "kind", "end", "failure_cycle", F.greatest(F.lit(0), F.col("end") - back).alias("seq")
    )
    anchors = plan.join(
        commits.select("run_id", "seq", F.col("cycle").alias("anchor_cycle"), F.col("pc").alias("pc")), ["run_id", "seq"]
    ).withColumnRenamed("seq", "anchor_seq")
    retired = (
        commits.select("run_id", "pc", "seq").join(anchors.select("run_id", "pc", "anchor_seq"), ["run_id", "pc"])
        .where("seq <= anchor_seq").groupBy("run_id").agg(F.count("*").alias("occurrence"))
    )
    apart = F.when(
        F.coalesce("failure_cycle", F.lit(0)) != 0, F.col("failure_cycle") - F.coalesce("anchor_cycle", "failure_cycle")
    ).otherwise(0)
    span = F.when(hang, F.greatest(F.lit(cycles), apart + HANG_IDLE + HANG_SLACK)).otherwise(F.lit(cycles))
    return anchors.join(retired, "run_id").select(
        "run_id", "kind", "pc", "anchor_seq", "occurrence", "failure_cycle", span.cast("long").alias("cycles")
    )


def verify_windows(windows: DataFrame) -> DataFrame:
    """(…, covered): does each recorded window hold its failure.

    windows (kind, lo, hi, failure_cycle, last_commit, hung, asserted).
    """
    needed = F.coalesce("last_commit", F.lit(0)) + HANG_IDLE
    ok = (
        F.when(F.col("kind") == "divergence", F.col("failure_cycle").between(F.col("lo"), F.col("hi")))
        .when(F.col("hung"), F.abs(F.col("hi") - needed) <= HANG_TOLERANCE)
        .otherwise(F.col("asserted"))
    )
    return windows.withColumn("covered", F.coalesce(ok, F.lit(False)))


def window_totals(verified: DataFrame) -> DataFrame:
    return verified.groupBy("draw").agg(F.count_if("covered").alias("ok"), F.count("*").alias("n"))


def screen_verdict(runs: DataFrame) -> DataFrame:
    """One verdict per mutant from all its runs.

    runs (mutant, ladder_pos, oracle_active, diverged, asserted, timed_out, passed). A run
    neither oracle watched makes the screen invalid; otherwise the strongest kind of
    failure counts, and within it ladder order, never completion order.
    """
    all_silent = ~F.col("any_active") & ~F.col("any_passed")
    rank = (
        F.when(F.col("diverged"), 0).when(F.col("asserted"), 1).when(F.col("timed_out"), 2).when(~F.col("passed"), 3)
    )
    kinds = F.array(*[F.lit(k) for k in ("divergence", "assertion", "timeout", "crash")])
    failed_at = F.when(~F.col("passed"), F.col("ladder_pos"))
    per = runs.withColumn("rank", rank).groupBy("mutant").agg(
        F.count("*").alias("runs"), F.max(~F.col("oracle_active") & ~F.col("asserted")).alias("invalid"),
        F.max("oracle_active").alias("any_active"), F.max("passed").alias("any_passed"),
        F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "ladder_pos"))).alias("kill"),
        F.min_by(F.struct(F.when(F.col("asserted"), "assertion").otherwise("crash").alias("kind"), "ladder_pos"), failed_at).alias("silent"),
    )
    verdict = F.when(F.col("invalid"), "invalid").when(F.col("kill").isNotNull(), "killed").otherwise("survived")
    kind = F.when(all_silent, F.col("silent.kind")).otherwise(F.element_at(kinds, F.col("kill.rank") + 1))
    pos = F.when(all_silent, F.col("silent.ladder_pos")).otherwise(F.col("kill.ladder_pos"))
    killed = verdict == "killed"
    return per.select(
        "mutant", "runs", verdict.alias("verdict"), F.when(killed, kind).alias("kill_kind"), F.when(killed, pos).alias("stimulus")
    )


def baseline_passes(outcomes: DataFrame) -> DataFrame:
    """Stimuli a mutant passes unrepaired, and the names of those it fails.

    outcomes (mutant, stimulus, outcome); the names are bounded by the stimulus ladder.
    """
    failing = F.array_sort(F.collect_set(F.when(F.col("outcome") != "passed", F.concat_ws(":", "stimulus", "outcome"))))
    return outcomes.groupBy("mutant").agg(
        F.count_if(F.col("outcome") == "passed").alias("passed"), F.count("*").alias("total"),
        F.array_join(failing, ", ").alias("failing"),
    )


def baseline_range(passes: DataFrame) -> DataFrame:
    """The fewest and the most stimuli that any mutant passes unrepaired."""
    return passes.agg(F.min("passed").alias("least"), F.max("passed").alias("most"), F.max("total").alias("of"))


def baseline_violations(clean_runs: DataFrame) -> DataFrame:
    """Stimuli that fail or go unchecked on the unmodified design."""
    bad = clean_runs.where("NOT passed OR NOT oracle_active")
    return bad.groupBy("stimulus").agg(
        F.count("*").alias("violations"), F.count_if(~F.col("oracle_active")).alias("unchecked")
    )


def require_clean_baseline(clean_runs: DataFrame) -> None:
    bad = baseline_violations(clean_runs).limit(1).collect()
    if bad:
        raise ValueError(f"stimulus {bad[0].stimulus} fails or is unchecked on the unmodified design")


def fix_verdict(runs: DataFrame) -> DataFrame:
    """A repair holds when every stimulus was checked and passed; else the first that did not.

    runs (task, arm, ladder_pos, oracle_active, passed, reason).
    """
    bad = ~F.col("oracle_active") | ~F.col("passed")
    why = F.when(~F.col("oracle_active"), "cosim did not run").otherwise(F.coalesce("reason", F.lit("failed without a stated reason")))
    first = F.min_by(F.struct(F.col("ladder_pos").alias("first_failure"), why.alias("reason")), F.when(bad, F.struct("ladder_pos", why)))
    return runs.groupBy("task", "arm").agg(
        F.count_if(F.col("passed") & F.col("oracle_active")).alias("passed"), F.count("*").alias("total"), first.alias("f")
    ).select(
        "task", "arm", F.when(F.col("f").isNull(), "fixed").otherwise("not-fixed").alias("verdict"), "f.first_failure", "f.reason",
        "passed", "total",
    )


def build_failure_audit(patches: DataFrame, errors: DataFrame, logs: DataFrame) -> DataFrame:
    """Is each build failure the patch's own: own, contaminated, no-error-line or no-log.

    patches (run_id, path); errors (run_id, file); logs (run_id) that exist.
    """
    leaf = lambda c: F.substring_index(c, "/", -1)
    same = (F.col("path") != "") & (F.col("file").endswith(F.col("path")) | (leaf(F.col("file")) == leaf(F.col("path"))))
    judged = patches.join(errors, "run_id", "left").groupBy("run_id", "path").agg(
        F.count_if(F.coalesce(same, F.lit(False))).alias("own"),
        F.count_if(F.col("file").isNotNull() & ~F.coalesce(same, F.lit(False))).alias("other"),
    )
    found = logs.select("run_id").distinct().withColumn("_log", F.lit(True))
    tag = (
        F.when(F.col("_log").isNull(), "no-log").when((F.col("own") > 0) & (F.col("other") == 0), "own")
        .when(F.col("other") > 0, "contaminated").otherwise("no-error-line")
    )
    return judged.join(found, "run_id", "left").select("run_id", "path", tag.alias("tag"), "own", "other")
