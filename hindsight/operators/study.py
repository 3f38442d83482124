"""Paired study statistics over an episode ledger.

A ledger row is one episode: task, arm, seed, verdict, stop, tokens, queries, seconds,
same_file, kind, model, file and ``eid``, a total order standing for file order. Rates
and means are kept as decimals until the end, so sums do not depend on task order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindsight.operators.ordered import first_n, paged, position
from hindsight.operators.resample import REPS, bootstrap_ci, percentile_interval, replicate_sums
from hindsight.session import cut_lineage

RATE = "decimal(18,9)"
EPISODE = ["task", "arm", "seed", "tokens", "queries", "seconds"]


def is_lost() -> Column:
    """NULL stop or verdict is not a loss."""
    return F.coalesce(F.col("stop") == "error", F.lit(False)) | F.coalesce(F.col("verdict") == "lost", F.lit(False))


def scored(ledger: DataFrame) -> DataFrame:
    return ledger.where(~is_lost())


def lost_by_arm(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("arm").agg(F.count_if(is_lost()).alias("lost"), F.count_if(~is_lost()).alias("scored"))


def drop_overlap(rows: DataFrame, overlap: DataFrame, key: str = "task") -> DataFrame:
    """Leave out rows whose key is listed (tag, id) under a tag their file name holds."""
    tokens = F.split("file", "[-_.]")
    listed = overlap.select(F.col("id").alias("_id"), F.col("tag").alias("_tag"))
    return rows.join(listed, (F.col(key) == F.col("_id")) & F.array_contains(tokens, F.col("_tag")), "left_anti")


def supersede(rows: DataFrame, keys: Sequence[str], order: str = "eid") -> DataFrame:
    """One row per key: a re-screened one beats any other, then the latest wins."""
    first = ["rescreen", order]
    row = F.max(F.struct(*first, *[c for c in rows.columns if c not in first]))  # each column once in what is shuffled
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(row.alias("r")).select(*[f"r.{c}" for c in rows.columns])


def _identified(rows: DataFrame, keep: Sequence[str] | None) -> tuple[DataFrame, list[str], Column]:
    """``rows`` with a seed, the columns of theirs to ``keep``, and these with ``eid`` as one value whose least is the first row's."""
    rest = [c for c in rows.columns if c not in EPISODE and (keep is None or c in keep)]
    row = F.when(F.col("eid").isNotNull(), F.struct("eid", *[c for c in rest if c != "eid"]))
    return rows.withColumn("seed", F.coalesce("seed", F.lit(0))), rest, row


def dedupe_episodes(rows: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """The first row of every episode identity, with how many rows it stood for.

    ``keep`` names the columns wanted beside the identity: the others stay out of the shuffle.
    """
    named, rest, row = _identified(rows, keep)
    found = named.groupBy(*EPISODE).agg(*([F.min(row).alias("r")] if rest else []), F.count("*").alias("copies"))
    return found.select(*EPISODE, *[f"r.{c}" for c in rest], "copies")


def dedupe_stages(rows: DataFrame, stages: int, keep: Sequence[str]) -> DataFrame:
    """``dedupe_episodes`` over the rows of draws 1..s, for every ``stage`` s up to ``stages``; each row is shuffled once."""
    named, rest, row = _identified(rows, [c for c in keep if c != "draw"])
    until = range(1, stages + 1)
    counts = [F.count_if(F.col("draw") <= s).alias(f"n{s}") for s in until]
    dealt = named.select(*EPISODE, "draw", row.alias("r")).repartition(*EPISODE)
    firsts = [F.min(F.when(F.col("draw") <= s, F.col("r"))).alias(f"r{s}") for s in until]
    found = dealt.groupBy(*EPISODE).agg(*firsts, *counts)
    each = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"r{s}").alias("r"), F.col(f"n{s}").alias("copies")) for s in until])
    return found.select(*EPISODE, F.inline(each)).where("copies > 0").select("stage", *EPISODE, *[f"r.{c}" for c in rest], "copies")


def clean(ledger: DataFrame, overlap: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    return dedupe_episodes(scored(drop_overlap(ledger, overlap)), keep)


def cell_rates(rows: DataFrame, flag: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Share of episodes with ``flag`` in each (task, arm): repeated cells average first."""
    hit = F.sum(F.when(flag, 1).otherwise(0)) / F.count("*")
    return rows.groupBy(*groups, "task", "arm").agg(hit.cast(RATE).alias("rate"), F.count("*").alias("n"))


def paired(cells: DataFrame, arms: Sequence[str], value: str = "rate", groups: Sequence[str] = ()) -> DataFrame:
    """Tasks with a cell in both arms: columns a, b and diff."""
    wide = cells.groupBy(*groups, "task").agg(
        *[F.max(F.when(F.col("arm") == arm, F.col(value))).alias(n) for arm, n in zip(arms, ("a", "b"))]
    )
    both = wide.where("a IS NOT NULL AND b IS NOT NULL")
    return both.withColumn("diff", F.col("a") - F.col("b"))


def _mean(col: str) -> Column:
    return (F.sum(col).cast("double") / F.count("*")).alias(col)


def paired_summary(pairs: DataFrame, groups: Sequence[str] = (), reps: int = REPS, drawn: bool = False) -> DataFrame:
    """Mean of both arms and of the per-task difference, with intervals over tasks."""
    if not groups:
        return paired_summary(pairs.withColumn("_all", F.lit(1)), ["_all"], reps, drawn).drop("_all")
    pairs = cut_lineage(pairs)
    means = pairs.groupBy(*groups).agg(F.count("*").alias("paired"), _mean("a"), _mean("b"), _mean("diff"))
    ci = bootstrap_ci(pairs, groups, "task", ["a", "b", "diff"], reps, drawn=drawn)
    return means.join(ci, list(groups))


def token_cost(rows: DataFrame) -> DataFrame:
    """Tokens per episode and per verified repair; NULL where nothing was repaired."""
    fixed = F.count_if(F.col("verdict") == "fixed")
    tokens = F.sum(F.coalesce("tokens", F.lit(0)))
    return rows.groupBy("arm").agg(
        F.count("*").alias("episodes"), fixed.alias("fixed"),
        (tokens / F.count("*")).alias("tokens_per_episode"),
        F.try_divide(tokens, fixed).alias("tokens_per_fix"),
        F.count_if(F.col("verdict").isin("fixed", "not-fixed", "build-failed")).alias("patches_verified"),
    )


def _task_tokens(rows: DataFrame, arms: Sequence[str]) -> DataFrame:
    used = rows.where("tokens > 0")
    means = used.groupBy("task", "arm").agg((F.sum("tokens") / F.count("*")).cast("decimal(24,6)").alias("mean"))
    return paired(means, arms, "mean")


def token_ratio(rows: DataFrame, arms: Sequence[str], reps: int = REPS) -> DataFrame:
    """Ratio of the arms' summed per-task means, resampled over tasks."""
    pairs = cut_lineage(_task_tokens(rows, arms).withColumn("_all", F.lit(1)))
    ratio = F.sum("a").cast("double") / F.sum("b").cast("double")
    point = pairs.groupBy("_all").agg(F.count("*").alias("tasks"), ratio.alias("ratio"), F.count_if(F.col("a") < F.col("b")).alias("below"))
    sums = replicate_sums(pairs, ["_all"], "task", ["a", "b"], reps, scale=6)
    stat = {"ratio": F.col("a") / F.col("b")}
    # the lower end is one place below the mean interval's
    ends = percentile_interval(sums, ["_all"], stat, int(0.025 * reps) - 1, min(reps - 1, int(0.975 * reps)))
    return point.join(ends, "_all").drop("_all")


def by_kind(rows: DataFrame, arms: Sequence[str]) -> DataFrame:
    pairs = paired(cell_rates(rows, F.col("verdict") == "fixed", ["kind"]), arms, groups=["kind"])
    rates = pairs.groupBy("kind").agg(F.count("*").alias("tasks"), _mean("a"), _mean("b"))
    used = F.col("tokens") > 0
    tokens = rows.groupBy("kind").agg(*[
        F.try_divide(
            F.sum(F.when(used & (F.col("arm") == arm), F.col("tokens"))), F.count_if(used & (F.col("arm") == arm))
        ).alias(f"tok_{n}")
        for arm, n in zip(arms, ("a", "b"))
    ])
    return tokens.join(rates, "kind", "left")


def exact_median(rows: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    """Median from a histogram: what meets in one task is distinct values, not rows."""
    hist = rows.groupBy(*keys, col).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys)
    upto = hist.select(
        *keys, col, F.sum("_n").over(w.orderBy(col).rowsBetween(W.unboundedPreceding, 0)).alias("_c"),
        F.sum("_n").over(w).alias("_t"),
    )
    middle = [F.min(F.when(F.col("_c") > F.floor((F.col("_t") - d) / 2), F.col(col))) for d in (1, 0)]
    return upto.groupBy(*keys).agg(((middle[0] + middle[1]) / 2).cast("double").alias(out))


def behaviour(rows: DataFrame, tool: str, busy: int = 30, shown: int = 5) -> DataFrame:
    """How each arm spent its budget, its commonest tools and the share of one tool."""
    def share(cond: Column) -> Column:
        return F.count_if(F.coalesce(cond, F.lit(False))) / F.count("*")

    rows = cut_lineage(rows.select("arm", "verdict", "queries", "tool_calls"))
    queries = rows.withColumn("queries", F.coalesce("queries", F.lit(0)))
    per_arm = queries.groupBy("arm").agg(
        F.count("*").alias("n"), share(F.col("verdict") != "no-proposal").alias("proposed"),
        share(F.col("queries") >= busy).alias("capped"),
        share(F.array_contains("tool_calls", tool)).alias("tool_episodes"),
    )
    calls = rows.select("arm", F.explode("tool_calls").alias("tool")).groupBy("arm", "tool").agg(F.count("*").alias("calls"))
    totals = calls.groupBy("arm").agg(
        (F.sum(F.when(F.col("tool") == tool, F.col("calls")).otherwise(0)) / F.sum("calls")).alias("tool_share")
    )
    top = (
        first_n(calls, ["arm"], [F.desc("calls"), F.col("tool")], shown)
        .groupBy("arm").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "tool", "calls").alias("t")))).alias("l"))
        .select("arm", F.array_join("l.t", ", ").alias("top_tools"))
    )
    return (
        per_arm.join(exact_median(queries, ["arm"], "queries", "median_queries"), "arm")
        .join(totals, "arm", "left").join(top, "arm", "left")
    )


def per_class(rows: DataFrame, screened: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Screen yield and paired repair rate by mutation class."""
    by = screened.groupBy("cls").agg(F.count("*").alias("screened"), F.count_if(F.col("verdict") == "killed").alias("killed"))
    pairs = paired(cell_rates(rows, F.col("verdict") == "fixed"), arms)
    known = pairs.join(screened.select(F.col("task"), "cls"), "task")
    rates = known.groupBy("cls").agg(F.count("*").alias("paired"), _mean("a"), _mean("b"))
    return by.join(rates, "cls", "left").withColumn("paired", F.coalesce("paired", F.lit(0)))


def corpus_counts(screened: DataFrame) -> DataFrame:
    """Verdicts and kill kinds per draw."""
    killed = F.col("verdict") == "killed"
    def n(cond: Column, out: str) -> Column:
        return F.count_if(cond).alias(out)

    known = F.col("kind").isin("divergence", "assertion")
    return screened.groupBy("draw").agg(
        F.count("*").alias("screened"), n(killed, "killed"), n(killed & known, "tasks"),
        n(killed & (F.col("kind") == "divergence"), "divergence"), n(killed & (F.col("kind") == "assertion"), "assertion"),
        n(killed & ~F.coalesce(known, F.lit(False)), "other_kill"), n(F.col("verdict") == "survived", "survived"),
        n(F.col("verdict") == "build-failed", "build_failed"), n(F.col("verdict") == "invalid", "invalid"),
        n(F.col("verdict") == "error", "error"),
    )


def funnel(rows: DataFrame) -> DataFrame:
    """Episodes, proposals, right file, repairs and their overlap, by arm and by model."""
    fixed, right = F.col("verdict") == "fixed", F.coalesce("same_file", F.lit(False))
    views = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("key")) for d in ("arm", "model")])
    return rows.select("*", F.inline(views)).groupBy("dim", "key").agg(
        F.count("*").alias("episodes"), F.count_if(F.col("verdict") != "no-proposal").alias("proposed"),
        F.count_if(right).alias("right_file"), F.count_if(fixed).alias("fixed"),
        F.count_if(right & fixed).alias("right_file_fixed"),
    )


def trajectory(ledger: DataFrame, overlap: DataFrame, arms: Sequence[str], stages: int, reps: int = REPS) -> DataFrame:
    """The paired difference over the results of stages 1..s, for every stage s."""
    rows = dedupe_stages(scored(drop_overlap(ledger, overlap)), stages, ["verdict"])
    # both are made of sums by task and arm, so that the ledger is read and shuffled once
    cells = cut_lineage(cell_rates(rows, F.col("verdict") == "fixed", ["stage"]))
    counts = cells.groupBy("stage").agg(F.sum("n").alias("episodes"))
    pairs = paired(cells, arms, groups=["stage"])
    return paired_summary(pairs, ["stage"], reps).join(counts, "stage").select(
        "stage", "episodes", "paired", "diff", "diff_lo", "diff_hi"
    )


def task_table(rows: DataFrame, labels: dict[str, str], span: int, page: int = 64) -> DataFrame:
    """Every task's verdicts per arm in ledger order, relabelled, in pages."""
    label = F.col("verdict")
    for raw, short in labels.items():
        label = F.when(F.col("verdict") == raw, short).otherwise(label)
    rows = rows.select("task", "arm", "episode", "eid", label.alias("label"))
    at = position(rows, ["task", "arm"], ["episode", "eid"], span, "pos")
    return paged(at, ["task", "arm"], "pos", F.col("label"), "verdicts", page)


def localization(named: DataFrame, bugs: DataFrame, statics: DataFrame | None = None) -> DataFrame:
    """Hit rates of named lists next to a static list and the permutation baseline.

    named (task, item) distinct; bugs (task, item) one row per task. How often a task's
    defect is in some OTHER task's list is the product of two per-item counts minus the
    hits, so no pair of tasks is ever formed.
    """
    n_named = named.groupBy("item").agg(F.count("*").alias("n_named"))
    hits = bugs.join(named, ["task", "item"], "left_semi").groupBy("item").agg(F.count("*").alias("n_hits"))
    per_item = bugs.groupBy("item").agg(F.count("*").alias("n_bugs")).join(n_named, "item", "left").join(hits, "item", "left")
    listed = F.lit(0)
    if statics is not None:
        per_item = per_item.join(statics.select("item", F.lit(1).alias("_static")), "item", "left")
        listed = F.sum(F.col("n_bugs") * F.coalesce("_static", F.lit(0)))
    n, hit = F.sum("n_bugs"), F.sum(F.coalesce("n_hits", F.lit(0)))
    other = F.sum(F.col("n_bugs") * F.coalesce("n_named", F.lit(0))) - hit
    return per_item.agg(
        n.alias("n"), hit.alias("hits"), listed.alias("static_hits"), F.try_divide(other, n * (n - 1)).alias("permuted")
    )


def list_sizes(named: DataFrame, bugs: DataFrame) -> DataFrame:
    """Length of every task's list, 0 for a task that named nothing."""
    return bugs.select("task").join(named.groupBy("task").agg(F.count("*").alias("size")), "task", "left").select(
        "task", F.coalesce("size", F.lit(0)).alias("size")
    )


def static_baseline(named: DataFrame, sizes: DataFrame) -> DataFrame:
    """The K most-named items, K the median list size."""
    k = exact_median(sizes.withColumn("_all", F.lit(1)), ["_all"], "size", "k").first()
    counts = named.groupBy("item").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "item").limit(int(k.k) if k else 0)


def integrity_audit(queued: DataFrame, final: DataFrame) -> DataFrame:
    """Per tag: queued and final cells, stranded, doubled, lost rows."""
    cell = ["tag", "task", "arm", "seed"]
    q = queued.select(*cell).distinct().withColumn("_q", F.lit(1))
    f = final.groupBy(*cell).agg(F.count("*").alias("_f"), F.count_if(is_lost()).alias("_lost"))
    return q.join(f, cell, "full").groupBy("tag").agg(
        F.count("_q").alias("queued"), F.count("_f").alias("final"),
        F.count_if(F.col("_f").isNull()).alias("stranded"), F.count_if(F.col("_f") > 1).alias("doubled"),
        F.coalesce(F.sum("_lost"), F.lit(0)).alias("lost"),
    )


def arm_coverage(tasks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Killed tasks by how many arms have a scored episode."""
    arms = scored(ledger).groupBy("task").agg(F.count_distinct("arm").alias("arms"))
    return tasks.join(arms, "task", "left").groupBy(F.coalesce("arms", F.lit(0)).alias("arms")).agg(F.count("*").alias("tasks"))


def episode_cost(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Dollars per episode; an unpriced model stays NULL, cached input falls back to input price.

    prices (model, input, output, cache) per million tokens; a ledger model may carry a
    path, its last segment is the name.
    """
    name = F.substring_index("model", "/", -1)
    p = prices.select(F.col("model").alias("_m"), "input", "output", "cache")
    fresh = F.greatest(F.lit(0), F.col("prompt") - F.col("cached"))
    usd = (
        fresh * F.col("input") + F.col("cached") * F.coalesce("cache", "input")
        + (F.col("out_tokens") + F.col("thought")) * F.col("output")
    ) / F.lit(1_000_000)
    return rows.withColumn("_m", name).join(p, "_m", "left").withColumn("usd", usd).drop("_m", "input", "output", "cache")


def cost_rollup(costed: DataFrame) -> DataFrame:
    """Episodes, tokens and dollars per model and in total (model NULL)."""
    return costed.rollup("model").agg(
        F.count("*").alias("episodes"), F.sum("tokens").alias("tokens"), F.sum("usd").alias("usd")
    )


def machine_cost(sessions: DataFrame, rate: Column) -> DataFrame:
    return sessions.groupBy("machine").agg(F.sum("hours").alias("hours"), F.sum(F.col("hours") * rate).alias("usd"))
