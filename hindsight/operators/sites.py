"""Mutation sites: where a text rule applies, which sites to leave out, which to draw."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindsight.operators.ordered import first_n, ranked

# Characters an operator token is made of.
OP_CHARS = "!#%&*+-/:<=>?@\\^|~"

# Token -> (replacement, operator, class).
TOKEN_SWAPS = {
    "===": ("=/=", "eq_to_ne", "comparison-inversion"),
    "=/=": ("===", "ne_to_eq", "comparison-inversion"),
    "<": ("<=", "lt_to_le", "boundary-off-by-one"),
    "<=": ("<", "le_to_lt", "boundary-off-by-one"),
    ">": (">=", "gt_to_ge", "boundary-off-by-one"),
    ">=": (">", "ge_to_gt", "boundary-off-by-one"),
    "&&": ("||", "and_to_or", "condition-logic"),
    "||": ("&&", "or_to_and", "condition-logic"),
}

# Pattern -> (replacement, operator, class).
CONSTANT_RULES = (
    (r"\.fire(?![A-Za-z0-9_$])(?:\(\))?", ".valid", "fire_to_valid", "handshake-protocol"),
    (r"\+\s*1\.U", "- 1.U", "inc_to_dec", "index-arithmetic"),
    (r"-\s*1\.U", "+ 1.U", "dec_to_inc", "index-arithmetic"),
    (r"\btrue\.B\b", "false.B", "true_to_false", "constant-flip"),
    (r"\bfalse\.B\b", "true.B", "false_to_true", "constant-flip"),
)

#: White space that is cut off a context.
BLANK = " \t\r\x0b\x0c"


def matches(texts: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(path, rule, before, start, end, line, col) of every match of every pattern; a path names one text.

    Texts are cut at the matches, so places are running sums over the pieces between them and take time in proportion to
    the text and its matches. Places count characters, lines and columns from 1.
    """
    text = F.col("text")

    def cut(pattern: str) -> Column:
        return F.zip_with(
            F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda piece, hit: F.struct(piece.alias("piece"), hit.alias("before")),
        )

    each = F.array(*[F.struct(F.lit(i).alias("rule"), cut(p).alias("cut")) for i, p in enumerate(patterns)])
    rows = texts.select("path", F.inline(each)).select("path", "rule", F.posexplode("cut").alias("i", "c")).select("path", "rule", "i", "c.*")
    order = W.partitionBy("path", "rule").orderBy("i")
    upto, prior = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)

    def sums(of) -> Column:
        return F.sum(of("piece")).over(upto) + F.coalesce(F.sum(of("before")).over(prior), F.lit(0))

    placed = rows.select(
        "*", sums(F.length).alias("start"), (sums(lambda c: F.length(F.regexp_replace(c, "[^\n]", ""))) + 1).alias("line")
    )
    # the newest line feed is in the piece before the match or in an earlier match
    behind = lambda c, end: F.when(F.contains(c, F.lit("\n")), end - F.length(F.substring_index(c, "\n", -1)))
    begin = F.greatest(
        F.max(behind(F.col("piece"), F.col("start"))).over(upto),
        F.max(behind(F.col("before"), F.col("start") + F.length("before"))).over(prior), F.lit(0),
    )
    found = placed.withColumn("col", F.col("start") - begin + 1).where(F.col("before").isNotNull())
    whole = lambda c: c.cast("int")
    return found.select(
        "path", "rule", "before", whole(F.col("start")).alias("start"), whole(F.col("start") + F.length("before")).alias("end"),
        whole(F.col("line")).alias("line"), whole(F.col("col")).alias("col"),
    )


def _sites(found: DataFrame, texts: DataFrame, rule: Column) -> DataFrame:
    """``found`` with its ``rule`` (after, operator, cls) and the line it begins in; without a rule it is no site."""
    lines = texts.select("path", F.posexplode(F.split("text", "\n", -1)).alias("_at", "_line"))
    lines = lines.select("path", (F.col("_at") + 1).alias("line"), F.btrim("_line", F.lit(BLANK)).alias("context"))
    ruled = found.withColumn("_rule", rule).where(F.col("_rule").isNotNull())
    # texts may be made of far less than they hold, so that Spark's estimate would have all lines broadcast
    return ruled.join(lines.hint("merge"), ["path", "line"]).select(
        "path", "start", "end", "before", "_rule.after", "_rule.operator", "_rule.cls", "line", "col", "context"
    )


def _ruled(after: str, operator: str, cls: str) -> Column:
    return F.struct(F.lit(after).alias("after"), F.lit(operator).alias("operator"), F.lit(cls).alias("cls"))


def token_sites(texts: DataFrame, swaps: dict[str, tuple[str, str, str]] = TOKEN_SWAPS) -> DataFrame:
    """Complete operator tokens that have a swap; a token inside a longer one never counts."""
    token = "[" + re.escape(OP_CHARS) + "]+"
    known = F.create_map(*[x for t, swap in swaps.items() for x in (F.lit(t), _ruled(*swap))])
    return _sites(matches(texts, [token]), texts, known[F.col("before")])


def constant_sites(texts: DataFrame, rules: Sequence[tuple[str, str, str, str]] = CONSTANT_RULES) -> DataFrame:
    """Every match of a pattern rule."""
    known = F.array(*[_ruled(*rest) for _, *rest in rules])
    return _sites(matches(texts, [p for p, *_ in rules]), texts, F.get(known, F.col("rule")))


def exclusion_reason(
    path: Column, context: Column, path_rules: Sequence[tuple[str, str]], line_rules: Sequence[tuple[str, str]]
) -> Column:
    """Reason of the first rule that fits, path fragments before line patterns; NULL keeps the site."""
    tests = [F.when(path.contains(frag), why) for frag, why in path_rules]
    tests += [F.when(context.rlike(p), why) for p, why in line_rules]
    return F.coalesce(*tests)


# Telemetry that a functional check cannot observe, first fit wins. Reasons are ours.
PERF_PATHS = (("ifu/bpd/", "predictor"), ("common/BoomPerfCounterDevice", "counter device"))
PERF_LINES = (
    (r"\btma_\w*", "slot analysis"),
    (r"\bperf_?count\w*", "event counts"),
    (r"\bsaturating_loads_counter\b", "drain limiter"),
    (r"\bdebug_tsc_reg\b", "cycle stamp"),
    (r"\bbr_?mispredict\w*_ctr\b", "wrong-path counts"),
    (r"\bfrontend_slots_this_cycle\b", "slot counts"),
    (r"\b\w*_perf_\w*", "event wiring"),
    (r"\bcsr\.io\.(?:counters|inst)\b", "counter ports"),
)


def split_excluded(sites: DataFrame, path_rules=PERF_PATHS, line_rules=PERF_LINES) -> DataFrame:
    """All sites with the reason they are left out, NULL for those kept."""
    return sites.withColumn("reason", exclusion_reason(F.col("path"), F.col("context"), path_rules, line_rules))


def mutant_id() -> Column:
    return F.substring(F.sha2(F.concat_ws(":", "path", "line", "col", "operator"), 256), 1, 12)


def rederive(recorded: DataFrame, sites: DataFrame) -> DataFrame:
    """Recorded tasks (task, path, line, operator, before) with their site's id, NULL if gone."""
    keyed = sites.withColumn("mutant_id", mutant_id()).select("path", "line", "operator", "before", "start", "mutant_id")
    first = keyed.groupBy("path", "line", "operator", "before").agg(F.min_by("mutant_id", "start").alias("mutant_id"))
    return recorded.join(first, ["path", "line", "operator", "before"], "left")


def require_rederived(found: DataFrame) -> DataFrame:
    lost = found.where("mutant_id IS NULL").select("task").limit(1).collect()
    if lost:
        raise ValueError(f"no site for task {lost[0].task}")
    return found


# ---- drawing -----------------------------------------------------------------

def class_balanced(pool: DataFrame, per_class: int, seed: int, key: str = "key", cls: str = "cls") -> DataFrame:
    """Up to ``per_class`` rows of every class in an order only seed and key decide.

    A short class gives all it has and no other class fills in for it.
    """
    draw = F.sha2(F.concat_ws(":", F.lit(seed), key), 256)
    return first_n(pool, [cls], [draw, F.col(key)], per_class).drop("rank")


def disjoint(pool: DataFrame, screened: DataFrame, key: str = "key") -> DataFrame:
    """The pool without what an earlier draw screened; apply before drawing."""
    return pool.join(screened.select(key), key, "left_anti")


def shard_of(sample: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Round-robin shard of every row of an ordered sample, whatever the types it is ordered by."""
    return ranked(sample, order, "_at").withColumn("shard", ((F.col("_at") - 1) % n).cast("int")).drop("_at")


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What has no row yet in an output: resume after a stop."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def verify_queue(proposals: DataFrame, verified: DataFrame, tasks: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Proposals without a verdict whose task is known; the others wait."""
    return pending(proposals, verified, cell).join(tasks.select("task"), "task", "left_semi")


def open_cells(tasks: DataFrame, arms: Sequence[str], seeds: Sequence[int], done: DataFrame) -> DataFrame:
    """Cells of task x arm x seed that have no episode."""
    grid = tasks.select(
        "task", F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm")
    ).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return pending(grid, done, ["task", "arm", "seed"])
