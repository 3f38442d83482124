"""Reading, searching and patching text for all files and all anchors at once.

``lines`` is (run_id, file, line_no, text), line numbers dense from ``base`` (0 for logs,
1 for sources).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindsight.operators.ordered import first_n
from hindsight.session import by_rows, cut_counted

#: Lines of a slice unless another number is asked for.
MAX_SLICE = 200
FILE = ["run_id", "file"]


def split_lines(texts: DataFrame, base: int = 0) -> DataFrame:
    """(run_id, file, text) to one row per line."""
    return texts.select(*FILE, F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumn(
        "line_no", F.col("line_no") + base
    )


def sizes(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*FILE).agg(F.count("*").alias("lines"))


def read_slice(lines: DataFrame, start: int, count: int = MAX_SLICE, base: int = 0) -> DataFrame:
    """``count`` lines of every file from ``start`` on, and whether more remain."""
    start = max(start, base)
    part = lines.where((F.col("line_no") >= start) & (F.col("line_no") < start + count))
    more = (F.lit(start - base + count) < F.col("lines")).alias("truncated")
    return part.join(sizes(lines), FILE).select(*FILE, "line_no", "text", more)


def tail(lines: DataFrame, count: int = MAX_SLICE, base: int = 0) -> DataFrame:
    """The last ``count`` lines of every file with their own numbers.

    Numbers are dense, so the last one tells the length; lines before the last ``count``
    are left out before anything is shuffled.
    """
    last = first_n(lines, FILE, [F.desc("line_no")], count)
    length = F.max("line_no").over(W.partitionBy(*FILE)) - base + 1
    return last.select(*FILE, "line_no", "text", (length > count).alias("truncated"))


def grep(
    lines: DataFrame, pattern: str, context: int = 0, limit: int = 100, keys: Sequence[str] = tuple(FILE), base: int = 0
) -> DataFrame:
    """Matches of every key with their context, at most ``limit`` rows, overlaps repeated.

    No more than the first ``limit`` matches of a key can show, so only those ask for
    context, by line number. ``truncated`` compares all rows there would be with the limit.
    """
    keys = list(keys)
    order = [c for c in ("file", "match") if c not in keys]
    hits = lines.where(F.col("text").rlike(pattern)).select(*FILE, F.col("line_no").alias("match"))
    sized = hits.join(sizes(lines), FILE)
    lo = F.greatest(F.lit(base), F.col("match") - context)
    hi = F.least(F.col("lines") - 1 + base, F.col("match") + context)
    spans, matches = cut_counted(sized.select(*FILE, "match", lo.alias("lo"), hi.alias("hi")))
    totals = spans.groupBy(*keys).agg((F.sum(F.col("hi") - F.col("lo") + 1) > limit).alias("truncated"))
    leading = first_n(spans, keys, [F.col(c) for c in order], limit).drop("rank")
    asked = leading.select(*FILE, "match", F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("line_no"))
    shown = by_rows(asked, matches * (2 * context + 1)).join(lines, [*FILE, "line_no"])
    kept = first_n(shown, keys, [F.col(c) for c in (*order, "line_no")], limit)
    return kept.join(by_rows(totals, matches), keys).select(*FILE, "match", "line_no", "text", "truncated")


def list_files(lines: DataFrame, pattern: str = "") -> DataFrame:
    return sizes(lines.where(F.col("file").rlike(pattern)) if pattern else lines)


def search_source(
    lines: DataFrame, pattern: str, file_pattern: str = "", context: int = 0, limit: int = 60, base: int = 1
) -> DataFrame:
    """:func:`grep` over all files of a run in path order, one limit per run."""
    chosen = lines.where(F.col("file").rlike(file_pattern)) if file_pattern else lines
    return grep(chosen, pattern, context, limit, ["run_id"], base)


def _gram_size(cutoff: float) -> int:
    """The longest grams of which texts of the cutoff's similarity must share some; 0 if there are none of 2 or more."""
    return max((q for q in (2, 3, 4) if q * (1 - cutoff) < 1), default=0)


def _shared(length: Column, q: int, cutoff: float) -> Column:
    """How many grams of ``q`` a text shares at least with any text at ``cutoff`` that is no longer than it."""
    return F.ceil(length * (1 - q * (1 - cutoff)) - 1e-9) - q + 1


def _rare_grams(rows: DataFrame, text: str, counts: DataFrame | None, q: int, cutoff: float) -> tuple[DataFrame, DataFrame]:
    """(FILE, id, gram) with enough of each text's rarest grams to meet all partners, and (FILE, gram, n) of ``rows``.

    Grams go by the digest of their text (``id``), so what is moved grows with the texts and not with their squares. The n-th time a text holds a gram counts as a gram of its own, so shared grams are counted with repeats.
    """
    n, at = F.col("_len"), [*FILE, "id", "_len"]
    every = rows.select(*FILE, "id", F.length(text).alias("_len"), text).where(_shared(n, q, cutoff) >= 1)
    every = every.select(*at, F.col(text).alias("_text"), F.explode(F.sequence(F.lit(1), n - q + 1)).alias("_at"))
    gram = F.substring(F.col("_text"), F.col("_at"), F.lit(q))
    held = every.select(*at, gram.alias("_g")).groupBy(*at, "_g").agg(F.count("*").alias("_n"))
    held = held.select(*at, F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "_n"), lambda i: F.concat_ws(":", i, "_g"))).alias("gram"))
    if counts is None:
        held, many = cut_counted(held)
        counts = by_rows(held.groupBy(*FILE, "gram").agg(F.count("*").alias("n")), many)
    order = W.partitionBy(*FILE, "id").orderBy(F.coalesce("n", F.lit(0)), "gram")
    ranked = held.join(counts, [*FILE, "gram"], "left").withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= n - q + 1 - _shared(n, q, cutoff) + 1).select(*FILE, "id", "gram"), counts


def nearest_lines(probes: DataFrame, lines: DataFrame, k: int = 2, cutoff: float = 0.5) -> DataFrame:
    """The ``k`` lines of a file closest to a missed anchor (run_id, file, probe).

    Lines are compared stripped; each is reported where it first occurs. Similarity is 1 - edit distance / longer length.
    Above a cutoff of a half, texts that are similar share grams: a probe meets the lines that share one of its rarest
    ones. Texts too short for that, and all texts at lower cutoffs, meet by power-of-two classes of their length. Both
    ways miss nothing, and the distance is given up where it passes what the cutoff leaves.
    """
    text = F.trim(F.col("text"))
    distinct = (
        lines.select(*FILE, text.alias("line"), "line_no").where("line <> ''")
        .groupBy(*FILE, "line").agg(F.min("line_no").alias("line_no"), F.count("*").alias("copies"))
    )
    asked = probes.select(*FILE, "probe").where("probe <> ''").distinct()
    # lines longer or shorter than any probe of their file can be similar to
    reached = asked.groupBy(*FILE).agg((F.min(F.length("probe")) * cutoff - 1).alias("_least"), (F.max(F.length("probe")) / cutoff + 1).alias("_most"))
    distinct = distinct.join(reached, FILE).where(F.length("line").between(F.col("_least"), F.col("_most"))).drop("_least", "_most")
    q = _gram_size(cutoff)
    short = lambda c: _shared(F.length(c), q, cutoff) < 1 if q else F.lit(True)
    reach = math.ceil(math.log2(1 / cutoff))
    size_class = lambda c: F.floor(F.log2(F.length(c))).cast("int")
    classes = F.explode(F.sequence(size_class("probe") - reach, size_class("probe") + reach)).alias("_class")
    met = asked.select("*", classes).join(distinct.withColumn("_class", size_class("line")), [*FILE, "_class"]).drop("_class")
    met = met.where(short("line") | short("probe"))
    if q:
        lined, probed = (df.withColumn("id", F.unhex(F.md5(c))) for df, c in ((distinct, "line"), (asked, "probe")))
        of_lines, counts = _rare_grams(lined, "line", None, q, cutoff)
        of_probes, _ = _rare_grams(probed, "probe", counts, q, cutoff)
        pairs = of_probes.withColumnRenamed("id", "its").join(of_lines, [*FILE, "gram"]).select(*FILE, "its", "id").distinct()
        pairs = pairs.join(lined, [*FILE, "id"]).drop("id").join(probed.withColumnRenamed("id", "its"), [*FILE, "its"])
        met = met.unionByName(pairs.drop("its"))
    longer, shorter = F.greatest(F.length("line"), F.length("probe")), F.least(F.length("line"), F.length("probe"))
    room = F.floor(longer * (1 - cutoff) + 1e-9).cast("int")
    near = met.where(shorter >= longer - room).withColumn("_edits", F.call_function("levenshtein", "line", "probe", room))
    good = near.where("_edits >= 0").withColumn("similarity", 1 - F.col("_edits") / longer).where(F.col("similarity") >= cutoff)
    best = first_n(good, [*FILE, "probe"], [F.desc("similarity"), F.desc("line")], k)
    # a line that occurs twice fills two places
    before = F.sum("copies").over(
        W.partitionBy(*FILE, "probe").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    )
    room = F.least(F.col("copies"), k - F.coalesce(before, F.lit(0)))
    return best.withColumn("places", room).where("places > 0").select(
        *FILE, "probe", "line", "line_no", "similarity", "places"
    )


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` occurs, not overlapping; 0 for an empty part."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, F.floor(gone / F.length(part))).otherwise(0)


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a 1-based character offset."""
    before = F.substring(text, F.lit(1), offset - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def validate_proposals(proposals: DataFrame, texts: DataFrame) -> DataFrame:
    """Is each edit (run_id, file, old, new) applicable: its anchor must occur exactly once."""
    found = occurrences(F.col("text"), F.col("old"))
    status = (
        F.when(F.col("text").isNull(), "no such file").when(F.col("n") == 0, "no match")
        .when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" matches")))
        .when(F.col("old") == F.col("new"), "no-op").otherwise("registered")
    )
    at = line_at(F.col("text"), F.position(F.col("old"), F.col("text")))
    return (
        proposals.join(texts.select(*FILE, "text"), FILE, "left").withColumn("n", found).withColumn("status", status)
        .select(*proposals.columns, "status", F.when(F.col("status") == "registered", at).cast("int").alias("line_no"))
    )


# Edits that would weaken the checks instead of mending the design.
TAMPERING = (
    (r"\bassert\s*\(", "removes or weakens a Chisel assertion"),
    (r"\brequire\s*\(", "removes an elaboration-time contract"),
    (r"\bprintf\s*\(", "edits the commit-log printf the harness reads"),
)


def tamper_reason(old: Column, new: Column, rules: Sequence[tuple[str, str]] = TAMPERING) -> Column:
    """Reason of the first rule with fewer matches after than before, else NULL."""
    return F.coalesce(*[
        F.when(F.regexp_count(new, F.lit(p)) < F.regexp_count(old, F.lit(p)), why) for p, why in rules
    ])


def attribute_patches(patches: DataFrame) -> DataFrame:
    """Where a patch landed relative to the planted fault.

    patches: mutated, path, old, new and the site's site_path, site_line, site_start
    (0-based), before, after. Only an anchor that occurs once is applied.
    """
    text = F.col("mutated")
    once = occurrences(text, F.col("old")) == 1
    patched = F.replace(text, F.col("old"), F.col("new"))
    original = F.concat(
        F.substring(text, F.lit(1), F.col("site_start")), F.col("before"),
        F.substring(text, F.col("site_start") + F.length("after") + 1, F.length(text)),
    )
    line = line_at(text, F.position(F.col("old"), text)).cast("int")
    same_file = F.col("path") == F.col("site_path")
    return (
        patches.withColumn("applied", once).withColumn("patched_line", F.when(F.col("applied"), line))
        .withColumn("same_file", F.col("applied") & same_file)
        .withColumn("same_line", F.col("same_file") & (F.abs(F.col("patched_line") - F.col("site_line")) <= 2))
        .withColumn("exact_revert", F.col("same_file") & (patched == original))
    )


def last_proposals(episodes: DataFrame, attempts: DataFrame) -> DataFrame:
    """The edit that stands per episode, or why there is none.

    episodes (episode, error); attempts (episode, seq, accepted, proposal). A later
    proposal replaces an earlier one.
    """
    per = attempts.groupBy("episode").agg(
        F.max_by("proposal", F.when(F.col("accepted"), F.col("seq"))).alias("proposal"),
        F.count_if(F.col("accepted")).alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"),
    )
    n = F.coalesce("rejected", F.lit(0))
    verdict = F.when(F.coalesce("accepted", F.lit(0)) > 0, "proposed").when(F.col("error").isNotNull(), "lost").otherwise("no-proposal")
    reason = F.when(F.col("verdict") == "no-proposal", F.when(n > 0, "every anchor was rejected").otherwise("nothing was proposed"))
    return episodes.join(per, "episode", "left").withColumn("verdict", verdict).select(
        "episode", "verdict", "proposal", n.alias("rejected"), reason.alias("reason")
    )
