"""Allow or block addresses: listed rules first, mined association rules for the rest.

Listed rules are (verdict, host, path); the longest that fits decides. Addresses they decide serve as labels:
FP-growth mines which token combinations go with which verdict, rules are pruned by support and confidence and by
more general rules that are as sure. An inverted index holds each rule under its rarest token; an address is looked
up by its tokens, candidates are verified, and the surest rule decides. Where none fits, the address is allowed.

Defined results: a null address, or one without ``://``, has an empty host and path and no tokens; repeated rows
give repeated results; ties go to the longer rule, then the one with more support, then ``block``; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindsight.llm.text import ascii_lower
from hindsight.session import cut_lineage

MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
ALLOW, BLOCK = "allow", "block"
LABEL = "verdict="
RULE_SCHEMA = "rule_id string, tokens array<string>, verdict string, confidence double, support double, key string"


def split_url(url: str) -> tuple[Column, Column]:
    """(host, path) of an address."""
    rest = F.regexp_extract(F.col(url).cast("string"), r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Host labels, their words, and path segments, each once."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    words = F.transform(F.split(host, r"[.-]"), lambda x: F.concat(F.lit("word:"), x))
    steps = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("path:"), x))
    empty = F.array(F.lit("host:"), F.lit("word:"), F.lit("path:"))
    return F.array_except(F.array_distinct(F.concat(labels, words, steps)), empty)


def listed_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(at + prefix)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _holding(sets: DataFrame, rules: DataFrame, keep: str = "left") -> DataFrame:
    """``sets`` (with ``items``) joined to the ``rules`` whose tokens they hold, by each rule's key."""
    looked = sets.withColumn("item", F.explode_outer("items"))
    held = F.size(F.array_except("tokens", "items")) == 0
    return looked.join(rules, (F.col("item") == F.col("key")) & held, keep)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from ``labelled`` (items, verdict): rule_id, tokens, verdict, confidence, support, key.

    The number of rules is bounded by the support, not by the input.
    """
    spark = labelled.sparkSession
    baskets = labelled.select(F.array_append("items", F.concat(F.lit(LABEL), "verdict")).alias("items"))
    if baskets.isEmpty():
        return spark.createDataFrame([], T._parse_datatype_string(RULE_SCHEMA))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    sided = model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL)))
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("item"), "freq")
    rules = sided.select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), len(LABEL) + 1, 99).alias("verdict"), "confidence", "support"
    ).withColumn("rule_id", F.concat_ws(" ", F.col("verdict"), F.array_join("tokens", " ")))
    rarest = (
        rules.select("rule_id", F.explode("tokens").alias("item")).join(single, "item")
        .groupBy("rule_id").agg(F.min_by("item", F.struct("freq", "item")).alias("key"))
    )
    rules = cut_lineage(rules.join(rarest, "rule_id").select("rule_id", "tokens", "verdict", "confidence", "support", "key"))
    # a rule is spare if a part of its tokens says the same as surely
    general = rules.select(*[F.col(c).alias(c) for c in ("tokens", "key")], F.col("verdict").alias("g_verdict"), F.col("confidence").alias("g_confidence"), F.size("tokens").alias("g_size"))
    mine_ = rules.select("rule_id", F.col("tokens").alias("items"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    spare = _holding(mine_, general, "inner").where((F.col("g_verdict") == F.col("v")) & (F.col("g_confidence") >= F.col("c")) & (F.col("g_size") < F.size("items")))
    return cut_lineage(rules.join(spare.select("rule_id"), "rule_id", "left_anti"))


def match(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, url, mined, n: the surest mined verdict of each distinct row (null where no rule fits) and its repeats."""
    key = ["page_id", "url"]
    rows = addresses.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("items").alias("items"))
    best = F.max_by("verdict", F.struct("confidence", F.size("tokens"), "support", "verdict"))
    return _holding(rows, rules).groupBy(*key).agg(F.first("n").alias("n"), best.alias("mined"))


def judge(
    pages: DataFrame, listed: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, rules: DataFrame | None = None,
) -> DataFrame:
    """page_id, url, host, path, rule, verdict, by: ``by`` is list, mined or default.

    ``rules`` may bring mined rules of an earlier run; else they are mined from what the list decides.
    """
    host, path = split_url(url_col)
    seen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(listed, F.col("host"), F.col("path"))
    seen = seen.select("*", rule.alias("rule"), verdict.alias("verdict"))
    items = tokens_of(F.col("host"), F.col("path")).alias("items")
    if rules is None:
        rules = mine(seen.where("verdict is not null").select(items, "verdict"), min_support, min_confidence)
    by_list = seen.where("verdict is not null").withColumn("by", F.lit("list"))
    mined = match(seen.where("verdict is null").select("page_id", "url", items), rules)
    rest = mined.select(
        "page_id", "url", F.lit(None).cast("string").alias("rule"), F.coalesce("mined", F.lit(ALLOW)).alias("verdict"),
        F.when(F.col("mined").isNull(), "default").otherwise("mined").alias("by"), F.explode(F.expr("sequence(1, n)")).alias("_"),
    )
    host, path = split_url("url")
    rest = rest.select("page_id", "url", host.alias("host"), path.alias("path"), "rule", "verdict", "by")
    return by_list.unionByName(rest)
