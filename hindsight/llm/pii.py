"""Personal data by weak supervision, in DataFrame expressions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; what they accept always stays. Looser
patterns propose further spans (numbers that stand next to each other, say, where the base pattern runs over the end),
which must pass the same check sums and ranges. Five labelers vote on every span: the base pattern, the kind's usual
shape, a gazetteer (issuers, dialling codes, top-level domains), the words before it, and whether it stands free. Votes are counted by
pattern, a table whose size depends on labelers alone; expectation-maximisation over it estimates how reliable each
labeler is, and a logistic regression on the votes, weighted by the resulting posteriors, decides on the looser spans.

Spans are computed within the row, with running offsets summed in blocks; nothing is exploded but the votes.

Defined results: offsets are code points, ends exclusive; a null text is an empty one; of a kind, looser spans that
overlap base ones are left out; of the others that overlap, all that are accepted stay; rows that repeat give repeated
results; without any span there is no model and none is added; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindsight.llm.text import whole
from hindsight.session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]

# The base patterns, fixed by what they must find. Possessive and anchored at the start of a run: a run is scanned once,
# with the matches of the plain patterns.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    # a bare "at" is a common word: next to it a dot with a space behind it alone ends a sentence
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|(?<= )dot(?= )|\.) ?[A-Za-z0-9-]{2,63}+){1,4}"
    r"| at [A-Za-z0-9-]{1,63}+(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot | \. |\.)[A-Za-z0-9-]{2,63}+){1,4})",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{2,7}(?![0-9A-Za-z])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])",
}
# without one of these in the text, no match can be
NEEDS = {
    "email": "contains(text, '@')",
    "ip": r"text rlike '[0-9]\\.[0-9]'",
    "card": "text rlike '[0-9][ -]?[0-9]'",
    "phone": "contains(text, '+')",
}
NEEDS_LOOSE = NEEDS | {"email": "contains(text, '(at)') or contains(text, '[at]') or contains(text, ' at ')", "card": "text rlike '[0-9]{4}'"}

# gazetteers
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
CODES = r"^\\+(?:1|2[07]|3[0-4]|36|39|4[0134-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
DOMAINS = r"(?i)(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|us|ca|it|nl|ch|at|be)$"
# words before a span that speak for personal data, or against
FOR = r"(?i)\\b(?:e-?mails?|mail|contact|reach|phone|tel|telephone|call|mobile|fax|card|visa|mastercard|ip|address|adresse|correo|courriel|telefon|t[eé]l[eé]fono|t[eé]l[eé]phone)\\b[^a-z]*$"
AGAINST = r"(?i)\\b(?:versions?|v|release|section|chapter|isbn|issn|order|invoice|token|password|key|serial|build|license)\\b[^a-z]*$"

BLOCK = 512
LABELERS = ["base", "shape", "gazetteer", "context", "free"]
ROUNDS = 15
SPAN = "struct<start: int, stop: int, hit: string>"


def _positions(hits: str, pieces: str) -> str:
    """Spans of the ``hits`` that stand between the ``pieces`` of a text; offsets run in blocks of ``BLOCK`` hits."""
    # both arrays are arguments and so made once; inside a lambda they would be made again for each hit
    steps = f"slice(zip_with({pieces}, {hits}, (p, x) -> struct(length(p) as gap, length(x) as len, x as hit)), 1, size({hits}))"
    blocks = f"transform(array({steps}), s -> transform(sequence(0, (size(s) - 1) div {BLOCK}), c -> slice(s, c * {BLOCK} + 1, {BLOCK})))[0]"
    sums = "transform(b, c -> aggregate(c, 0, (a, x) -> a + x.gap + x.len))"
    offsets = f"aggregate({sums}, array(0), (a, x) -> array_append(a, element_at(a, -1) + x))"
    run = (
        f"aggregate(c, struct(o[i] as pos, cast(array() as array<{SPAN}>) as got), (a, x) -> struct(a.pos + x.gap + x.len as pos, "
        "array_append(a.got, struct(a.pos + x.gap as start, a.pos + x.gap + x.len as stop, x.hit as hit)) as got), a -> a.got)"
    )
    # transform over a single element names an intermediate value
    within = f"transform(array({offsets}), o -> flatten(transform(b, (c, i) -> {run})))[0]"
    return f"if(size({hits}) = 0, cast(array() as array<{SPAN}>), transform(array({blocks}), b -> {within})[0])"


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _spans(rows: DataFrame, patterns: dict[str, str], needs: dict[str, str], name: str) -> DataFrame:
    """``rows`` (with ``text``) with a column ``name_kind`` of spans for each kind."""
    none = "cast(array() as array<string>)"
    others = list(rows.columns)
    found = rows.selectExpr(*others, *[f"if({needs[k]}, regexp_extract_all(text, {_literal(p)}, 0), {none}) as {name}_hits_{k}" for k, p in patterns.items()])
    split = found.selectExpr("*", *[f"if(size({name}_hits_{k}) > 0, split(text, {_literal(p)}, -1), {none}) as {name}_parts_{k}" for k, p in patterns.items()])
    return split.selectExpr(*others, *[f"{_positions(f'{name}_hits_{k}', f'{name}_parts_{k}')} as {name}_{k}" for k in patterns])


DIGITS = "regexp_replace(x.hit, '[^0-9]', '')"
# with every second digit from the right doubled
LUHN = (
    f"aggregate(transform(split(reverse({DIGITS}), ''), (d, i) -> if(d = '', 0, if(i % 2 = 0, cast(d as int), cast(d as int) * 2 - if(cast(d as int) > 4, 9, 0)))), "
    "0, (a, d) -> a + d) % 10 = 0"
)
STRUCTURE = {
    "email": "true",
    "ip": "forall(split(x.hit, '[.]'), o -> length(ltrim('0', o)) < 3 or length(ltrim('0', o)) = 3 and ltrim('0', o) <= '255')",
    "card": f"if(length({DIGITS}) between 14 and 19, {LUHN}, false)",
    "phone": f"length({DIGITS}) between 10 and 15",
}
SHAPE = {
    "email": "x.hit rlike '[^A-Za-z][A-Za-z]{2,}$'",
    "ip": "not x.hit rlike '(?:^|[.])0[0-9]'",
    "card": f"length({DIGITS}) in (15, 16)",
    "phone": f"length({DIGITS}) <= 13",
}
GAZETTEER = {
    "email": f"if(x.hit rlike '{DOMAINS}', '1', '2')",
    "ip": "if(x.hit rlike '^(?:0+|22[4-9]|2[34][0-9]|25[0-5])[.]', '0', '1')",
    "card": f"if(x.hit rlike '{ISSUERS}', '1', '0')",
    "phone": f"if(x.hit rlike '{CODES}', '1', '0')",
}


def find_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` as ``row``, text, base (spans by kind) and more (looser spans, with votes), for every row.

    base: array of (start, kind index, stop, votes), more: the same; votes are one digit for each labeler, 2 for none.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), whole(text_col).alias("text"))
    seen = _spans(_spans(rows, BASE, NEEDS, "base"), LOOSE, NEEDS_LOOSE, "loose")
    kept = seen.selectExpr(
        "row", "text", *[f"filter(base_{k}, x -> {STRUCTURE[k]}) as base_{k}" for k in KINDS], *[f"loose_{k}" for k in KINDS]
    )

    def voted(k: str, source: str, base: int) -> str:
        before = "substring(text, greatest(x.start - 39, 1), least(40, x.start))"
        context = f"if({before} rlike '{FOR}', '1', if({before} rlike '{AGAINST}', '0', '2'))"
        free = r"if(not substring(text, x.start, if(x.start > 0, 1, 0)) rlike '[A-Za-z0-9]' and not substring(text, x.stop + 1, 1) rlike '[A-Za-z0-9]', '1', '0')"
        votes = f"concat('{1 if base else 2}', if({SHAPE[k]}, '1', '0'), {GAZETTEER[k]}, {context}, {free})"
        return f"transform({source}, x -> struct(x.start as start, {KINDS.index(k)} as kind, x.stop as stop, {votes} as votes))"

    apart = {k: f"filter(loose_{k}, x -> {STRUCTURE[k]} and not exists(base_{k}, b -> b.start < x.stop and x.start < b.stop))" for k in KINDS}
    return kept.selectExpr(
        "row", "text",
        f"array_sort(concat({', '.join(voted(k, f'base_{k}', 1) for k in KINDS)})) as base",
        f"array_sort(concat({', '.join(voted(k, apart[k], 0) for k in KINDS)})) as more",
    )


def vote_patterns(found: DataFrame) -> DataFrame:
    """kind, votes, n over all spans: as many rows as there are ways to vote, at most."""
    return found.select(F.explode(F.concat("base", "more")).alias("s")).groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n"))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``patterns`` with ``posterior``: how likely spans that are voted on so are personal data.

    Each round turns posteriors into how often a labeler that votes votes so for either class, and those into posteriors;
    a labeler that does not vote says nothing.
    """
    one = Window.partitionBy("kind")
    vote = {x: F.substring("votes", i + 1, 1) for i, x in enumerate(LABELERS)}
    yes = sum((F.when(v == "1", 1).otherwise(0) for v in vote.values()), F.lit(0))
    no = sum((F.when(v == "0", 1).otherwise(0) for v in vote.values()), F.lit(0))
    out = patterns.select("*", *[v.alias(x) for x, v in vote.items()]).withColumn("posterior", (yes + 1) / (yes + no + 2))
    for _ in range(rounds):
        good, bad = F.col("n") * F.col("posterior"), F.col("n") * (1 - F.col("posterior"))
        odds = F.log((F.sum(good).over(one) + 1) / (F.sum(bad).over(one) + 1))
        for x in LABELERS:
            same, voted = Window.partitionBy("kind", x), F.col(x) != "2"
            told = [(F.sum(side).over(same) + 0.5) / (F.sum(F.when(voted, side)).over(one) + 1) for side in (good, bad)]
            odds = odds + F.when(voted, F.log(told[0]) - F.log(told[1])).otherwise(0.0)
        out = cut_lineage(out.withColumn("posterior", 1 / (1 + F.exp(-odds))))
    return out


def accepted(patterns: DataFrame) -> list[str]:
    """Ways to vote ("kind votes") that the span classifier takes for personal data."""
    if patterns.isEmpty():
        return []
    told = estimate(patterns)
    flags = [F.when(F.col(x) == v, 1.0).otherwise(0.0).alias(f"{x}_{v}") for x in LABELERS for v in "01"]
    flags += [F.when(F.col("kind") == i, 1.0).otherwise(0.0).alias(f"kind_{i}") for i in range(len(KINDS))]
    names = [f"{x}_{v}" for x in LABELERS for v in "01"] + [f"kind_{i}" for i in range(len(KINDS))]
    rows = told.select("kind", "votes", "n", "posterior", *flags)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    both = vectors.select("features", F.lit(1.0).alias("label"), (F.col("n") * F.col("posterior") + 1e-6).alias("weight")).unionByName(
        vectors.select("features", F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("posterior")) + 1e-6).alias("weight"))
    )
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(cut_lineage(both.coalesce(1)))
    taken = model.transform(vectors).where("prediction = 1").select(F.concat_ws(" ", "kind", "votes").alias("way"))
    return sorted(r["way"] for r in taken.collect())


def with_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row, base, spans (base and accepted ones) for every row of ``docs``: arrays of (start, kind, stop), sorted."""
    found = cut_lineage(find_spans(docs, text_col, keep).drop("text"))
    ways = accepted(cut_lineage(vote_patterns(found)))
    taken = F.array(*[F.lit(w) for w in ways]) if ways else F.array().cast("array<string>")
    more = F.filter("more", lambda s: F.array_contains(taken, F.concat_ws(" ", s["kind"].cast("string"), s["votes"])))

    def plain(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))

    return found.select("row", plain(F.col("base")).alias("base"), F.array_sort(plain(F.concat("base", more))).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat({kinds}[s.kind], ':', s.start, ':', s.stop)), ',')")


def counted(spans: str, kind: str) -> Column:
    return F.expr(f"cast(size(filter({spans}, s -> s.kind = {KINDS.index(kind)})) as bigint)")


def redacted(text: str, spans: str) -> Column:
    """The text with each span, or stretch of overlapping spans, replaced by the name of its first kind in brackets."""
    kinds = "array(" + ", ".join(f"'[{k}]'" for k in KINDS) + ")"
    kind = "array<struct<start: int, kind: int, stop: int>>"
    merged = (
        f"aggregate({spans}, cast(array() as {kind}), (a, s) -> if(size(a) > 0 and s.start < element_at(a, -1).stop, "
        "concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, element_at(a, -1).kind as kind, greatest(element_at(a, -1).stop, s.stop) as stop))), "
        "array_append(a, s)))"
    )
    begin = "if(i = 0, 0, m[i - 1].stop)"
    parts = f"transform(m, (s, i) -> concat(substring({text}, {begin} + 1, s.start - {begin}), {kinds}[s.kind]))"
    joined = f"concat(array_join({parts}, ''), substring({text}, element_at(m, -1).stop + 1))"
    return F.expr(f"if(size({spans}) = 0, {text}, transform(array({merged}), m -> {joined})[0])")
