"""Scoring free-text blame against the planted fault, each level by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindsight.functions.values import hex_to_u64

# How far off a cycle may be, the field shapes, and words that locate nothing.
CYCLE_TOLERANCE = 50
FIELD = r"(?im)^\s*(MODULE|SIGNAL|CYCLE)\s*:\s*(.+?)\s*$"
CYCLE_TOKEN = r"(?im)^\s*CYCLE\s*:\s*([0-9a-fA-F]+)"
IDENTIFIER = r"[A-Za-z_$][\w$]*"
STOP_WORDS = (
    "val", "var", "def", "when", "elsewhen", "otherwise", "Mux", "RegNext", "RegInit", "Reg", "Wire", "io", "the", "is",
    "in", "of", "U", "B", "W",
)


def _field(answer: Column, name: str) -> Column:
    """Value of the first line with this field."""
    names = F.transform(F.regexp_extract_all(answer, F.lit(FIELD), 1), lambda n: F.upper(n))
    values = F.regexp_extract_all(answer, F.lit(FIELD), 2)
    at = F.array_position(names, name)
    return F.when(at > 0, F.try_element_at(values, at.cast("int")))


def parse_blame(rows: DataFrame) -> DataFrame:
    """Adds module, signal and cycle; UNKNOWN, N/A and NONE are NULL."""
    answer = F.coalesce("answer", F.lit(""))

    def named(field: str) -> Column:
        v = F.trim(_field(answer, field))
        return F.when(~F.upper(v).isin("UNKNOWN", "N/A", "NONE", ""), v)

    digits = F.regexp_extract(F.replace(_field(answer, "CYCLE"), F.lit(","), F.lit("")), r"\d+", 0)
    return rows.withColumns({
        "module": named("MODULE"), "signal": named("SIGNAL"), "_digits": F.when(digits != "", digits)
    }).withColumn("cycle", F.expr("try_cast(_digits AS bigint)")).drop("_digits")


def score_blame(rows: DataFrame, tolerance: int = CYCLE_TOLERANCE) -> DataFrame:
    """Adds module_hit, signal_hit, cycle_hit and answered.

    rows: answer, true_module, true_before, true_context, true_cycle.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\w$]+"), 0)
    names = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(IDENTIFIER), 0)
    target = F.array_except(F.concat(names("true_before"), names("true_context")), F.array(*[F.lit(w) for w in STOP_WORDS]))
    no = F.lit(False)
    return parse_blame(rows).withColumns({
        "module_hit": F.coalesce(F.array_contains(words("module"), F.lower("true_module")), no),
        "signal_hit": F.coalesce(F.arrays_overlap(names("signal"), target), no),
        "cycle_hit": F.coalesce(F.abs(F.col("cycle") - F.col("true_cycle")) <= tolerance, no),
        "answered": F.col("module").isNotNull() | F.col("signal").isNotNull() | F.col("cycle").isNotNull(),
    })


def cycle_any_base(answer: Column, true_cycle: Column, tolerance: int = CYCLE_TOLERANCE) -> Column:
    """Is the quoted cycle right read as decimal or as hexadecimal."""
    token = F.regexp_extract(F.coalesce(answer, F.lit("")), CYCLE_TOKEN, 1)
    decimal = F.when(token.rlike("^[0-9]{1,18}$"), F.when(token.rlike("^[0-9]{1,18}$"), token).cast("long"))
    near = lambda v: F.coalesce(F.abs(v - true_cycle) <= tolerance, F.lit(False))
    return near(decimal) | near(hex_to_u64(token).cast("decimal(22,0)"))
