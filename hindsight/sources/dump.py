"""Text value-change dumps: ``#time`` markers and ``value id`` lines to change rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.functions.values import binary_to_u64
from hindsight.operators.ordered import running

MARK = r"^#(\d+)$"
SCALAR = r"^([01xzXZ])(\S+)$"
VECTOR = r"^[bB]([01xzXZ]+)\s+(\S+)$"


def parse_dump(lines: DataFrame, span: int) -> DataFrame:
    """(run_id, line_no, text) to (run_id, symbol, time, value, value_str, seq)."""
    text = F.col("text")
    mark = F.when(text.rlike(MARK), F.regexp_extract(text, MARK, 1).cast("long"))
    timed = running(lines, ["run_id"], ["line_no"], span, last={"time": mark})
    bits = F.when(text.rlike(VECTOR), F.regexp_extract(text, VECTOR, 1)).when(
        text.rlike(SCALAR), F.regexp_extract(text, SCALAR, 1)
    )
    symbol = F.when(text.rlike(VECTOR), F.regexp_extract(text, VECTOR, 2)).otherwise(
        F.regexp_extract(text, SCALAR, 2)
    )
    rows = timed.select(
        "run_id", F.col("line_no").alias("seq"), "time", bits.alias("bits"), symbol.alias("symbol")
    ).where("bits IS NOT NULL")
    value = binary_to_u64(F.col("bits"))
    return rows.select(
        "run_id", "symbol", "time", value.alias("value"),
        F.when(value.isNull(), F.col("bits")).alias("value_str"), "seq",
    )
