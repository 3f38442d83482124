"""A seeded 32-bit mix in plain integer arithmetic, the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
# Odd multipliers of the two seeds and of the mixing rounds.
SEED_A, SEED_B, ROUND = 2654435761, 40503, 0x45D9F3B


def mix32(a: Column, b: Column) -> Column:
    """Well-spread number in [0, 2^32) for a pair of integers."""
    x = (a.cast("long") * F.lit(SEED_A) + b.cast("long") * F.lit(SEED_B)).bitwiseAND(F.lit(MASK))
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(ROUND)).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 16))


def mix32_sql(a: str, b: str) -> str:
    x = f"(({a} * {SEED_A} + {b} * {SEED_B}) & {MASK})"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * {ROUND}) & {MASK})"
    return f"xor({x}, {x} >> 16)"
