"""Base codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte values of bases, and the two bases of each ambiguity code (heads, tails).
A, C, G, T, GAP, MISSING = 65, 67, 71, 84, 45, 78
AMBIGUOUS = {82: (G, A), 75: (G, T), 83: (G, C), 89: (T, C), 87: (T, A), 77: (C, A)}


def chosen(cases: dict, key: Column, otherwise: Column | None = None) -> Column:
    """A CASE over literal keys."""
    found = None
    for k, v in cases.items():
        value = v if isinstance(v, Column) else F.lit(v)
        found = F.when(key == k, value) if found is None else found.when(key == k, value)
    return found if otherwise is None else found.otherwise(otherwise)


def gap_to_missing(base: Column) -> Column:
    return F.when(base == GAP, F.lit(MISSING)).otherwise(base)


def base_code(base: Column) -> Column:
    """0 to 3 for A, C, G, T; anything else is null, that is missing."""
    return chosen({A: 0, C: 1, G: 2, T: 3}, base)


def resolved(base: Column, heads: Column) -> Column:
    """A two-base code becomes its first base on heads, else its second; other bases stay."""
    return chosen({code: F.when(heads, F.lit(a)).otherwise(F.lit(b)) for code, (a, b) in AMBIGUOUS.items()}, base, base)
