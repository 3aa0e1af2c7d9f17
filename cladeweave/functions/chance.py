"""Randomness from keys: the same seed and keys give the same draw on any cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*keys) -> Column:
    """32 random bits from the MD5 of the keys joined by colons."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def coin(*keys) -> Column:
    return draw(*keys) % 2 == 1


def order_key(*keys) -> Column:
    """A random order of rows."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.md5(F.concat_ws(":", *parts))
