"""From scored quartets to the weighted splits that a supertree is built from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chance import order_key
from ..functions.scores import ratio, weight
from .quartets import NAMES


def split_order(quartets: DataFrame) -> DataFrame:
    """quartets with a, b, c, d: the resolution ab|cd that res names."""
    i0, i1, i2, i3 = map(F.col, NAMES)
    order = {0: (i0, i1, i2, i3), 1: (i0, i2, i1, i3), 2: (i0, i3, i1, i2)}
    pick = lambda k: F.when(F.col("res") == 0, order[0][k]).when(F.col("res") == 1, order[1][k]).otherwise(order[2][k])
    return quartets.withColumns({name: pick(k) for k, name in enumerate("abcd")})


def filtered(quartets: DataFrame, strategy: int, min_snps: int = 0, min_ratio: float = 1.0) -> DataFrame:
    """Quartets with at least max(1, min_snps) sites and a ratio of at least min_ratio; weight is added."""
    rows = quartets.withColumn("weight", weight(strategy)).withColumn("ratio", ratio(strategy))
    return rows.where((F.col("nsnps") >= max(1, min_snps)) & (F.col("ratio") >= min_ratio))


def weighted_splits(quartets: DataFrame, strategy: int = 1, min_snps: int = 0, min_ratio: float = 1.0, skip_zero: bool = False) -> DataFrame:
    """rep (if any), a, b, c, d, weight. A quartet without a weight (strategy 3, all scores 0) says nothing and goes; with skip_zero all whose scores are 0 do."""
    keys = ["rep"] if "rep" in quartets.columns else []
    if skip_zero:
        quartets = quartets.where("s0 <> 0 OR s1 <> 0 OR s2 <> 0")
    return split_order(filtered(quartets, strategy, min_snps, min_ratio).where("weight IS NOT NULL")).select(*keys, "a", "b", "c", "d", "weight")


def qmc_lines(splits: DataFrame) -> DataFrame:
    """splits as text lines a,b|c,d:w with five decimals."""
    line = F.format_string("%d,%d|%d,%d:%.5f", "a", "b", "c", "d", "weight")
    keys = ["rep"] if "rep" in splits.columns else []
    return splits.select(*keys, line.alias("line"))


def shuffled(lines: DataFrame, seed: int) -> DataFrame:
    """lines with column key: sorting by it deals them in a random order that is the same every time."""
    return lines.withColumn("key", order_key(seed, F.col("line")))
