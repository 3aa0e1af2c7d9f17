"""Quartet weights, filters and concordance statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def least_score() -> Column:
    return F.least("s0", "s1", "s2")


def upper_mean() -> Column:
    """Mean of the two larger scores."""
    return (F.col("s0") + F.col("s1") + F.col("s2") - least_score()) / 2


def weight(strategy: int) -> Column:
    """0: 1; 1: mean of the two larger scores; 2: that over the least, 1 where it is 0; 3: 1 less the least's share."""
    total = F.col("s0") + F.col("s1") + F.col("s2")
    if strategy == 0:
        return F.lit(1.0)
    if strategy == 1:
        return upper_mean()
    if strategy == 2:
        return ratio(1)
    if strategy == 3:
        return F.when(total == 0, F.lit(None).cast("double")).otherwise(1 - least_score() / total)
    raise ValueError(f"no such weight strategy: {strategy}")


def ratio(strategy: int) -> Column:
    """How far the best resolution stands out; a perfect quartet and unweighted ones count as 1."""
    if strategy == 0:
        return F.lit(1.0)
    return F.when(least_score() == 0, F.lit(1.0)).otherwise(upper_mean() / least_score())


def concordance_score() -> Column:
    """As ratio, but 0 for a perfect quartet."""
    return F.when(least_score() == 0, F.lit(0.0)).otherwise(upper_mean() / least_score())


def best_resolution() -> Column:
    """The index of the least score, the first on ties; scores next to 0 count as 0."""
    s = [F.when(F.abs(F.col(c)) < 1e-9, F.lit(0.0)).otherwise(F.col(c)) for c in ("s0", "s1", "s2")]
    return F.when((s[0] <= s[1]) & (s[0] <= s[2]), 0).when(s[1] <= s[2], 1).otherwise(2)


def qc() -> Column:
    """Quartet concordance from conc, disc1, disc2; null without informative quartets."""
    counts = [F.col(c).cast("double") for c in ("conc", "disc1", "disc2")]
    total = counts[0] + counts[1] + counts[2]
    kinds = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0))
    terms = sum((F.when(c > 0, c / total * F.log(c / total)).otherwise(F.lit(0.0)) for c in counts), F.lit(0.0))
    return (
        F.when(total == 0, F.lit(None).cast("double"))
        .when(kinds == 1, F.when(F.col("conc") > 0, F.lit(1.0)).otherwise(F.lit(-1.0)))
        .otherwise(1 + terms / F.log(kinds.cast("double")))
    )


def qd() -> Column:
    """Quartet differential: 1 where both discordant resolutions are as frequent."""
    both = F.col("disc1") + F.col("disc2")
    return F.when(both == 0, F.lit(1.0)).otherwise(1 - F.abs(F.col("disc1") - F.col("disc2")) / F.when(both != 0, both))


def qi() -> Column:
    """Share of informative quartets; null without quartets."""
    total = F.col("conc") + F.col("disc1") + F.col("disc2") + F.col("nu")
    return F.when(total > 0, 1 - F.col("nu") / F.when(total != 0, total))


def qf() -> Column:
    """Share of a tip's informative quartets that are concordant; null without any."""
    total = F.col("qfc") + F.col("qfd")
    return F.when(total > 0, F.col("qfc") / F.when(total != 0, total))
