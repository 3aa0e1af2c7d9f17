"""Site-pattern counts of quartets, relationally.

A site counts for a quartet when none of its four codes is missing and they aren't all
equal. Its pattern is the cell (4a + b, 4c + d) of a 16 x 16 matrix. codes: sample_idx,
locus, site, code, and rep where there are replicates. Without quartets all that occur
are counted, by joins on the site; quartets (Ranks, or distinct i0..i3) go to packed blocks instead
(see packed), so that nothing else is counted. n is the number of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chance import order_key
from .packed import Ranks, asked_counts
from .quartets import NAMES


def _keys(codes: DataFrame) -> list[str]:
    return ["rep"] if "rep" in codes.columns else []


def distinct_columns(codes: DataFrame) -> DataFrame:
    """codes of one site for each distinct column of the matrix, with mult, the number of sites alike."""
    keys = _keys(codes)
    column = F.array_sort(F.collect_list(F.struct("sample_idx", "code")))
    columns = codes.where(F.col("code").isNotNull()).groupBy(*keys, "site").agg(column.alias("column"))
    alike = columns.groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("mult"), F.min("site").alias("site"))
    cells = alike.select(*keys, F.lit(0).cast("long").alias("locus"), "site", "mult", F.explode("column").alias("cell"))
    return cells.select(*keys, "locus", "site", F.col("cell.sample_idx").alias("sample_idx"), F.col("cell.code").alias("code"), "mult")


def patterns(codes: DataFrame) -> DataFrame:
    """One row for each quartet and site that counts: keys, i0..i3, r, c, locus, site (and mult)."""
    keys = [*_keys(codes), "site"]
    mult = ["mult"] if "mult" in codes.columns else []
    known = codes.where(F.col("code").isNotNull())
    out = known.select(*keys, "locus", *mult, F.col("sample_idx").alias("i0"), F.col("code").alias("c0"))
    for k in (1, 2, 3):
        other = known.select(*keys, F.col("sample_idx").alias(f"i{k}"), F.col("code").alias(f"c{k}"))
        out = out.join(other, keys).where(F.col(f"i{k - 1}") < F.col(f"i{k}"))
    out = out.where(~((F.col("c0") == F.col("c1")) & (F.col("c1") == F.col("c2")) & (F.col("c2") == F.col("c3"))))
    r, c = F.col("c0") * 4 + F.col("c1"), F.col("c2") * 4 + F.col("c3")
    return out.select(*keys, "locus", *NAMES, r.cast("int").alias("r"), c.cast("int").alias("c"), *mult)


def pattern_counts(codes: DataFrame, quartets: DataFrame | Ranks | None = None, n: int = 0, compress: bool = True) -> DataFrame:
    """keys, i0..i3, r, c, n over all sites. compress: count each distinct column of the matrix once, with its multiplicity."""
    if quartets is not None:
        return asked_counts(codes, quartets, n)
    keys = _keys(codes)
    if compress:
        rows, sites = patterns(distinct_columns(codes)), F.sum("mult")
    else:
        rows, sites = patterns(codes), F.count(F.lit(1))
    return rows.groupBy(*keys, *NAMES, "r", "c").agg(sites.cast("long").alias("n"))


def unlinked_counts(codes: DataFrame, quartets: DataFrame | Ranks | None = None, n: int = 0) -> DataFrame:
    """As pattern_counts, but of each locus only the first site that counts for the quartet."""
    if quartets is not None:
        return asked_counts(codes, quartets, n, True)
    keys = _keys(codes)
    # site and pattern in one number: its minimum is a hash aggregate, that of a struct a sort
    first = F.min(F.col("site") * 256 + F.col("r") * 16 + F.col("c")).alias("p")
    chosen = patterns(codes).groupBy(*keys, *NAMES, "locus").agg(first)
    r, c = (F.shiftright(F.col("p"), 4) % 16).cast("int"), (F.col("p") % 16).cast("int")
    return chosen.groupBy(*keys, *NAMES, r.alias("r"), c.alias("c")).agg(F.count(F.lit(1)).alias("n"))


def random_site_counts(codes: DataFrame, seed: int, quartets: DataFrame | Ranks | None = None, n: int = 0) -> DataFrame:
    """As unlinked_counts, with a random site of each locus."""
    if quartets is not None:
        return asked_counts(codes, quartets, n, True, seed)
    keys = _keys(codes)
    rep = F.col("rep") if keys else F.lit(0)
    order = F.struct(order_key(seed, rep, *map(F.col, NAMES), F.col("site")), "site")
    chosen = patterns(codes).groupBy(*keys, *NAMES, "locus").agg(F.min_by(F.struct("r", "c"), order).alias("p"))
    return chosen.groupBy(*keys, *NAMES, F.col("p.r").alias("r"), F.col("p.c").alias("c")).agg(F.count(F.lit(1)).alias("n"))


def flattenings(counts: DataFrame) -> DataFrame:
    """The three flattenings of each count: column f (0: 01|23, 1: 02|13, 2: 03|12) and its cell r, c."""
    a, b = F.expr("r div 4"), F.col("r") % 4
    c, d = F.expr("c div 4"), F.col("c") % 4
    cells = [(0, a * 4 + b, c * 4 + d), (1, a * 4 + c, b * 4 + d), (2, a * 4 + d, b * 4 + c)]
    cells = F.array(*[F.struct(F.lit(f).alias("f"), x.cast("int").alias("r"), y.cast("int").alias("c")) for f, x, y in cells])
    rest = [k for k in counts.columns if k not in ("r", "c")]
    return counts.withColumn("cell", F.explode(cells)).select(*rest, "cell.f", "cell.r", "cell.c")


def quartet_nsnps(counts: DataFrame) -> DataFrame:
    """keys, i0..i3, nsnps."""
    return counts.groupBy(*_keys(counts), *NAMES).agg(F.sum("n").alias("nsnps"))


def mean_nsnps(nsnps: DataFrame) -> DataFrame:
    keys = _keys(nsnps)
    return nsnps.groupBy(*keys).agg(F.avg("nsnps").alias("mean_nsnps")) if keys else nsnps.agg(F.avg("nsnps").alias("mean_nsnps"))


def dense_rows(counts: DataFrame) -> DataFrame:
    """keys, i0..i3, nsnps, cells (256 counts, row by row): one row a quartet."""
    keys = _keys(counts)
    filled = F.map_from_entries(F.collect_list(F.struct((F.col("r") * 16 + F.col("c")).alias("k"), "n")))
    grouped = counts.groupBy(*keys, *NAMES).agg(filled.alias("m"), F.sum("n").alias("nsnps"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long")))
    return grouped.select(*keys, *NAMES, "nsnps", cells.alias("cells"))
