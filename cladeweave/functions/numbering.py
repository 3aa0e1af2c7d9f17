"""Row numbers and the first k rows without a window or sort over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that a hash order is cut into to find where the first k rows end.
BUCKETS = 1 << 16


def numbered(rows: DataFrame, name: str, bins: dict[str, Column], *order: str) -> DataFrame:
    """rows with their place, from 0, in the order of their bins and inside a bin by `order`.

    bins: columns, in order, that agree with the order wanted. Rows are numbered inside
    their bin; starts are prefix sums over the table of bins, which has a row for many.
    """
    binned = rows.withColumns(bins)
    sizes = binned.groupBy(*bins).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy(*bins).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*bins, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*bins).orderBy(*order)) - 1
    placed = binned.withColumn("_inside", inside).join(starts, list(bins))
    return placed.withColumn(name, F.col("_before") + F.col("_inside")).drop(*bins, "_before", "_inside")


def first_rows(rows: DataFrame, k: int, bucket: Column, *order) -> DataFrame:
    """The k rows that come first by bucket (a whole number under BUCKETS) and then by `order`.

    A count by bucket shows where the cut is: buckets before it are kept as they stand,
    and only the rows of the bucket on the cut are sorted.
    """
    held = rows.withColumn("_bucket", bucket)
    sizes = sorted((r[0], r[1]) for r in held.groupBy("_bucket").count().collect())
    taken, cut = 0, None
    for number, size in sizes:
        if taken + size > k:
            cut = number
            break
        taken += size
    if cut is None:
        return rows
    edge = held.where(F.col("_bucket") == cut).orderBy(*order).limit(k - taken)
    return held.where(F.col("_bucket") < cut).unionByName(edge).drop("_bucket")
