"""Quartets: all 4-subsets of samples, chosen ones, and their number.

A quartet's rank is its place in lexicographic order. Ranks are unranked by column
expressions, so neither the driver nor a task ever holds all quartets.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chance import draw, order_key
from ..functions.numbering import BUCKETS, first_rows
from ..session import shared_table

NAMES = ["i0", "i1", "i2", "i3"]
MOST = 4_294_967_295
#: Up to so many ranks are put in a hash order unless more are asked for; beyond, a keyed permutation picks them.
SORTED = 1 << 22


def unranked(ranks: DataFrame, n: int, rank: str = "rank") -> DataFrame:
    """ranks with i0 < i1 < i2 < i3, its quartets of n samples, added.

    The combinatorial number system: the complement of a lexicographic rank is a sum of
    binomials of decreasing tops, and each top is found in the sorted list of binomials.
    """
    out = ranks.withColumn("_left", F.lit(comb(n, 4) - 1).cast("long") - F.col(rank))
    for place, k in enumerate((4, 3, 2, 1)):
        tops = [comb(t, k) for t in range(n)]
        array = F.array(*[F.lit(v).cast("long") for v in tops])
        # the largest top whose binomial is at most what is left
        top = F.size(F.filter(array, lambda b: b <= F.col("_left"))) - 1
        out = out.withColumn("_top", top)
        out = out.withColumn(NAMES[place], (F.lit(n - 1) - F.col("_top")).cast("int"))
        out = out.withColumn("_left", F.col("_left") - F.element_at(array, F.col("_top") + 1))
    return out.drop("_left", "_top")


def rank_of(n: int) -> Column:
    """The rank of i0 < i1 < i2 < i3 among the quartets of n samples."""
    rank = F.lit(comb(n, 4) - 1).cast("long")
    for name, k in zip(NAMES, (4, 3, 2, 1)):
        tops = F.array(*[F.lit(comb(t, k)).cast("long") for t in range(n)])
        rank = rank - F.element_at(tops, F.lit(n) - F.col(name))
    return rank


def all_quartets(spark: SparkSession, n: int) -> DataFrame:
    """rank and quartet of all 4-subsets of n samples, from a range that Spark cuts into tasks."""
    return unranked(spark.range(comb(n, 4)).withColumnRenamed("id", "rank"), n)


def quartets_of(samples: DataFrame) -> DataFrame:
    """All 4-subsets of the sample indices of a table, by inequality joins."""
    s = samples.select("sample_idx").distinct()
    out = s.select(F.col("sample_idx").alias("i0"))
    for before, name in zip(NAMES, NAMES[1:]):
        out = out.join(F.broadcast(s.select(F.col("sample_idx").alias(name))), F.col(before) < F.col(name))
    return out


def _feistel(x: Column, half_bits: int, seed: int) -> Column:
    """A keyed permutation of the numbers of 2 * half_bits bits."""
    mask = (1 << half_bits) - 1
    left, right = F.shiftright(x, half_bits), x.bitwiseAND(mask)
    for r in range(4):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(seed), F.lit(r)).bitwiseAND(F.lit(mask)))
    return F.shiftleft(left, half_bits).bitwiseOR(right)


def random_quartets(spark: SparkSession, n: int, k: int, seed: int, rep: int = 0, ordered: int = SORTED) -> DataFrame:
    """k distinct quartets. Universes of up to `ordered` are ordered by a hash; in larger ones numbers 0.. go through a permutation.

    The hash order is one that SQL can repeat, at a hash for each quartet of the universe;
    the permutation costs what the chosen quartets do.
    """
    total = comb(n, 4)
    if k >= total:
        return all_quartets(spark, n)
    if total <= ordered:
        ranks = spark.range(total).withColumnRenamed("id", "rank")
        key = order_key(seed, rep, F.col("rank"))
        if total > SORTED:
            ranks, key = _early(ranks.withColumn("key", key), k, total), F.col("key")
        return unranked(first_rows(ranks, k, F.conv(F.substring(key, 1, 4), 16, 10).cast("int"), key, "rank").select("rank"), n)
    half = (total.bit_length() + 1) // 2
    domain = 1 << 2 * half
    taken = min(domain, k * domain // total + k * domain // total // 8 + 1024)
    while True:  # numbers that the permutation sends beyond the last rank are left out
        ids = spark.range(taken)
        ranks = ids.select("id", _feistel(F.col("id"), half, seed * 1_000_003 + rep).alias("rank")).where(F.col("rank") < total)
        if taken == domain or ranks.count() >= k:
            bucket = F.expr(f"id div {-(-taken // BUCKETS)}")
            return unranked(first_rows(ranks, k, bucket, "id").select("rank"), n)
        taken = min(domain, 2 * taken)


def _early(ranks: DataFrame, k: int, total: int) -> DataFrame:
    """Rows with the least keys, k or somewhat more, as a table: of many rows each key is made once."""
    wanted = k + k // 16 + 1024
    while True:  # a cut on the first 32 bits; it leaves too few next to never
        cut = wanted * (1 << 32) // total + 1
        held = shared_table(ranks if cut >= 1 << 32 else ranks.where(F.col("key") < f"{cut:08x}"), "ranks")
        if cut >= 1 << 32 or held.count() >= k:
            return held
        wanted *= 2


def budget(n: int, wanted: int = 0, default: str = "all") -> dict:
    """How many quartets to take, never more than there are. default: what 0 means, "all" or "rough".

    rough: the number from which samples of quartets cover a tree well.
    """
    total, rough = comb(n, 4), int(n**2.8)
    if total >= MOST:
        raise ValueError(f"{n} samples have {total} quartets; at most {MOST - 1} are supported")
    if wanted <= 0:
        taken = min(rough, total) if default == "rough" else total
    else:
        taken = min(wanted, total)
    return {"n_samples": n, "total": total, "rough": rough, "taken": taken, "sparse": 0 < wanted < min(rough, total)}


def budgets(rows: DataFrame, n: str = "n_samples", wanted: str = "wanted") -> DataFrame:
    """rows with total, rough and taken as budget() gives them, null where a universe is too large."""
    total = F.expr(f"cast(cast({n} as decimal(38,0)) * ({n} - 1) * ({n} - 2) * ({n} - 3) / 24 as bigint)")
    out = rows.withColumn("total", F.when(F.col(n) < 4, F.lit(0).cast("long")).otherwise(total)).withColumn("total", F.when(F.col("total") < MOST, F.col("total")))
    out = out.withColumn("rough", F.when(F.col("total").isNotNull(), F.floor(F.pow(F.col(n).cast("double"), F.lit(2.8)))))
    return out.withColumn("taken", F.when(F.col(wanted) <= 0, F.col("total")).when(F.col("total").isNotNull(), F.least(F.col(wanted).cast("long"), F.col("total"))))


def _drawn(edges: DataFrame, quota: int, seed: int) -> DataFrame:
    """edge_id, left, right and up to `quota` distinct numbers under the edge's number of two-and-two quartets (total).

    Where an edge has fewer than twice the quota, its numbers are all put in a hash order
    and the first taken; else tries 0, 1, .. each name a number by hash, and the first
    `quota` distinct ones count. Some more tries than the quota are enough then; what they
    leave short is topped up with the rest.
    """
    pairs = lambda c: F.expr(f"cast(size({c}) as bigint) * (size({c}) - 1) div 2")
    sized = edges.withColumn("total", pairs("left") * pairs("right")).where("total > 0")
    few = F.col("total") < 2 * quota
    rows = sized.withColumn("try", F.explode(F.sequence(F.lit(0).cast("long"), F.when(few, F.col("total")).otherwise(F.lit(3 * quota + 64)) - 1)))
    number = F.when(few, F.col("try")).otherwise(F.pmod(draw(seed, F.col("edge_id"), F.col("try")) * (1 << 20) + draw(seed + 1, F.col("edge_id"), F.col("try")) % (1 << 20), F.col("total")))
    rows = rows.withColumn("number", number).groupBy("edge_id", "left", "right", "total", "number").agg(F.min("try").alias("try"))  # some quotas of rows an edge
    order = F.when(few, order_key(seed, F.col("edge_id"), F.col("number"))).otherwise(F.lpad(F.col("try").cast("string"), 20, "0"))
    place = F.row_number().over(Window.partitionBy("edge_id").orderBy(order, "number"))
    return rows.withColumn("place", place).where(F.col("place") <= quota).select("edge_id", "left", "right", "number")


def _pair(array: str, number: str) -> tuple[Column, Column]:
    """The pair (i < j) of an array's members with a number: those with j, before them those with smaller j."""
    j = F.expr(f"cast(floor((1 + sqrt(8 * {number} + 1)) / 2) as bigint)")
    j = F.when(j * (j - 1) / 2 > F.col(number), j - 1).when((j + 1) * j / 2 <= F.col(number), j + 1).otherwise(j)
    i = F.col(number) - j * (j - 1) / 2
    return F.get(array, i.cast("int")), F.get(array, j.cast("int"))


def equal_split_quartets(edges: DataFrame, samples: DataFrame, k: int, seed: int) -> DataFrame:
    """About k quartets dealt evenly over a guide tree's internal edges, edge null where chosen beyond the quotas.

    edges: edge_id, left, right (arrays of sample indices on both sides). Each edge draws
    a pair from each side, up to its quota of distinct ones; what is short is topped up
    by random quartets of all samples. Nothing is listed but what is drawn.
    """
    spark = edges.sparkSession
    quota = -(-k // max(1, edges.count()))
    drawn = _drawn(edges, quota, seed).withColumn("_n", F.expr("cast(size(right) as bigint) * (size(right) - 1) div 2"))
    drawn = drawn.withColumn("_l", F.expr("number div _n")).withColumn("_r", F.col("number") % F.col("_n"))
    four = drawn.select("edge_id", F.array_sort(F.array(*_pair("left", "_l"), *_pair("right", "_r"))).alias("q"))
    first = four.groupBy(*[F.element_at("q", i + 1).alias(NAMES[i]) for i in range(4)]).agg(F.min("edge_id").alias("edge_id"))
    every = [r.sample_idx for r in samples.select("sample_idx").distinct().orderBy("sample_idx").collect()]  # one row a sample
    more = random_quartets(spark, len(every), k, seed).select(*[F.get(F.array(*map(F.lit, every)), F.col(c)).cast("int").alias(c) for c in NAMES])
    rest = more.join(first, NAMES, "left_anti").withColumn("edge_id", F.lit(None).cast("int"))
    both = first.select(*NAMES, "edge_id").withColumn("late", F.lit(0)).unionByName(rest.withColumn("late", F.lit(1)))
    key = order_key(seed, *map(F.col, NAMES))
    half = F.conv(F.substring(key, 1, 4), 16, 10).cast("int") / 2
    bucket = (F.col("late") * (BUCKETS // 2) + F.floor(half)).cast("int")
    return first_rows(both, k, bucket, "late", key, *NAMES).drop("late")
