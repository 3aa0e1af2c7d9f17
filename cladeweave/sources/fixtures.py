"""Inputs of the right shape derived from the driver's tables."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quartets import unranked
from ..operators.treeindex import TreeIndex, located
from ..operators.trees import parse_newick

SAMPLES, MANY = 12, 60
TREE = "((((0,1),(2,3)),((4,5),(6,7))),((8,9),(10,11)));"
REPLICATE_TREES = (
    TREE,
    "((((0,1),(2,3)),((4,6),(5,7))),((8,9),(10,11)));",
    "((((0,2),(1,3)),((4,5),(6,7))),((8,10),(9,11)));",
    "(((((0,1),2),3),((4,5),(6,7))),((8,9),(10,11)));",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snps(spark: SparkSession, sf_dir: str, n: int = SAMPLES) -> DataFrame:
    """sample_idx, locus, site, base of n samples from the embeddings' signs and sizes."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    v, i = F.col("x").cast("double"), F.col("vec_id")
    base = (
        F.when((i * 31 + F.col("pos") * 17) % 23 == 0, 78)
        .when((i * 13 + F.col("pos") * 7) % 29 == 0, 82)
        .when(v < -0.125, 65)
        .when(v < 0, 67)
        .when(v < 0.125, 71)
        .otherwise(84)
    )
    locus = F.expr(f"vec_id div {n}")
    return cells.select((i % n).cast("int").alias("sample_idx"), locus.alias("locus"), (locus * 64 + F.col("pos")).alias("site"), base.cast("int").alias("base"))


def scored_quartets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rep, i0..i3, s0..s2, res, nsnps from line items."""
    lines = table(spark, sf_dir, "lineitem")
    least = lambda flag: F.coalesce(F.min(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice"))), F.lit(0.001))
    groups = lines.groupBy((F.col("l_linenumber") % 4).cast("int").alias("rep"), (F.col("l_orderkey") % 495).alias("rank"))
    scored = groups.agg(least("A").alias("s0"), least("N").alias("s1"), least("R").alias("s2"), F.count(F.lit(1)).alias("nsnps"))
    res = F.when((F.col("s0") <= F.col("s1")) & (F.col("s0") <= F.col("s2")), 0).when(F.col("s1") <= F.col("s2"), 1).otherwise(2)
    return unranked(scored, SAMPLES).select("rep", "i0", "i1", "i2", "i3", "s0", "s1", "s2", res.alias("res"), "nsnps")


def asked_ranks(spark: SparkSession, sf_dir: str, n: int = MANY) -> DataFrame:
    """rank: distinct ranks of quartets of n samples that line items name."""
    return table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31) % comb(n, 4)).alias("rank")).distinct()


def told_quartets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored_quartets whose resolution is what REPLICATE_TREES[rep] says of them: the data's weights, and trees that are known."""
    rows = scored_quartets(spark, sf_dir).drop("res")
    told = [located(rows.where(F.col("rep") == rep), TreeIndex(parse_newick(text))) for rep, text in enumerate(REPLICATE_TREES)]
    every = told[0]
    for part in told[1:]:
        every = every.unionByName(part)
    return every.where("r IS NOT NULL").drop("span", "edge_id").withColumnRenamed("r", "res")


def capped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rep, i0..i3, r, c, n from line items, in 16 patterns (a, b, f, g) of two orthogonal Latin squares of order 4.

    Each flattening then holds the 16 numbers of a quartet, one in each row and column: all
    three have rank 16, and their singular values are these numbers.
    """
    lines = table(spark, sf_dir, "lineitem").withColumn("rank", F.col("l_orderkey") % 495).withColumn("rep", (F.col("l_orderkey") % 2).cast("long"))
    kind = (F.col("l_linenumber") % 4 * 4 + F.dayofmonth("l_shipdate") % 4).cast("int")
    sums = lines.groupBy("rep", "rank").agg(F.array(*[F.sum(F.when(kind == k, 1).otherwise(0)) + k + 1 for k in range(16)]).alias("m"))
    cells = sums.select("rep", "rank", F.posexplode("m").alias("k", "n"))
    a, b = F.expr("k div 4").cast("int"), (F.col("k") % 4).cast("int")
    # multiplication by the two generators of the field of four elements
    times = lambda x, table: F.element_at(F.array(*map(F.lit, table)), x + 1)
    f, g = a.bitwiseXOR(times(b, (0, 2, 3, 1))), a.bitwiseXOR(times(b, (0, 3, 1, 2)))
    return unranked(cells.withColumn("r", a * 4 + b).withColumn("c", (f * 4 + g).cast("int")), SAMPLES).select("rep", "i0", "i1", "i2", "i3", "r", "c", F.col("n").cast("long").alias("n"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, name."""
    return table(spark, sf_dir, "nation").where(F.col("n_nationkey") < SAMPLES).select(F.col("n_nationkey").alias("sample_idx"), F.col("n_name").alias("name"))


def populations(spark: SparkSession, sf_dir: str, name: str = "customer") -> DataFrame:
    """pop, sample_idx: customers (or suppliers) by nation."""
    key, pop = {"customer": ("c_custkey", "c_nationkey"), "supplier": ("s_suppkey", "s_nationkey")}[name]
    return table(spark, sf_dir, name).select(F.col(pop).cast("int").alias("pop"), F.col(key).cast("int").alias("sample_idx"))


def known_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rep, i0..i3, r, c, n from line items: x(a) * y(b) sites with the bases a, b, a, b.

    x and y count a quartet's lines by number and by day. One flattening then has rank 1
    and the other two hold the products on a diagonal, so all singular values are known.
    rep 0: the second flattening has rank 1 (a, b, a, b); 1: the third (a, b, b, a); 2: the first (a, a, b, b).
    """
    lines = table(spark, sf_dir, "lineitem").withColumn("rank", F.col("l_orderkey") % 495).withColumn("rep", (F.col("l_orderkey") % 3).cast("long"))
    part = lambda c: [F.sum(F.when(c == k, 1).otherwise(0)) + k + 1 for k in range(4)]
    sums = lines.groupBy("rep", "rank").agg(F.array(*part(F.col("l_linenumber") % 4)).alias("x"), F.array(*part(F.dayofmonth("l_shipdate") % 4)).alias("y"))
    cells = sums.select("rep", "rank", F.posexplode("x").alias("a", "m"), "y").select("rep", "rank", "a", "m", F.posexplode("y").alias("b", "k"))
    cells = cells.withColumn("n", (F.col("m") * F.col("k")).cast("long"))
    a, b = F.col("a"), F.col("b")
    r = F.when(F.col("rep") == 2, a * 4 + a).otherwise(a * 4 + b).cast("int")
    c = F.when(F.col("rep") == 0, a * 4 + b).when(F.col("rep") == 1, b * 4 + a).otherwise(b * 4 + b).cast("int")
    return unranked(cells.withColumn("r", r).withColumn("c", c), SAMPLES).select("rep", "i0", "i1", "i2", "i3", "r", "c", "n")
