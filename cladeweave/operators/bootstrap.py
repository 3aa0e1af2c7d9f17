"""Bootstrap replicates as rows: loci drawn with replacement, sites shuffled within each draw.

Replicate 0 is the data as they are. A draw's number is its locus from then on, so a
locus drawn twice counts as two. Everything is keyed by (seed, rep, draw, site).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chance import draw, order_key
from ..functions.numbering import numbered
from .encode import encode, locus_spans


def draws(snps: DataFrame, reps: int, seed: int) -> DataFrame:
    """rep (1..reps), rlocus (the draw), locus (what was drawn), n_sites."""
    spark = snps.sparkSession
    spans = locus_spans(snps)
    loci = numbered(spans, "number", {"_bin": F.expr("locus div 4096")}, "locus")
    n = spans.count()
    every = spark.range(1, reps + 1).withColumnRenamed("id", "rep").crossJoin(spark.range(n).withColumnRenamed("id", "rlocus")) if n else None
    if every is None:
        return loci.select(F.lit(0).cast("long").alias("rep"), F.lit(0).cast("long").alias("rlocus"), "locus", "n_sites").limit(0)
    drawn = every.withColumn("number", F.pmod(draw(seed, F.col("rep"), F.col("rlocus")), F.lit(n)))
    return drawn.join(loci, "number").select("rep", "rlocus", "locus", "n_sites")


def widths(drawn: DataFrame) -> DataFrame:
    """rep, width: sites of each replicate."""
    return drawn.groupBy("rep").agg(F.sum("n_sites").alias("width"))


def resampled(snps: DataFrame, drawn: DataFrame, seed: int) -> DataFrame:
    """rep, rlocus, rsite, site, sample_idx, base of each replicate.

    rsite numbers a replicate's sites: the draws' starts are prefix sums over draws, the
    order inside a draw is by hash.
    """
    before = F.coalesce(F.sum("n_sites").over(Window.partitionBy("rep").orderBy("rlocus").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = drawn.withColumn("first", before)
    sites = snps.select("locus", "site").distinct()
    order = Window.partitionBy("rep", "rlocus").orderBy(order_key(seed, F.col("rep"), F.col("rlocus"), F.col("site")), "site")
    placed = starts.join(sites, "locus").withColumn("rsite", F.col("first") + F.row_number().over(order) - 1)
    return placed.select("rep", "rlocus", "rsite", "locus", "site").join(snps, ["locus", "site"]).select("rep", "rlocus", "rsite", "site", "sample_idx", "base")


def replicate_codes(snps: DataFrame, reps: int, seed: int) -> DataFrame:
    """rep, locus, site, sample_idx, code of replicates 0..reps, ambiguity resolved anew in each."""
    names = ["rep", "locus", "site", "sample_idx", "code"]
    zero = encode(snps, seed).withColumn("rep", F.lit(0).cast("long")).select(*names)
    if reps < 1:
        return zero
    more = resampled(snps, draws(snps, reps, seed), seed).select("rep", F.col("rlocus").alias("locus"), F.col("rsite").alias("site"), "sample_idx", "base")
    return zero.unionByName(encode(more, seed).select(*names))


def population_pick(members: DataFrame, reps: int, seed: int) -> DataFrame:
    """rep, pop, sample_idx: one random member of each population in each replicate."""
    every = members.crossJoin(members.sparkSession.range(reps).withColumnRenamed("id", "rep"))
    place = F.row_number().over(Window.partitionBy("rep", "pop").orderBy(order_key(seed, F.col("rep"), F.col("pop"), F.col("sample_idx")), "sample_idx"))
    return every.withColumn("place", place).where("place = 1").select("rep", "pop", "sample_idx")


def population_map(members: DataFrame) -> DataFrame:
    """pop, samples (in order)."""
    return members.groupBy("pop").agg(F.array_sort(F.collect_list("sample_idx")).alias("samples"))


def population_subset(samples: DataFrame, members: DataFrame) -> DataFrame:
    """Samples that a population map names."""
    return samples.join(members.select("sample_idx").distinct(), "sample_idx", "left_semi")
