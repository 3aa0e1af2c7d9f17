"""From bases to codes, and what a matrix holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import base_code, gap_to_missing, resolved
from ..functions.chance import coin


def resolve_ambiguity(snps: DataFrame, seed: int, rep=0) -> DataFrame:
    """Two-base codes become one of their bases by a coin for (seed, rep, sample, site)."""
    rep = F.col("rep") if "rep" in snps.columns else F.lit(rep)
    return snps.withColumn("base", resolved(gap_to_missing(F.col("base")), coin(seed, rep, F.col("sample_idx"), F.col("site"))))


def encode(snps: DataFrame, seed: int, rep=0) -> DataFrame:
    """snps with column code (0 to 3, null where missing) in place of base."""
    return resolve_ambiguity(snps, seed, rep).withColumn("code", base_code(F.col("base"))).drop("base")


def zero_based(snps: DataFrame) -> DataFrame:
    """A matrix whose loci count from 1 counts from 0."""
    return snps.withColumn("locus", F.col("locus") - 1)


def matrix_summary(snps: DataFrame) -> DataFrame:
    """One row: n_samples, n_sites, n_loci."""
    return snps.agg(F.countDistinct("sample_idx").alias("n_samples"), F.countDistinct("site").alias("n_sites"), F.countDistinct("locus").alias("n_loci"))


def locus_spans(snps: DataFrame) -> DataFrame:
    """locus, start, end (past the last site), n_sites."""
    return snps.groupBy("locus").agg(F.min("site").alias("start"), (F.max("site") + 1).alias("end"), F.countDistinct("site").alias("n_sites"))


def numbered_samples(names: DataFrame) -> DataFrame:
    """sample_idx by order of name, for input that only has names."""
    from pyspark.sql import Window

    return names.select((F.row_number().over(Window.orderBy("name")) - 1).alias("sample_idx"), "name")
