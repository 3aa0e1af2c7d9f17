"""The whole analysis: matrix, replicates, quartets, scores, trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bootstrap import draws, replicate_codes, resampled
from ..operators.consensus import split_frequencies
from ..operators.encode import encode
from ..operators.kernel import DENSE_CELLS, score_cells, score_dense
from ..operators.multiplicity import replicate_counts
from ..operators.packed import BLOCK_CELLS, Ranks, cell_counts, sparse_counts
from ..operators.quartets import NAMES, budget, random_quartets
from ..operators.refine import refined
from ..operators.supertree import supertrees
from ..operators.trees import split_rows
from ..operators.weights import filtered, weighted_splits
from ..session import shared_table
from ..sources.files import commit, commit_all, committed, write_quartets

#: Replicates that one pass over the matrix counts.
TOGETHER = 20


def score_blocks(codes: DataFrame, quartets: DataFrame | Ranks, n: int, seed: int, unlinked: bool = False) -> DataFrame:
    """(rep,) i0..i3, s0..s2, res, nsnps by tiles of ranks and blocks of the matrix; quartets without sites included."""
    return score_cells(cell_counts(codes, quartets, n, unlinked, empty=True), n, seed)


def chosen_quartets(spark: SparkSession, n: int, wanted: int, seed: int, rep: int) -> DataFrame | Ranks:
    k = budget(n, wanted)["taken"]
    return random_quartets(spark, n, k, seed, rep) if wanted else Ranks(n)


def by_multiplicities(cells: int, n_quartets: int, dense_cells: int = DENSE_CELLS) -> bool:
    """Whether replicates over all sites are counted together (see multiplicity) and not one by one on a resampled matrix.

    Together, each of several blocks sends 2 KB for every quartet and replicate through a
    shuffle; resampled, every cell goes through two, but a matrix of dense_cells or fewer
    then needs no shuffle of counts.
    """
    return cells > dense_cells or cells <= BLOCK_CELLS or n_quartets <= BLOCK_CELLS // 32


def run(
    snps: DataFrame, n: int, out: str, reps: int = 0, wanted: int = 0, seed: int = 0, unlinked: bool = False, dense_cells: int = DENSE_CELLS, counts_out: str | None = None, together: int = TOGETHER
) -> list[int]:
    """Score quartets of replicates 0..reps and write them below out by replicate; those already committed stay.

    A replicate is the unit of restart, and done only when its manifest row is there (see
    files.commit). The data are scored dense where the matrix has a bounded size, else by
    blocks; so are replicates with one site a locus. Replicates over all sites are counted
    `together` at a time. Either way a replicate resolves a cell's ambiguity code once, so
    the way doesn't change what it holds. counts_out: a folder that keeps each replicate's
    pattern counts too; they are counted once.
    """
    spark = snps.sparkSession
    have = committed(spark, out)
    cells = snps.select("site").distinct().count() * n
    left = [rep for rep in range(1, reps + 1) if rep not in have]
    drawn = draws(snps, reps, seed) if left else None

    def scored(codes: DataFrame, rep: int) -> DataFrame:
        quartets = chosen_quartets(spark, n, wanted, seed, rep)
        if cells <= dense_cells and not counts_out:
            return score_dense(codes, quartets, n, seed, unlinked, rep)
        counted = cell_counts(codes, quartets, n, unlinked, empty=True)
        if counts_out:
            counted = shared_table(counted, "counts")
            write_quartets(sparse_counts(counted, n), counts_out, rep)
        return score_cells(counted.withColumn("rep", F.lit(rep).cast("long")), n, seed).drop("rep")

    if 0 not in have:
        commit(scored(encode(snps, seed), 0), out, 0)
    if left and not unlinked and by_multiplicities(cells, budget(n, wanted)["taken"], dense_cells):
        for at in range(0, len(left), together):
            group = left[at : at + together]
            if wanted:
                quartets = reduce(DataFrame.unionByName, [chosen_quartets(spark, n, wanted, seed, rep).select(F.lit(rep).cast("long").alias("rep"), *NAMES) for rep in group])
            else:
                quartets = Ranks(n)
            counted = replicate_counts(snps, quartets, n, group, seed, empty=True)
            if counts_out:
                counted = shared_table(counted, "counts", "rep")
                for rep in group:
                    write_quartets(sparse_counts(counted.where(F.col("rep") == rep).drop("rep"), n), counts_out, rep)
            commit_all(score_cells(counted, n, seed), out, group)
        return [0] * (0 not in have) + left
    for rep in left:
        own = resampled(snps, drawn.where(F.col("rep") == rep), seed)
        if not unlinked:
            own = encode(own, seed)
        own = own.select("rep", F.col("rlocus").alias("locus"), F.col("rsite").alias("site"), "sample_idx", "base" if unlinked else "code")
        commit(scored((encode(own, seed) if unlinked else own).drop("rep"), rep), out, rep)
    return [0] * (0 not in have) + left


def replicate_scores(snps: DataFrame, n: int, reps: int, seed: int, unlinked: bool = False) -> DataFrame:
    """rep, i0..i3, s0..s2, res, nsnps of replicates 0..reps in one plan; those over all sites by multiplicities."""
    if unlinked or reps < 1:
        return score_blocks(replicate_codes(snps, reps, seed), Ranks(n), n, seed, unlinked)
    zero = cell_counts(encode(snps, seed), Ranks(n), n, empty=True).withColumn("rep", F.lit(0).cast("long"))
    return score_cells(zero.unionByName(replicate_counts(snps, Ranks(n), n, reps, seed, empty=True)), n, seed)


def replicate_trees(quartets: DataFrame, strategy: int = 1, min_snps: int = 0, min_ratio: float = 1.0, refine: bool = False) -> DataFrame:
    """rep, newick. refine: improve each tree by local search on the same quartets."""
    found = supertrees(weighted_splits(quartets, strategy, min_snps, min_ratio))
    if not refine:
        return found
    weighed = filtered(quartets, strategy, min_snps, min_ratio).where("weight IS NOT NULL")
    better = refined(weighed, {r.rep: r.newick for r in found.collect()})  # one row a replicate
    return quartets.sparkSession.createDataFrame(sorted(better.items()), "rep BIGINT, newick STRING")


def replicate_split_frequencies(spark: SparkSession, newicks: list[str]) -> DataFrame:
    """side, n, freq over trees whose tips are sample indices."""
    return split_frequencies(split_rows(spark, newicks), len(newicks))
