"""Concordance of resolved quartets with a fixed tree, by edge and by tip.

Quartets find their edge in the tree's index (see treeindex) as they stream by;
tree_quartets lists all that one edge resolves, for small trees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import concordance_score, qc, qd, qf, qi, upper_mean
from .quartets import NAMES
from .treeindex import TreeIndex, tree_resolution


def tree_quartets(edges: DataFrame) -> DataFrame:
    """i0..i3, r, edge_id of the quartets that exactly one edge of the tree resolves. edges: edge_id, a, b, c, d."""
    rows = edges
    for c in "abcd":
        rows = rows.withColumn(c, F.explode(c))
    four = F.array_sort(F.array("a", "b", "c", "d"))
    rows = rows.withColumn("q", four)
    first = F.element_at("q", 1)
    mate = F.when(F.col("a") == first, F.col("b")).when(F.col("b") == first, F.col("a")).when(F.col("c") == first, F.col("d")).otherwise(F.col("c"))
    places = [F.element_at("q", i + 1).cast("int").alias(NAMES[i]) for i in range(4)]
    return rows.select(*places, (F.array_position("q", mate) - 2).cast("int").alias("r"), "edge_id")


def mapped(quartets: DataFrame, tree: TreeIndex, min_snps: int = 0, min_ratio: float = 1.0, need_data: bool = False) -> DataFrame:
    """Quartets of the tree with weight, score, informative and kind (0 concordant, 1 and 2 discordant: the lower and higher other index)."""
    rows = tree_resolution(quartets, tree)
    score = concordance_score()
    least = max(min_snps, 1) if need_data else min_snps
    rows = rows.withColumn("weight", upper_mean()).withColumn("score", score)
    rows = rows.withColumn("informative", ~((F.col("score") < min_ratio) | (F.col("nsnps") < least)))
    low = F.when(F.col("r") == 0, 1).otherwise(0)
    return rows.withColumn("kind", F.when(F.col("res") == F.col("r"), 0).when(F.col("res") == low, 1).otherwise(2))


def edge_tallies(rows: DataFrame, *keys: str) -> DataFrame:
    """edge_id (and keys): conc, disc1, disc2, nu, nqrts, over all replicates unless rep is a key."""
    told = lambda k: F.sum(F.when(F.col("informative") & (F.col("kind") == k), 1).otherwise(0)).cast("long")
    nu = F.sum(F.when(F.col("informative"), 0).otherwise(1)).cast("long")
    return rows.groupBy(*keys, "edge_id").agg(told(0).alias("conc"), told(1).alias("disc1"), told(2).alias("disc2"), nu.alias("nu"), F.count(F.lit(1)).alias("nqrts"))


def edge_means(rows: DataFrame, *keys: str) -> DataFrame:
    """edge_id (and keys): means over all mapped quartets, uninformative ones too."""
    return rows.groupBy(*keys, "edge_id").agg(F.avg("nsnps").alias("nsnps"), F.avg("weight").alias("weights"), F.avg("score").alias("scores"))


def edge_stats(tallies: DataFrame) -> DataFrame:
    """tallies with qc, qd, qi."""
    return tallies.withColumn("qc", qc()).withColumn("qd", qd()).withColumn("qi", qi())


def tip_fidelity(rows: DataFrame, *keys: str) -> DataFrame:
    """sample_idx (and keys): qfc, qfd (concordant and discordant informative quartets), qf."""
    tips = rows.where("informative").select(*keys, "kind", F.explode(F.array(*NAMES)).alias("sample_idx"))
    told = tips.groupBy(*keys, "sample_idx").agg(F.count_if(F.col("kind") == 0).alias("qfc"), F.count_if(F.col("kind") != 0).alias("qfd"))
    return told.withColumn("qf", qf())


def split_totals(edges: DataFrame) -> DataFrame:
    """edge_id, total: quartets that the edge's tip sets allow."""
    product = F.size("a").cast("long") * F.size("b") * F.size("c") * F.size("d")
    return edges.groupBy("edge_id").agg(F.sum(product).alias("total"))


def split_sampled(edges: DataFrame, quartets: DataFrame) -> DataFrame:
    """edge_id, sampled: distinct given quartets with one tip in each of the edge's four sets.

    A table of the tips' sets around each edge goes to the executors (a number for each
    tip and edge); there a quartet is one of an edge's if its four numbers differ.
    """
    rows = edges.collect()  # one row an edge; several at a polytomy
    n = 1 + max((t for r in rows for c in "abcd" for t in r[c]), default=0)
    sets = np.zeros((len(rows), n), np.uint8)
    for k, r in enumerate(rows):
        for bit, c in enumerate("abcd"):
            sets[k, r[c]] = 1 << bit
    shared = edges.sparkSession.sparkContext.broadcast((sets, np.array([r.edge_id for r in rows], np.int32)))

    def run(batches):
        sets, ids = shared.value
        for batch in batches:
            q = np.stack([batch.column(c).to_numpy() for c in NAMES], axis=1)
            q = q[(q < sets.shape[1]).all(axis=1)]
            hits = [int((np.bitwise_or.reduce(own[q], axis=1) == 15).sum()) if len(q) else 0 for own in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hits, pa.int64())], ["edge_id", "sampled"])

    counted = quartets.select(*NAMES).distinct().mapInArrow(run, "edge_id INT, sampled BIGINT").groupBy("edge_id").agg(F.sum("sampled").alias("sampled"))
    return edges.select("edge_id").distinct().join(counted, "edge_id", "left").select("edge_id", F.coalesce("sampled", F.lit(0)).alias("sampled"))


def features_added(before: list[str], after: list[str]) -> list[str]:
    """Names of a tree's features that it did not have before, in order."""
    return [x for x in dict.fromkeys(after) if x not in set(before)]


def concordance(quartets: DataFrame, tree: TreeIndex, min_snps: int = 0, min_ratio: float = 1.0, need_data: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edge statistics with means, and tip fidelity, over all replicates at once."""
    rows = mapped(quartets, tree, min_snps, min_ratio, need_data)
    return edge_stats(edge_tallies(rows)).join(edge_means(rows), "edge_id"), tip_fidelity(rows)
