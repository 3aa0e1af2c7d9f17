"""Consensus trees and split supports over replicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import Node, edge_order, parse_newick, splits, tree_of_splits

CUT = 0.5


def canonical_sides(sides: DataFrame, tips: DataFrame) -> DataFrame:
    """tree_id, side: the sorted side without the smallest tip. sides: tree_id, side (either one); tips: tip."""
    every = tips.agg(F.array_sort(F.collect_set("tip")).alias("every"))  # one row of all tips
    rows = sides.crossJoin(F.broadcast(every))
    side = F.when(F.array_contains("side", F.element_at("every", 1)), F.array_except("every", "side")).otherwise(F.col("side"))
    return rows.select("tree_id", F.array_sort(side).alias("side")).distinct()


def split_frequencies(sides: DataFrame, n_trees: int) -> DataFrame:
    """side, n, freq of canonical splits over n_trees trees."""
    return sides.groupBy("side").agg(F.countDistinct("tree_id").alias("n")).withColumn("freq", F.col("n") / F.lit(float(n_trees)))


def split_support(given: DataFrame, frequencies: DataFrame) -> DataFrame:
    """edge_id, side, support of a given tree's splits (edge_id, side)."""
    rows = given.join(frequencies, "side", "left")
    return rows.select("edge_id", "side", F.coalesce("freq", F.lit(0.0)).alias("support"))


def _compatible(a: frozenset, b: frozenset, every: frozenset) -> bool:
    return not (a & b and a - b and b - a and every - a - b)


def consensus_tree(frequencies: list[tuple[tuple, float]], tips, cut: float = CUT) -> Node:
    """The tree of splits with a frequency of at least cut, the most frequent first, each if it fits those before.

    A tree has few splits for its tips, so they are a small list on the driver.
    """
    every, taken = frozenset(tips), []
    for side, freq in sorted(frequencies, key=lambda x: (-x[1], len(x[0]), x[0])):
        s = frozenset(side)
        if freq >= cut and 1 < len(s) < len(every) - 1 and all(_compatible(s, t, every) for t, _ in taken):
            taken.append((s, freq))
    root = tree_of_splits([t for t, _ in taken], tips)
    supports = {frozenset(map(str, t)): f for t, f in taken}
    for node in root.nodes():
        if node.children and frozenset(node.tips()) in supports:
            node.features["support"] = round(supports[frozenset(node.tips())], 6)
    return root


def with_support(newick: str, frequencies: DataFrame, spark: SparkSession) -> Node:
    """A given tree with each inner edge's frequency among the replicates."""
    root = parse_newick(newick)
    own = splits(root)
    order = edge_order(own)
    given = spark.createDataFrame([(i, list(s)) for i, s in enumerate(order)], "edge_id INT, side ARRAY<INT>")
    for row in split_support(given, frequencies).collect():
        own[order[row.edge_id]].features["support"] = round(row.support, 6)
    return root
