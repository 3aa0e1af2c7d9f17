"""Supertrees improved by local search on the quartets' own gains.

Around an inner edge lie four groups of tips, AB|CD. Trading two of them across the edge
gives AC|BD or AD|BC and changes what the tree says only of the quartets with one tip in
each group: those that the tree's index finds to be the edge's own. So one pass over the
quartets, summed by edge and resolution, holds the exact gain of every such trade of
every replicate's tree. The trades that gain most are made, of edges that share a node
only one, and the pass is made again until none gains. The weight of quartets that a tree
satisfies only grows, so the search ends.

What a pass brings to the driver is three numbers for each edge of each tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quartets import NAMES
from .treeindex import TreeIndex
from .trees import Node, canonical, edge_order, parse_newick, quadripartitions, splits, tree_of_splits, write_newick

#: A trade must gain so much of an edge's weight, so that sums in another order trade alike.
LEAST_GAIN = 1e-9


#: No group: at a polytomy there is nothing to trade.
NONE = 4


class Groups:
    """A tree's index, and for each of its edges the four groups of tips around it."""

    def __init__(self, root: Node):
        self.index, self.every = TreeIndex(root), [int(t) for t in root.tips()]
        self.sides, around = edge_order(splits(root)), {}
        for edge, four in quadripartitions(root):
            around.setdefault(edge, []).append(four)
        self.around = {edge: fours[0] for edge, fours in around.items() if len(fours) == 1}
        self.group = np.full((len(self.sides), 1 + max(self.every, default=0)), NONE, np.uint8)
        for edge, four in self.around.items():
            for k, tips in enumerate(four):
                self.group[edge, list(tips)] = k

    def kinds(self, q: np.ndarray, res: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each quartet the edge that it is the own of (-1: none) and which group its resolution joins to the first: 0 as the tree has it, 1 or 2 across the edge."""
        _, _, edge = self.index.locate(q)
        own = np.flatnonzero(edge >= 0)
        held = self.group[edge[own][:, None], q[own]]
        whole = (held < NONE).all(axis=1)
        edge[own[~whole]] = -1
        own, held = own[whole], held[whole]
        first = held.argmin(axis=1)
        mate = res[own] + 1  # of place 0; the other two places belong together
        other = np.where(first == 0, mate, np.where(first == mate, 0, 6 - mate - first))
        kind = np.full(len(q), -1, np.int64)
        kind[own] = held[np.arange(len(own)), other].astype(np.int64) - 1
        return edge, kind


def edge_weights(quartets: DataFrame, trees: dict[int, Groups]) -> DataFrame:
    """rep, edge_id, kind, weight of the quartets that are one edge's own: kind 0 as the tree has them, 1 and 2 as it would after either trade. quartets: rep, i0..i3, res, weight."""
    shared = quartets.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            rep, res, weight = (batch.column(c).to_numpy() for c in ("rep", "res", "weight"))
            q = np.stack([batch.column(c).to_numpy() for c in NAMES], axis=1)
            for one in np.unique(rep).tolist():
                own = np.flatnonzero(rep == one)
                if one not in shared.value:
                    continue
                edge, kind = shared.value[one].kinds(q[own], res[own])
                own, edge, kind = own[edge >= 0], edge[edge >= 0], kind[edge >= 0]
                told, place = np.unique(edge.astype(np.int64) * 3 + kind, return_inverse=True)
                sums = np.bincount(place, weight[own], len(told))
                columns = [np.full(len(told), one, np.int64), (told // 3).astype(np.int32), (told % 3).astype(np.int32), sums]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rep", "edge_id", "kind", "weight"])

    rows = quartets.select(F.col("rep").cast("long").alias("rep"), *NAMES, F.col("res").cast("int").alias("res"), F.col("weight").cast("double").alias("weight"))
    return rows.mapInArrow(run, "rep BIGINT, edge_id INT, kind INT, weight DOUBLE").groupBy("rep", "edge_id", "kind").agg(F.sum("weight").alias("weight"))


def traded(tree: Groups, weights: dict[tuple[int, int], float]) -> Node | None:
    """The tree after the trades that gain, none of two that share a node; None where none gains. weights: by edge and kind."""
    gains = []
    for edge in tree.around:
        held = [weights.get((edge, k), 0.0) for k in range(3)]
        k = 1 if held[1] >= held[2] else 2
        if held[k] - held[0] > LEAST_GAIN * max(1.0, sum(held)):
            gains.append((-round(held[k] - held[0], 9), edge, k))
    taken, blocked = {}, set()
    for _, edge, k in sorted(gains):
        if edge in blocked:
            continue
        taken[edge] = k
        near = {canonical(group, tree.every) for group in tree.around[edge]}
        blocked |= {i for i, side in enumerate(tree.sides) if side in near}
    if not taken:
        return None
    new = [side for i, side in enumerate(tree.sides) if i not in taken]
    new += [canonical([*tree.around[edge][0], *tree.around[edge][k + 1]], tree.every) for edge, k in taken.items()]
    return tree_of_splits(new, tree.every)


def satisfied(quartets: DataFrame, newicks: dict[int, str]) -> dict[int, float]:
    """The weight of quartets that each replicate's tree shows, those that span several edges too."""
    shared = quartets.sparkSession.sparkContext.broadcast({rep: TreeIndex(parse_newick(t)) for rep, t in newicks.items()})

    def run(batches):
        for batch in batches:
            rep, res, weight = (batch.column(c).to_numpy() for c in ("rep", "res", "weight"))
            q = np.stack([batch.column(c).to_numpy() for c in NAMES], axis=1)
            sums = {one: float(weight[rep == one][shared.value[one].locate(q[rep == one])[0] == res[rep == one]].sum()) for one in np.unique(rep).tolist() if one in shared.value}
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.float64())], ["rep", "weight"])

    rows = quartets.select(F.col("rep").cast("long").alias("rep"), *NAMES, F.col("res").cast("int").alias("res"), F.col("weight").cast("double").alias("weight"))
    return {r.rep: r.weight for r in rows.mapInArrow(run, "rep BIGINT, weight DOUBLE").groupBy("rep").agg(F.sum("weight").alias("weight")).collect()}


def refined(quartets: DataFrame, newicks: dict[int, str]) -> dict[int, str]:
    """Each replicate's tree after trades until none gains. quartets: rep, i0..i3, res, weight; tips are sample indices."""
    roots = {rep: parse_newick(text) for rep, text in newicks.items()}
    open_ = dict(roots)
    while open_:
        trees = {rep: Groups(root) for rep, root in open_.items()}
        held: dict[int, dict] = {}
        for r in edge_weights(quartets.where(F.col("rep").isin(*open_)), trees).collect():  # three numbers an edge
            held.setdefault(r.rep, {})[r.edge_id, r.kind] = r.weight
        moved = {rep: traded(tree, held.get(rep, {})) for rep, tree in trees.items()}
        open_ = {rep: root for rep, root in moved.items() if root is not None}
        roots |= open_
    return {rep: write_newick(root) for rep, root in roots.items()}
