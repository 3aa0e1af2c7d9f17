"""Where quartets fall on a fixed tree, by lowest common ancestors.

The tree's Euler tour and a sparse table of its depths give the lowest common ancestor of
any two tips by two looks. Of a quartet's three pairings the tree shows the one whose two
pairs have the deepest ancestors together; by how much it leads is the number of edges on
the path between the pairs. One edge, and the quartet is that edge's own; several, and it
spans them; none, and the tree doesn't resolve it (a polytomy).

The index holds a few numbers for each node and goes to every executor; quartets are
mapped in batches as they stream by, so nothing grows with the fourth power of the tips
and no join is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .quartets import NAMES
from .trees import Node, canonical, edge_order, splits

#: The pairs of a quartet's places, and the pairings: resolution r pairs PAIRS[r] and PAIRS[5 - r].
PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def _unrooted(root: Node) -> Node:
    """The tree with a root of three or more neighbours where there is one, so that a root on an edge doesn't count as a node."""
    while len(root.children) == 2:
        inner = next((c for c in root.children if c.children), None)
        if inner is None:
            return root
        other = root.children[1] if root.children[0] is inner else root.children[0]
        root = Node(children=[*inner.children, other])
    return root


class TreeIndex:
    """Depths, edges and ancestors of a tree whose tips are sample indices."""

    def __init__(self, root: Node):
        sides = {side: i for i, side in enumerate(edge_order(splits(root)))}
        root = _unrooted(root)
        every = [int(t) for t in root.tips()]
        nodes, number, depth, parent = [], {}, [], []
        stack = [(root, 0, -1)]
        while stack:
            node, level, above = stack.pop()
            number[id(node)] = len(nodes)
            nodes.append(node)
            depth.append(level)
            parent.append(above)
            stack += [(c, level + 1, number[id(node)]) for c in reversed(node.children)]
        self.depth = np.array(depth, np.int64)
        # below each node: its split, so its edge
        below: list[list[int]] = [[] for _ in nodes]
        for k in range(len(nodes) - 1, -1, -1):
            if not nodes[k].children:
                below[k] = [int(nodes[k].name)]
            if parent[k] >= 0:
                below[parent[k]] += below[k]
        self.edge = np.array([sides.get(canonical(b, every), -1) if p >= 0 else -1 for b, p in zip(below, parent)], np.int32)
        tour, first = [], np.full(len(nodes), -1, np.int64)
        walk: list = [(0, iter([number[id(c)] for c in nodes[0].children]))]
        first[0] = 0
        tour.append(0)
        while walk:
            k, rest = walk[-1]
            child = next(rest, None)
            if child is None:
                walk.pop()
                if walk:
                    tour.append(walk[-1][0])
            else:
                first[child] = len(tour)
                tour.append(child)
                walk.append((child, iter([number[id(c)] for c in nodes[child].children])))
        # a place of the tour as depth and node in one number: the least of a stretch is its ancestor
        level = self.depth[tour] * len(nodes) + np.array(tour, np.int64)
        self.nodes, self.table = len(nodes), [level]
        while 2 << (len(self.table) - 1) <= len(tour):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))
        self.place = np.full(1 + max(every, default=0), -1, np.int64)
        for k, node in enumerate(nodes):
            if not node.children:
                self.place[int(node.name)] = first[k]

    def ancestors(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lowest common ancestors of tips x and y."""
        lo, hi = np.minimum(self.place[x], self.place[y]), np.maximum(self.place[x], self.place[y])
        k = np.frexp(hi - lo + 1)[1] - 1  # the largest power of 2 that fits
        out = np.empty(len(lo), np.int64)
        for step in np.unique(k).tolist():
            own = k == step
            out[own] = np.minimum(self.table[step][lo[own]], self.table[step][hi[own] - (1 << step) + 1])
        return out % self.nodes

    def locate(self, quartets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row i0..i3 (-1s where a tip isn't in the tree): resolution r, edges spanned, and the edge where it is one."""
        q = quartets.astype(np.int64)
        known = ((q >= 0) & (q < len(self.place))).all(axis=1)
        known[known] &= (self.place[q[known]] >= 0).all(axis=1)
        r, span, edge = np.full(len(q), -1, np.int32), np.zeros(len(q), np.int32), np.full(len(q), -1, np.int32)
        q = q[known]
        if not len(q):
            return r, span, edge
        meet = [self.ancestors(q[:, i], q[:, j]) for i, j in PAIRS]
        deep = np.stack([self.depth[meet[k]] + self.depth[meet[5 - k]] for k in range(3)])
        best = deep.argmax(axis=0)
        lead = deep.max(axis=0) - np.sort(deep, axis=0)[1]
        # the two nodes where the pairs meet the path: of three tips' ancestors the deepest
        three = lambda *pairs: np.stack([meet[p] for p in pairs])[np.stack([self.depth[meet[p]] for p in pairs]).argmax(axis=0), np.arange(len(q))]
        of = {frozenset(p): k for k, p in enumerate(PAIRS)}
        median = {m: three(*[of[frozenset(x)] for x in ((m[0], m[1]), (m[0], m[2]), (m[1], m[2]))]) for m in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))}
        one = np.choose(best, [median[0, 1, 2], median[0, 1, 2], median[0, 1, 3]])
        two = np.choose(best, [median[0, 2, 3], median[0, 1, 3], median[0, 1, 2]])
        low = np.where(self.depth[one] > self.depth[two], one, two)
        solved = lead > 0
        r[known] = np.where(solved, best, -1)
        span[known] = lead
        edge[known] = np.where(lead == 1, self.edge[low], -1)
        return r, span, edge


def located(quartets: DataFrame, index: TreeIndex) -> DataFrame:
    """quartets with r (the tree's resolution), span (edges between its pairs) and edge_id (null unless span is 1); quartets that the tree doesn't resolve or whose tips it lacks have span 0 and no r."""
    shared = quartets.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            q = np.stack([batch.column(c).to_numpy() for c in NAMES], axis=1)
            r, span, edge = shared.value.locate(q)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r, mask=r < 0), pa.array(span), pa.array(edge, mask=edge < 0)], [*batch.schema.names, "r", "span", "edge_id"])

    kind = StructType([*quartets.schema.fields, StructField("r", IntegerType()), StructField("span", IntegerType()), StructField("edge_id", IntegerType())])
    return quartets.mapInArrow(run, kind)


def tree_resolution(quartets: DataFrame, index: TreeIndex) -> DataFrame:
    """The quartets that are one edge's own, with r and edge_id."""
    return located(quartets, index).where(F.col("edge_id").isNotNull()).drop("span")
