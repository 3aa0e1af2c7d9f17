"""Trees: newick text, nodes as rows, splits and the four tip sets around each edge."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Node:
    name: str = ""
    dist: float | None = None
    children: list["Node"] = field(default_factory=list)
    features: dict = field(default_factory=dict)

    def tips(self) -> list[str]:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.children:
                stack.extend(reversed(node.children))
            else:
                out.append(node.name)
        return out

    def nodes(self) -> list["Node"]:
        """Parents first."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            out.append(node)
            stack.extend(reversed(node.children))
        return out


_TOKEN = re.compile(r"\s*(\[[^\]]*\]|'(?:[^']|'')*'|[(),:;]|[^\s(),:;\[\]']+)")


def parse_newick(text: str) -> Node:
    """The root of a newick tree. Bracketed comments are skipped, names may be quoted."""
    root = Node()
    stack, node, at, dist = [], root, 0, False
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not newick at {at}: {text[at : at + 20]!r}")
        at, token = m.end(), m[1]
        if token == "(":
            child = Node()
            node.children.append(child)
            stack.append(node)
            node = child
        elif token == ",":
            child = Node()
            stack[-1].children.append(child)
            node = child
        elif token == ")":
            node = stack.pop()
        elif token == ":":
            dist = True
            continue
        elif token == ";":
            break
        elif token[0] == "[":
            continue
        elif dist:
            node.dist = float(token)
        else:
            node.name = token[1:-1].replace("''", "'") if token[0] == "'" else token
        dist = False
    if stack:
        raise ValueError("a bracket isn't closed")
    return root


def _quoted(name: str) -> str:
    return "'" + name.replace("'", "''") + "'" if re.search(r"[\s(),:;\[\]']", name) else name


def write_newick(root: Node, features: bool = False) -> str:
    """Newick text; with features as [&name=value,...] behind each node that has some."""

    def one(node: Node) -> str:
        inner = "(" + ",".join(map(one, node.children)) + ")" if node.children else ""
        text = inner + _quoted(node.name)
        if node.dist is not None:
            text += f":{node.dist:g}"
        if features and node.features:
            text += "[&" + ",".join(f"{k}={v}" for k, v in node.features.items()) + "]"
        return text

    return one(root) + ";"


def relabel(root: Node, names: dict) -> Node:
    """Tip names through a dict; a tip without an entry raises."""
    for node in root.nodes():
        if not node.children:
            node.name = str(names[node.name])
    return root


def canonical(side, every) -> tuple:
    """A split as the sorted side without the smallest tip."""
    side, every = frozenset(side), frozenset(every)
    return tuple(sorted(side if min(every) not in side else every - side))


def splits(root: Node, key=int) -> dict[tuple, Node]:
    """Canonical splits of the tree's internal edges, with the node below each."""
    every = [key(t) for t in root.tips()]
    found: dict[tuple, Node] = {}
    for node in root.nodes():
        if node is root or not node.children:
            continue
        side = canonical(map(key, node.tips()), every)
        if 1 < len(side) < len(every) - 1:
            found.setdefault(side, node)
    return found


def edge_order(found) -> list[tuple]:
    """Edges by size of their canonical side, then by its tips: the place is the edge's id."""
    return sorted(found, key=lambda s: (len(s), s))


def quadripartitions(root: Node, key=int) -> list[tuple[int, tuple]]:
    """(edge id, four tip sets a, b | c, d) around each internal edge; at a polytomy every pair of groups on each side."""
    every = frozenset(key(t) for t in root.tips())
    sides = edge_order(splits(root, key))
    clusters = {frozenset(s) for s in sides} | {every - frozenset(s) for s in sides} | {frozenset([t]) for t in every} | {every - frozenset([t]) for t in every}
    out = []
    for i, side in enumerate(sides):
        groups = []
        for half in (frozenset(side), every - frozenset(side)):
            inside = sorted((c for c in clusters if c < half), key=len, reverse=True)
            top: list[frozenset] = []
            for c in inside:
                if not any(c <= t for t in top):
                    top.append(c)
            groups.append(sorted((tuple(sorted(t)) for t in top)))
        for x, a in enumerate(groups[0]):
            for b in groups[0][x + 1 :]:
                for y, c in enumerate(groups[1]):
                    for d in groups[1][y + 1 :]:
                        out.append((i, (a, b, c, d)))
    return out


def edge_sets(spark: SparkSession, root: Node) -> DataFrame:
    """edge_id, a, b, c, d (arrays of sample indices): one row for each quadripartition."""
    rows = [(i, *[list(g) for g in four]) for i, four in quadripartitions(root)]
    kinds = "edge_id INT, a ARRAY<INT>, b ARRAY<INT>, c ARRAY<INT>, d ARRAY<INT>"
    return spark.createDataFrame(rows, kinds)


def split_rows(spark: SparkSession, trees: list[str], key=int) -> DataFrame:
    """tree_id, edge_id, side (canonical) of each internal edge of each tree."""
    rows = []
    for t, text in enumerate(trees):
        rows += [(t, i, list(side)) for i, side in enumerate(edge_order(splits(parse_newick(text), key)))]
    return spark.createDataFrame(rows, "tree_id INT, edge_id INT, side ARRAY<INT>")


def node_rows(spark: SparkSession, root: Node) -> DataFrame:
    """node_id, parent_id, name, dist in order from the root."""
    order = root.nodes()
    place = {id(n): i for i, n in enumerate(order)}
    parent = {id(c): i for i, n in enumerate(order) for c in n.children}
    rows = [(place[id(n)], parent.get(id(n)), n.name or None, n.dist) for n in order]
    return spark.createDataFrame(rows, "node_id INT, parent_id INT, name STRING, dist DOUBLE")


def tree_of_splits(sides, every) -> Node:
    """The tree that has exactly these compatible splits, rooted at the smallest tip's side."""
    every = sorted(every)
    clusters = sorted({frozenset(s) for s in sides}, key=lambda s: (len(s), sorted(s)))
    tops: dict[frozenset, Node] = {frozenset([t]): Node(name=str(t)) for t in every}
    for cluster in clusters:
        inside = sorted((c for c in tops if c <= cluster), key=sorted)
        tops[cluster] = Node(children=[tops.pop(c) for c in inside])
    return Node(children=[tops[c] for c in sorted(tops, key=sorted)])


def rooted(root: Node, outgroup: str) -> Node:
    """The tree rooted on the edge of an outgroup: a tip name, or ~ and a regular expression for several.

    Raises where no tip fits or the fitting tips aren't one side of an edge.
    """
    pattern = re.compile(outgroup[1:] if outgroup.startswith("~") else "^" + re.escape(outgroup) + "$")
    every = root.tips()
    out = frozenset(t for t in every if pattern.search(t))
    if not out or len(out) == len(every):
        raise ValueError(f"no outgroup fits {outgroup!r}")
    sides = [s for s in splits(root, str)]
    other = frozenset(every) - out
    known = {frozenset(s) for s in sides} | {frozenset(every) - frozenset(s) for s in sides}
    if len(out) > 1 and len(other) > 1 and out not in known:
        raise ValueError(f"the outgroup {sorted(out)} isn't one side of an edge")

    def clade(tips: frozenset) -> Node:
        if len(tips) == 1:
            return Node(name=next(iter(tips)))
        inside = sorted((c for c in known if c < tips), key=lambda c: (-len(c), sorted(c)))
        top: list[frozenset] = []
        for c in inside:
            if not any(c <= t for t in top):
                top.append(c)
        top += [frozenset([t]) for t in tips if not any(t in c for c in top)]
        return Node(children=[clade(c) for c in sorted(top, key=sorted)])

    return Node(children=[clade(other), clade(out)])


def sort_quartet(a, b, c, d) -> tuple:
    """Sorted quartet and the resolution index of ab|cd in it."""
    q = sorted((a, b, c, d))
    mate = {a: b, b: a, c: d, d: c}[q[0]]
    return (*q, q.index(mate) - 1)
