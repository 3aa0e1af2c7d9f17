"""Supertrees from weighted quartets by recursive cuts.

Each problem is a set of labels and the quartets on four of them. A cut is sought that
splits many quartets ab|cd as they say and few otherwise: exactly for few labels, else
from spectral starts of the pair matrix (cross pairs of a quartet count for a cut, its
own pairs against, at several rates) improved by single moves in fixed order. Each side
goes on with one label for the other; quartets cut two and two are done. A cut is a
split of all tips, and the splits found make the tree.

A problem of at most LOCAL_ROWS distinct quartets is solved in one task. Larger ones are
cut as Spark plans: pair sums are aggregated, one task finds a problem's cuts in its pair
matrix (labels squared), tasks weigh all of these on the quartets, and a join with the two
label maps deals the quartets to the halves, until all are small. Both ways try the same
cuts and compare their values rounded, so a tree doesn't depend on the way. Trees may
differ from other programs' on noisy data; on quartets of one tree without noise that
tree comes back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoints
from .trees import canonical, parse_newick, relabel, tree_of_splits, write_newick

#: The first of AGAINST that leaves a cut of positive value is used: with the last, chance level is 0.
RATES, EXACT, AGAINST = (0.25, 0.5, 1.0, 2.0, 4.0), 9, (2.0, 1.0, 0.5)
LOCAL_ROWS = 2_000_000


def _value(sides: np.ndarray, q: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weight split as quartets say, and weight split otherwise."""
    s = sides[q]
    two = s.sum(axis=1) == 2
    good = two & (s[:, 0] == s[:, 1])
    return float(w[good].sum()), float(w[two & ~good].sum())


def _improved(sides: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Single moves that raise the cut's weight in matrix m, best first, both sides keeping two labels."""
    sides = sides.copy()
    for _ in range(4 * len(sides)):
        sign = np.where(sides, 1.0, -1.0)
        gain = sign * (m @ sign)
        if sides.sum() <= 2:
            gain[sides] = -np.inf
        if (~sides).sum() <= 2:
            gain[~sides] = -np.inf
        k = int(gain.argmax())
        if gain[k] <= 1e-12:
            break
        sides[k] = not sides[k]
    return sides


def _spectral_cuts(good: np.ndarray, bad: np.ndarray) -> list[np.ndarray]:
    """Cuts from the pair matrices: cross pairs' weights and own pairs' weights."""
    n, cuts = len(good), []
    for rate in RATES:
        m = good - rate * bad * 2
        _, vectors = np.linalg.eigh(m)
        for v in vectors[:, :3].T:
            order = np.argsort(v, kind="stable")
            for start in (v > 0, np.isin(np.arange(n), order[: n // 2])):
                if 2 <= start.sum() <= n - 2:
                    cuts.append(_improved(start, m))
    return cuts


def _chosen(cuts: list, values: list[tuple[float, float]]):
    """The cut of the most value, the first by its labels of equal ones; None where none has any. Sums in another order give the same."""
    if not cuts:
        return None
    scale = max(good + bad for good, bad in values) or 1.0
    order = sorted(range(len(cuts)), key=lambda i: (cuts[i] ^ cuts[i][0]).tolist())
    for against in AGAINST:
        worth = [round((values[i][0] - against * values[i][1]) / scale, 9) for i in order]
        if max(worth) > 0:
            return cuts[order[int(np.argmax(worth))]]
    return None


def _cuts(n: int, good: np.ndarray, bad: np.ndarray) -> list[np.ndarray]:
    """The cuts to try of n labels, each once: all for few labels, else spectral ones from the pair matrices, which are rounded first."""
    if n <= EXACT:
        masks = [((np.arange(n) > 0) & ((m << 1 >> np.arange(n)) & 1).astype(bool)) for m in range(1, 1 << (n - 1))]
        return [c for c in masks if 2 <= c.sum() <= n - 2]
    scale = max(good.max(), bad.max()) or 1.0
    found = _spectral_cuts(np.round(good / scale, 9), np.round(bad / scale, 9))
    return list({(c ^ c[0]).tobytes(): c for c in found}.values())


def best_cut(n: int, q: np.ndarray, w: np.ndarray) -> np.ndarray | None:
    """Which of labels 0..n-1 stand on one side; None where no cut gains."""
    good, bad = np.zeros((n, n)), np.zeros((n, n))
    if n > EXACT:
        for x, y in ((0, 2), (0, 3), (1, 2), (1, 3)):
            np.add.at(good, (q[:, x], q[:, y]), w)
        for x, y in ((0, 1), (2, 3)):
            np.add.at(bad, (q[:, x], q[:, y]), w)
    cuts = _cuts(n, good + good.T, bad + bad.T)
    return _chosen(cuts, [_value(c, q, w) for c in cuts])


def max_cut_splits(q: np.ndarray, w: np.ndarray, tips: list[int]) -> list[tuple]:
    """Canonical splits of the tree of quartets q (rows a, b, c, d for ab|cd) with weights w."""
    found = []
    place = {t: i for i, t in enumerate(tips)}
    todo = [([frozenset([t]) for t in tips], np.vectorize(place.__getitem__, otypes=[np.int64])(q) if len(q) else q, w)]
    while todo:
        labels, q, w = todo.pop()
        n = len(labels)
        if n < 4 or not len(q):
            continue
        cut = best_cut(n, q, w)
        if cut is None:
            continue
        for half in (cut, ~cut):
            own = np.flatnonzero(half)
            rest = frozenset().union(*(labels[i] for i in np.flatnonzero(~half)))
            number = np.full(n, len(own))
            number[own] = np.arange(len(own))
            new = number[q]
            outside = (new == len(own)).sum(axis=1)
            keep = outside <= 1
            merged = new[keep]
            if len(merged):
                pairs = np.sort(merged.reshape(-1, 2, 2), axis=2)
                swap = (pairs[:, 0, 0] > pairs[:, 1, 0])[:, None, None]
                merged = np.where(swap, pairs[:, ::-1], pairs).reshape(-1, 4)
                merged, back = np.unique(merged, axis=0, return_inverse=True)
                weight = np.bincount(back.reshape(-1), w[keep])
            else:
                weight = w[:0]
            todo.append(([labels[i] for i in own] + [rest], merged, weight))
        found.append(canonical(frozenset().union(*(labels[i] for i in np.flatnonzero(cut))), tips))
    return sorted(set(found), key=lambda s: (len(s), s))


def _halves(cut: np.ndarray, labels: list[frozenset]) -> list[tuple[list[int], list[frozenset]]]:
    """For each side its map from old to new labels and its labels; what is across is one label more."""
    out = []
    for half in (cut, ~cut):
        own = np.flatnonzero(half)
        new = np.full(len(labels), len(own))
        new[own] = np.arange(len(own))
        out.append((new.tolist(), [labels[i] for i in own] + [frozenset().union(*(labels[i] for i in np.flatnonzero(~half)))]))
    return out


def _merged(state: DataFrame) -> DataFrame:
    """Equal resolved quartets of a problem added up."""
    first, second = F.array_sort(F.array("a", "b")), F.array_sort(F.array("c", "d"))
    pairs = state.select("rep", "prob", F.array_sort(F.array(first, second)).alias("p"), "weight")
    rows = pairs.groupBy("rep", "prob", "p").agg(F.sum("weight").alias("weight"))
    return rows.select("rep", "prob", *[F.col("p")[i // 2][i % 2].cast("int").alias("abcd"[i]) for i in range(4)], "weight")


def _candidates(large: DataFrame, labels: dict) -> DataFrame:
    """rep, prob, cuts: the cuts to try of each problem, from its summed pairs. labels: of each problem."""
    cross = [("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")]
    pair = lambda x, y, good: F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), F.lit(good).alias("good"))
    pairs = F.array(*[pair(x, y, 1.0) for x, y in cross], pair("a", "b", 0.0), pair("c", "d", 0.0))
    sums = large.select("rep", "prob", "weight", F.explode(pairs).alias("p"))
    sums = sums.groupBy("rep", "prob", F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.sum(F.col("weight") * F.col("p.good")).alias("good"), F.sum(F.col("weight") * (1 - F.col("p.good"))).alias("bad"))
    sizes = {k: len(v) for k, v in labels.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, prob = int(pdf["rep"].iloc[0]), int(pdf["prob"].iloc[0])
        n = sizes[rep, prob]
        good, bad = np.zeros((n, n)), np.zeros((n, n))
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        good[x, y] = good[y, x] = pdf["good"]
        bad[x, y] = bad[y, x] = pdf["bad"]
        return pd.DataFrame({"rep": [rep], "prob": [prob], "cuts": [[c.tolist() for c in _cuts(n, good, bad)]]})

    return sums.groupBy("rep", "prob").applyInPandas(run, "rep BIGINT, prob BIGINT, cuts ARRAY<ARRAY<BOOLEAN>>")


def _weighed(large: DataFrame, cuts: dict) -> dict:
    """For each problem both weights of each of its cuts over all its quartets. cuts: of each problem, some labels long each."""
    shared = large.sparkSession.sparkContext.broadcast(cuts)

    def run(batches):
        for batch in batches:
            rep, prob = batch.column("rep").to_numpy(), batch.column("prob").to_numpy()
            q = np.stack([batch.column(c).to_numpy() for c in "abcd"], axis=1)
            w, out = batch.column("weight").to_numpy(), []
            for key in sorted(set(zip(rep.tolist(), prob.tolist()))):
                own = (rep == key[0]) & (prob == key[1])
                out += [(*key, k, *_value(c, q[own], w[own])) for k, c in enumerate(shared.value[key])]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.float64()] * 2)], ["rep", "prob", "k", "good", "bad"])

    rows = large.select("rep", "prob", *"abcd", "weight").mapInArrow(run, "rep BIGINT, prob BIGINT, k BIGINT, good DOUBLE, bad DOUBLE")
    found: dict = {key: [(0.0, 0.0)] * len(own) for key, own in cuts.items()}
    for r in rows.groupBy("rep", "prob", "k").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect():
        found[r.rep, r.prob][r.k] = (r.good, r.bad)
    return found


def supertrees(splits: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """rep, newick (tips are sample indices) of each replicate's weighted splits.

    The driver holds labels and cuts of the problems, which are samples, and no quartets.
    """
    spark = splits.sparkSession
    checkpoints(spark)
    rows = splits if "rep" in splits.columns else splits.withColumn("rep", F.lit(0))
    state = _merged(rows.select(F.col("rep").cast("long").alias("rep"), F.lit(0).cast("long").alias("prob"), "a", "b", "c", "d", "weight"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b", "c", "d"])
        q, w = pdf[["a", "b", "c", "d"]].to_numpy(np.int64), pdf["weight"].to_numpy(float)
        sides = max_cut_splits(q, w, np.unique(q).tolist())
        return pd.DataFrame({"rep": [pdf["rep"].iloc[0]], "prob": [pdf["prob"].iloc[0]], "labels": [np.unique(q).tolist()], "sides": [[list(map(int, s)) for s in sides]]})

    kind = "rep BIGINT, prob BIGINT, labels ARRAY<INT>, sides ARRAY<ARRAY<INT>>"
    found: dict[int, list[tuple]] = {}
    tips: dict[int, list[int]] = {}
    labels: dict[tuple[int, int], list[frozenset]] = {}
    number = 0
    while True:
        sizes = {(r.rep, r.prob): r["count"] for r in state.groupBy("rep", "prob").count().collect()}
        large = [k for k, v in sizes.items() if v > local_rows]
        marks = spark.createDataFrame([(*k, k in large) for k in sizes], "rep BIGINT, prob BIGINT, large BOOLEAN")
        marked = state.join(F.broadcast(marks), ["rep", "prob"])
        for r in marked.where(~F.col("large")).drop("large").groupBy("rep", "prob").applyInPandas(solve, kind).collect():
            own = labels.get((r.rep, r.prob))
            if own is None:
                own = {t: frozenset([t]) for t in r.labels}
                tips[r.rep] = list(r.labels)
            every = tips[r.rep]
            found.setdefault(r.rep, []).extend(canonical(frozenset().union(*(own[i] for i in side)), every) for side in r.sides)
        if not large:
            break
        big = marked.where("large").drop("large")
        whole = big.where("prob = 0")
        for r in whole.select("rep", F.explode(F.array("a", "b", "c", "d")).alias("t")).groupBy("rep").agg(F.array_sort(F.collect_set("t")).alias("tips")).collect():
            tips[r.rep] = list(r.tips)
            labels[r.rep, 0] = [frozenset([t]) for t in r.tips]
        # labels of a whole problem are its tips, numbered
        places = [(rep, {t: i for i, t in enumerate(tips[rep])}) for rep, prob in large if prob == 0]
        if places:
            map_ = spark.createDataFrame([(rep, list(own.items())) for rep, own in places], "rep BIGINT, own ARRAY<STRUCT<t INT, i INT>>").select("rep", F.map_from_entries("own").alias("own"))
            numbers = whole.join(F.broadcast(map_), "rep").select("rep", "prob", *[F.element_at("own", F.col(x)).alias(x) for x in "abcd"], "weight")
            big = numbers.unionByName(big.where("prob <> 0"))
        cuts = {(r.rep, r.prob): [np.array(c) for c in r.cuts] for r in _candidates(big, {k: labels[k] for k in large}).collect()}
        weighed = _weighed(big, cuts)
        maps = []
        for key in sorted(cuts):
            rep, prob = key
            own = labels[key]
            cut = _chosen(cuts[key], weighed[key])
            if cut is None:
                continue
            side = frozenset().union(*(own[i] for i in np.flatnonzero(cut)))
            found.setdefault(rep, []).append(canonical(side, tips[rep]))
            for new, names in _halves(cut, own):
                number += 1
                labels[rep, number] = names
                maps.append((rep, prob, number, new, len(names) - 1))
        if not maps:
            break
        dealt = big.join(F.broadcast(spark.createDataFrame(maps, "rep BIGINT, prob BIGINT, next BIGINT, new ARRAY<INT>, rest INT")), ["rep", "prob"])
        moved = dealt.select("rep", F.col("next").alias("prob"), *[F.get("new", F.col(x)).alias(x) for x in "abcd"], "weight", "rest")
        outside = sum((F.when(F.col(x) == F.col("rest"), 1).otherwise(0) for x in "abcd"), F.lit(0))
        state = _merged(moved.where(outside <= 1)).checkpoint()
    trees = []
    for rep, every in sorted(tips.items()):
        sides = {s for s in found.get(rep, []) if 1 < len(s) < len(every) - 1}
        trees.append((rep, write_newick(tree_of_splits(sorted(sides, key=lambda s: (len(s), s)), every))))
    return spark.createDataFrame(trees, "rep BIGINT, newick STRING")


def named(newick: str, names: dict[int, str]) -> str:
    """The tree with sample names for indices; joined by index, so samples that were filtered out don't shift others."""
    return write_newick(relabel(parse_newick(newick), {str(k): v for k, v in names.items()}))
