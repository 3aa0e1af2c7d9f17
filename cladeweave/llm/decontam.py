"""Benchmark decontamination by greedy string tiling.

Word windows of MIN_MATCH words that a document shares with a benchmark item are the
seeds, joined by running (Karp-Rabin) hashes. For an item the longest match of unmarked
words is marked in both, again and again, until none of MIN_MATCH words is left: the
tiles (ties by the earliest place in the item, then in the document). A document is
contaminated when its tiles cover `coverage` of an item's words. Tiles may stand anywhere,
so a reordered passage is caught too.

Matches are never listed: what text and item both repeat would give each pair of places
one. Instead the length of the longest match left is found by bisection, as a match holds
one of every smaller length; the windows of this length that both sides have unmarked are
grouped by their running hash, and each of an item's windows takes the earliest one in the
document that is still free. A step is linear in the words of both sides, and an item of n
words takes at most sqrt(2 n) steps, as their lengths fall and together mark its words.

Items are tiled in the order of what their seeds could cover at most, until none can do
better: an item that can't cover more than the best one so far isn't tiled, unless it
could cover as much and has a smaller item_id.

Words are runs of non-blanks with A-Z lower-cased. Hashes only find windows: what a tile
covers are words whose keys (see words) are the same. The benchmark goes to the executors
in blocks of about BLOCK_WORDS words, one pass over the documents each, so what is
broadcast has a bound: equal rows of the benchmark are one item, and a block holds more
words only if a single item does or few hashes fall unevenly.

Defined results: every row gets the item covered best, contaminated or not, and null
where no item covers anything; of items covered alike the smallest item_id, a null one
last. An item without item_id counts like any other: a document that it contaminates has
item_id null and contaminated true. Rows that repeat an item_id are items of their own. A
null or empty text, and one under MIN_MATCH words, has coverage 0 and no item. Items under
MIN_MATCH words, null or empty items have no seeds and match nothing; an empty benchmark
matches nothing. Whole texts are read and tiled, however long. Repeated rows are judged
alike, each on its own. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, slices, small_batches
from .words import gram_hashes, key_hashes, word_keys

MIN_MATCH, COVERAGE, BLOCK_WORDS = 5, 0.6, 4_000_000
JUDGED = "doc_id BIGINT, tag BIGINT, item_id BIGINT, coverage DOUBLE"
_BITS = 22


#: Base of the running hash.
_BASE = 0x9E3779B97F4A7C15


class Side:
    """A text's words (keys a, b) with marks: which may still be covered."""

    def __init__(self, a: np.ndarray, b: np.ndarray, free: np.ndarray):
        self.a, self.b, self.free = a, b, free.copy()
        # hash of the first k words; that of a window is a difference
        self.sums = np.zeros(len(a) + 1, np.uint64)
        power = np.full(len(a), _BASE, np.uint64)
        if len(a):
            power[0] = 1
            power = np.cumprod(power)
        np.cumsum(key_hashes(a, b) * power, out=self.sums[1:])
        self.power = power

    def spans(self) -> np.ndarray:
        """How many unmarked words follow each place, itself included."""
        edges = np.flatnonzero(np.diff(self.free, prepend=False, append=False))
        out = np.zeros(len(self.free), np.int64)
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            out[lo:hi] = np.arange(hi - lo, 0, -1)
        return out

    def windows(self, spans: np.ndarray, size: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of unmarked windows of so many words, and their hashes, brought to the power of place `last`."""
        at = np.flatnonzero(spans >= size)
        up = np.array(_powers(last - at), np.uint64) if len(at) else np.zeros(0, np.uint64)
        return at, (self.sums[at + size] - self.sums[at]) * up


_TABLE = np.ones(1, np.uint64)


def _powers(k: np.ndarray) -> np.ndarray:
    """_BASE to the power k, modulo 2 ** 64."""
    global _TABLE
    most = int(k.max(initial=0)) + 1
    if most > len(_TABLE):
        grown = np.full(max(most, 2 * len(_TABLE)), _BASE, np.uint64)
        grown[0] = 1
        _TABLE = np.cumprod(grown)
    return _TABLE[k]


def _paired(one: Side, two: Side, size: int, at: tuple, hashes: tuple) -> list[tuple[int, int]]:
    """Tiles of this size: each window of one, in order, with the earliest free equal window of two."""
    shared = np.intersect1d(*hashes)
    mine, theirs = (np.isin(h, shared) for h in hashes)
    places: dict[int, list[int]] = {}
    for h, j in zip(hashes[1][theirs].tolist(), at[1][theirs].tolist()):
        places.setdefault(h, []).append(j)
    ahead = dict.fromkeys(places, 0)
    found, after = [], -1
    for h, i in zip(hashes[0][mine].tolist(), at[0][mine].tolist()):
        if i < after:
            continue
        own, k = places[h], ahead[h]
        while k < len(own) and not two.free[own[k] : own[k] + size].all():
            k += 1
        ahead[h] = k
        # equal hashes of other words, which all but never are: look on behind them
        while k < len(own) and not ((one.a[i : i + size] == two.a[own[k] : own[k] + size]).all() and (one.b[i : i + size] == two.b[own[k] : own[k] + size]).all() and two.free[own[k] : own[k] + size].all()):
            k += 1
        if k < len(own):
            found.append((i, own[k]))
            two.free[own[k] : own[k] + size] = False
            after = i + size
    for i, _ in found:
        one.free[i : i + size] = False
    return found


def tiles(one: Side, two: Side, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two texts: tiles (i, j, length), the longest first; ties by the earliest i, then j. Nothing is marked twice."""
    found, cap = [], None
    while True:
        spans = one.spans(), two.spans()
        most = min(int(x.max(initial=0)) for x in spans)
        most = most if cap is None else min(most, cap)
        last = max(len(one.a), len(two.a))
        held: dict[int, tuple] = {}

        def common(size: int) -> bool:
            both = [side.windows(x, size, last) for side, x in zip((one, two), spans)]
            held[size] = tuple(zip(*both))
            return bool(np.isin(both[0][1], both[1][1]).any())

        if most < width or not common(width):
            return found
        size, above = width, most + 1
        step = width
        while size + step < above:  # matches are short mostly: go up before halving
            if not common(size + step):
                above = size + step
                break
            size, step = size + step, 2 * step
        while above - size > 1:
            middle = (size + above) // 2
            size, above = (middle, above) if common(middle) else (size, middle)
        now = _paired(one, two, size, *held[size])
        found += [(i, j, size) for i, j in now]
        cap = size if now else size - 1


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All k of lo <= k < hi, range by range, and the range of each."""
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(lo)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which], which


class Items:
    """One block of the benchmark: its words, and its windows ordered by their hashes."""

    def __init__(self, rows: list[tuple[int | None, str]], width: int):
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
        self.width, self.ids = width, [r[0] for r in rows]
        self.a, self.b, self.at = word_keys(pa.array([r[1] for r in rows], pa.string()))
        words, self.sizes = key_hashes(self.a, self.b), np.diff(self.at)
        grams = gram_hashes(words, width)
        item = np.repeat(np.arange(len(rows)), self.sizes)[: len(grams)]
        here = np.arange(len(grams))
        inside = here[here + width <= self.at[1:][item]] if len(grams) else here
        order = inside[np.argsort(grams[inside], kind="stable")]
        self.grams, self.item, self.pos = grams[order], item[order], order
        self.maybe = np.zeros(1 << _BITS, dtype=bool)
        self.maybe[self.grams >> np.uint64(64 - _BITS)] = True

    def best(self, a: np.ndarray, b: np.ndarray, hits: np.ndarray, grams: np.ndarray) -> tuple[int | None, float]:
        """The item covered best by a document of word keys a, b, from its windows `hits` (positions) with hashes `grams`."""
        told, group = np.unique(grams, return_inverse=True)
        lo, hi = np.searchsorted(self.grams, told, "left"), np.searchsorted(self.grams, told, "right")
        k, which = _ranges(lo, hi)  # the benchmark's windows that the document has, and the group of each
        order = np.argsort(self.pos[k], kind="stable")
        pos, which = self.pos[k][order], which[order]
        share = self._most(pos) / np.maximum(self.sizes, 1)
        starts = np.searchsorted(pos, self.at)  # each item's windows
        found, number = (None, 0.0), len(self.ids)
        for x in np.lexsort((np.arange(len(share)), -share)).tolist():
            if share[x] == 0 or share[x] < found[1] or share[x] == found[1] and x > number:
                break  # the rest are as good at best, and of larger ids
            own = slice(starts[x], starts[x + 1])
            asked = np.zeros(len(told), bool)
            asked[which[own]] = True
            at = self.at[x]
            covered = self._covered(x, pos[own] - at, a, b, hits[asked[group]]) / self.sizes[x]
            if covered > found[1] or covered == found[1] > 0 and x < number:
                found, number = (self.ids[x], float(covered)), x
        return found

    def _covered(self, x: int, i: np.ndarray, a: np.ndarray, b: np.ndarray, j: np.ndarray) -> int:
        """Words of item x that tiles from a document cover; i and j: where its and the document's seeds stand."""
        lo, hi = self.at[x], self.at[x + 1]
        one = Side(self.a[lo:hi], self.b[lo:hi], _reached(i, int(hi - lo), self.width))
        # of the document only the words of seeds matter; a blocked word stands for what is between them
        inside = np.flatnonzero(_reached(j, len(a), self.width))
        gap = np.flatnonzero(np.diff(inside) > 1) + 1
        free = np.ones(len(inside) + len(gap), bool)
        free[gap + np.arange(len(gap))] = False
        kept = np.zeros(len(free), np.int64)
        kept[free] = inside
        return sum(n for _, _, n in tiles(one, Side(a[kept], b[kept], free), self.width))

    def _most(self, pos: np.ndarray) -> np.ndarray:
        """How many words of each item windows at pos (sorted) cover together."""
        item = np.searchsorted(self.at, pos, "right") - 1
        gap = np.full(len(pos), self.width)
        same = item[1:] == item[:-1]
        gap[:-1][same] = np.minimum(self.width, np.diff(pos)[same])
        return np.bincount(item, gap, len(self.ids))


def _reached(at: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n words stand in a window of `width` words that starts at one of the places."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def judged(piece: pa.RecordBatch, block: Items) -> tuple[list, list]:
    """For each text of a batch the item covered best and its coverage."""
    width = block.width
    ids, covers = [None] * piece.num_rows, [0.0] * piece.num_rows
    a, b, at = word_keys(piece.column("text"))
    words = key_hashes(a, b)
    grams = gram_hashes(words, width)
    hits = np.flatnonzero(block.maybe[grams >> np.uint64(64 - _BITS)])
    if not len(block.grams) or not len(hits):
        return ids, covers
    near = np.minimum(np.searchsorted(block.grams, grams[hits]), len(block.grams) - 1)
    hits = hits[block.grams[near] == grams[hits]]
    doc = np.searchsorted(at, hits, "right") - 1
    inside = hits + width <= at[doc + 1]
    hits, doc = hits[inside], doc[inside]
    cuts = np.flatnonzero(np.diff(doc, prepend=-1)).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(doc)]):
        d = int(doc[lo])
        own = hits[lo:hi]
        ids[d], covers[d] = block.best(a[at[d] : at[d + 1]], b[at[d] : at[d + 1]], own - at[d], grams[own])
    return ids, covers


def blocks(benchmark: DataFrame, width: int, block_words: int):
    """The benchmark's blocks one after the other, each broadcast."""
    spark = benchmark.sparkSession
    small_batches(spark)
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    words = bench.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    n = max(1, -(-words // block_words))
    for b in range(n):
        part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield spark.sparkContext.broadcast(Items([(r.item_id, r.text) for r in part.collect()], width))


def _judge_block(docs: DataFrame, shared) -> DataFrame:
    def run(batches):
        for piece in slices(batches):
            ids, covers = judged(piece, shared.value)
            columns = [piece.column("doc_id"), piece.column("tag"), pa.array(ids, pa.int64()), pa.array(covers, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "item_id", "coverage"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text")).mapInArrow(run, JUDGED)


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, width: int = MIN_MATCH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id (the item covered best), coverage, contaminated for every row."""
    parts = [_judge_block(docs, shared) for shared in blocks(benchmark, width, block_words)]
    rows = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            rows = rows.unionByName(part)
        best = F.max_by(F.struct("item_id", "coverage"), F.struct(F.col("coverage"), (-F.col("item_id")).alias("i"))).alias("best")
        rows = rows.groupBy("doc_id", "tag").agg(best, (F.count(F.lit(1)) / len(parts)).cast("int").alias("n"))
        rows = rows.select("doc_id", "best.item_id", "best.coverage", F.explode(F.array_repeat(F.lit(0), F.col("n"))))
    return rows.select("doc_id", "item_id", "coverage", (F.col("coverage") >= coverage).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, width: int = MIN_MATCH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""

    def keep(shared):
        def run(batches):
            for piece in slices(batches):
                _, covers = judged(piece, shared.value)
                yield piece.filter(pa.array(np.asarray(covers) < coverage))

        return run

    for shared in blocks(benchmark, width, block_words):
        docs = docs.mapInArrow(keep(shared), docs.schema)
    return docs
