"""Ranked lexical search over all documents, by block-max pruning.

The index holds ranges of documents as blocks of about BLOCK_TERMS terms (a longer text
may make a block larger, by itself). A block's forward index lists its
documents, each with its terms and how often they occur; beside it stand, for each term
of the block, the largest impact that it has in any of its documents, and the number of
these documents. Impacts hold all of the score but the term's weight, so the sum of
weight times largest impact over an item's terms bounds the score of every document of
the block.

A search computes all bounds from the largest impacts alone, orders each item's blocks by
them, and scores the forward indexes of the best blocks in growing waves. After each wave
the score of an item's k-th document is its threshold; blocks whose bound is below it are
never read for this item, and the search ends when no item has a block left. Blocks on
the threshold are scored, as ties go by doc_id. So the result is exact, with no document
left out.

Items are the queries: they go to the executors in packs of about PACK_WORDS words, so
what is broadcast has a bound (a pack holds one item at least). A block's share of a
search is one row of a few numbers per item, and nothing about documents but the best k
of an item and block leaves a task.

Terms are told apart by keys that hold up to 15 bytes as they are and by a 128-bit digest
beyond (see words). Scores are whole numbers; where a product could leave 64 bits it is
made with Python's.

Defined results: a document is a row; one without terms (null, empty) is in no result and
not counted, and rows that repeat are documents of their own. A null doc_id comes after
all others of the same score. Rows of the benchmark that repeat are queries of their own,
each with its ranks; an item without terms has no result, and a null item_id is an item
like any other. Whole texts count, however long. Extra columns are ignored. An empty
table of either kind gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, finished, shared_dir, slices, small_batches, written
from .terms import term_keys
from .words import key_hashes

K = 10
BLOCK_TERMS, BLOCK_ROWS, PACK_WORDS = 400_000, 2048, 1_000_000
#: Blocks of an item in the first wave, and how many times as many in each next one.
FIRST, GROWTH = 8, 8
INDEX = "block BIGINT, n_docs BIGINT, n_terms BIGINT, ids ARRAY<BIGINT>, sizes BINARY, first BINARY, second BINARY, at BINARY, term BINARY, tf BINARY"
TOPS = "block BIGINT, first BINARY, second BINARY, top BINARY, df BINARY"
FOUND = "q INT, doc_id BIGINT, score BIGINT"
_WIDTHS = ("<u1", "<u2", "<u4", "<u8")


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest takes, behind a byte that says how many."""
    most = int(numbers.max(initial=0))
    k = 0 if most < 1 << 8 else 1 if most < 1 << 16 else 2 if most < 1 << 32 else 3
    return bytes([k]) + numbers.astype(_WIDTHS[k]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, _WIDTHS[raw[0]], offset=1).astype(np.int64)


def distinct_terms(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ordered by their hash, and the place of each key given among them."""
    _, first, place = np.unique(key_hashes(a, b), return_index=True, return_inverse=True)
    if (a[first][place] == a).all() and (b[first][place] == b).all():
        return a[first], b[first], place
    both, place = np.unique(np.stack([a, b], axis=1), axis=0, return_inverse=True)  # two keys of one hash
    order = np.argsort(key_hashes(both[:, 0], both[:, 1]), kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return both[order, 0], both[order, 1], back[place.reshape(-1)]


class Terms:
    """A list of distinct term keys that finds its members among a block's."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.hashes = a, b, key_hashes(a, b)

    def among(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each key given in this list, -1 where it isn't in it. Equal hashes count where the keys are the same."""
        if not len(self.a):
            return np.full(len(a), -1, np.int64)
        told = key_hashes(a, b)
        lo, hi = np.searchsorted(self.hashes, told, "left"), np.searchsorted(self.hashes, told, "right")
        out = np.full(len(a), -1, np.int64)
        for step in range(int((hi - lo).max(initial=0))):  # more than one only if hashes collide
            at = np.minimum(lo + step, len(self.a) - 1)
            same = (lo + step < hi) & (self.a[at] == a) & (self.b[at] == b)
            out[same] = at[same]
        return out


def _block(number: int, ids: list, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch | None:
    some = sizes > 0
    if not some.any():
        return None
    ids, sizes = [i for i, k in zip(ids, some) if k], sizes[some]
    first, second, place = distinct_terms(a, b)
    doc = np.repeat(np.arange(len(ids)), sizes)
    cells, tf = np.unique(doc * len(first) + place, return_counts=True)
    at = np.searchsorted(cells, np.arange(len(ids) + 1) * len(first))
    values = [number, len(ids), int(sizes.sum()), ids, packed(sizes), first.tobytes(), second.tobytes(), packed(at), packed(cells % len(first)), packed(tf)]
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in INDEX.split(", ")])


def forward(docs: DataFrame, block_terms: int = BLOCK_TERMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The forward index: a row for each block, numbered by its task and its place there."""

    def run(batches):
        from pyspark import TaskContext

        number, held, terms, rows = TaskContext.get().partitionId() << 32, [], 0, 0

        def block():
            return _block(number, [i for x in held for i in x[0]], *(np.concatenate([x[k] for x in held]) for k in (1, 2, 3)))

        for piece in slices(batches, nbytes=min(1 << 20, 8 * block_terms)):
            a, b, at = term_keys(piece.column("text"))
            held.append((piece.column("doc_id").to_pylist(), a, b, np.diff(at)))
            terms, rows = terms + len(a), rows + piece.num_rows
            if terms >= block_terms or rows >= block_rows:
                made = block()
                held, terms, rows = [], 0, 0
                if made is not None:
                    yield made
                    number += 1
        if held and (made := block()) is not None:
            yield made

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


def shares(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents of so many terms, among n documents of `total` terms."""
    if int(sizes.max(initial=0)) * n * 90 < 1 << 62:
        return 10 + sizes * (90 * n) // total
    return np.array([10 + 90 * x * n // total for x in sizes.tolist()], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The part of the score that a term adds for each unit of its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["first"], np.uint64), np.frombuffer(row["second"], np.uint64)


def largest(index: DataFrame, n: int, total: int) -> DataFrame:
    """For each block its terms' largest impacts and how many of its documents hold them."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                term, tf, at, sizes = (unpacked(r[c]) for c in ("term", "tf", "at", "sizes"))
                many = len(r["first"]) // 8
                told = impacts(tf, np.repeat(shares(sizes, n, total), np.diff(at)))
                top = np.zeros(many, np.int64)
                np.maximum.at(top, term, told)
                values = [r["block"], r["first"], r["second"], packed(top), packed(np.bincount(term, minlength=many))]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, [pa.int64(), *[pa.binary()] * 4])], ["block", "first", "second", "top", "df"])

    return index.select("block", "sizes", "first", "second", "at", "term", "tf").mapInArrow(run, TOPS)


class SearchIndex:
    """The index of a collection below a folder that all executors share; building it once serves any number of searches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.index = spark.read.schema(INDEX).parquet(f"{path}/index")
        self.tops = spark.read.schema(TOPS).parquet(f"{path}/tops")
        told = self.index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        self.n, self.total = told[0] or 0, told[1] or 0

    @classmethod
    def build(cls, docs: DataFrame, path: str, block_terms: int = BLOCK_TERMS, block_rows: int = BLOCK_ROWS) -> "SearchIndex":
        small_batches(docs.sparkSession)
        index = written(forward(docs, block_terms, block_rows), path, "index")
        told = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        written(largest(index, told[0] or 0, told[1] or 1), path, "tops")
        return cls(docs.sparkSession, path)

    def search(self, items: DataFrame, root: str, k: int = K, pack_words: int = PACK_WORDS) -> DataFrame:
        """item_id, rank, doc_id, score of each item's k best documents. root: a shared folder for what is written on the way."""
        found = None
        for p, pack in enumerate(packs(items, pack_words)):
            part = self._search(pack, f"{root}/pack_{p}", k)
            found = part if found is None else found.unionByName(part)
        return found if found is not None else self.spark.createDataFrame([], "item_id BIGINT, rank INT, doc_id BIGINT, score BIGINT")

    def _search(self, pack: "Pack", root: str, k: int) -> DataFrame:
        pack.weigh(self._frequencies(pack), self.n)
        shared = self.spark.sparkContext.broadcast(pack)
        bounds = written(self._bounds(shared), root, "bounds")
        places = bounds.select("block", F.posexplode("bounds").alias("q", "bound")).where("bound > 0")
        order = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
        state = self.spark.createDataFrame([(q, 1, None, None) for q in range(len(pack.sizes))], "q INT, least BIGINT, past BIGINT, past_block BIGINT")
        best, many, wave = None, FIRST, 0
        while True:
            ahead = places.join(F.broadcast(state), "q")
            ahead = ahead.where("bound >= least AND (past IS NULL OR bound < past OR bound = past AND block > past_block)").select("q", "block", "bound")
            chosen = written(ahead.withColumn("place", F.row_number().over(order)).where(F.col("place") <= many), root, f"chosen_{wave}")
            ends = chosen.groupBy("q").agg(F.max_by(F.struct("bound", "block"), "place").alias("end")).select("q", "end.*").collect()  # a row an item of the pack
            if not ends:
                break
            hits = self._scored(chosen, shared, k)
            ranks = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            every = hits if best is None else best.drop("rank").unionByName(hits)
            best = written(every.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k), root, f"best_{wave}")
            kth = {r.q: r.score for r in best.where(F.col("rank") == k).select("q", "score").collect()}  # a row an item of the pack
            state = self.spark.createDataFrame([(r.q, kth.get(r.q, 1), r.bound, r.block) for r in ends], "q INT, least BIGINT, past BIGINT, past_block BIGINT")
            many, wave = many * GROWTH, wave + 1
        names = self.spark.createDataFrame(pack.names, "q INT, item_id BIGINT, copies BIGINT")
        if best is None:
            best = self.spark.createDataFrame([], FOUND + ", rank INT")
        named = best.join(F.broadcast(names), "q").withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
        return named.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

    def _frequencies(self, pack: "Pack") -> np.ndarray:
        """How many documents hold each of the pack's terms."""
        shared = self.spark.sparkContext.broadcast(pack)

        def run(batches):
            terms = shared.value.terms
            held = np.zeros(len(terms.a), np.int64)
            for batch in batches:
                for r in batch.to_pylist():
                    place = terms.among(*_keys(r))
                    held[place[place >= 0]] += unpacked(r["df"])[place >= 0]
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["t", "df"])

        out = np.zeros(len(pack.terms.a), np.int64)
        counted = self.tops.select("first", "second", "df").mapInArrow(run, "t INT, df BIGINT").groupBy("t").agg(F.sum("df").alias("df"))
        for r in counted.collect():  # a row a term of the pack
            out[r.t] = r.df
        return out

    def _bounds(self, shared) -> DataFrame:
        """block, bounds (one for each item of the pack)."""

        def run(batches):
            pack = shared.value
            for batch in batches:
                for r in batch.to_pylist():
                    place = pack.terms.among(*_keys(r))
                    most = np.zeros(len(pack.terms.a), np.int64)
                    most[place[place >= 0]] = unpacked(r["top"])[place >= 0]
                    bounds = np.add.reduceat(np.append((pack.weights * most)[pack.members], 0), pack.at[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([bounds], pa.list_(pa.int64()))], ["block", "bounds"])

        return self.tops.select("block", "first", "second", "top").mapInArrow(run, "block BIGINT, bounds ARRAY<BIGINT>")

    def _scored(self, chosen: DataFrame, shared, k: int) -> DataFrame:
        """q, doc_id, score: the k best documents of each chosen item and block."""
        n, total = self.n, self.total

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    yield from _best(r, shared.value, n, total, k)

        asked = chosen.groupBy("block").agg(F.collect_list("q").alias("asked"))  # at most the pack's items
        return self.index.join(asked, "block").select("ids", "sizes", "first", "second", "at", "term", "tf", "asked").mapInArrow(run, FOUND)


def _best(row: dict, pack: "Pack", n: int, total: int, k: int):
    place = pack.terms.among(*_keys(row))
    term, tf, at = (unpacked(row[c]) for c in ("term", "tf", "at"))
    found = place[term]
    some = found >= 0
    doc = np.repeat(np.arange(len(row["ids"])), np.diff(at))[some]
    found = found[some]
    told = pack.weights[found] * impacts(tf[some], shares(unpacked(row["sizes"]), n, total)[doc])
    ids = np.array([_LAST if i is None else i for i in row["ids"]], np.int64)
    empty = np.array([i is None for i in row["ids"]])
    mine = np.zeros(len(pack.weights), bool)
    for q in sorted(row["asked"]):
        own = pack.members[pack.at[q] : pack.at[q + 1]]
        mine[own] = True
        hit = mine[found]
        mine[own] = False
        scores = np.zeros(len(ids), np.int64)
        np.add.at(scores, doc[hit], told[hit])
        good = np.flatnonzero(scores)
        order = good[np.lexsort((ids[good], empty[good], -scores[good]))][:k]
        columns = [pa.array(np.full(len(order), q, np.int32)), pa.array(ids[order], mask=empty[order]), pa.array(scores[order])]
        yield pa.RecordBatch.from_arrays(columns, ["q", "doc_id", "score"])


_LAST = np.iinfo(np.int64).max


class Pack:
    """Some items as lists of distinct terms; members[at[q]:at[q + 1]] are the terms of item q."""

    def __init__(self, rows: list[tuple[int | None, str, int]]):
        a, b, at = term_keys(pa.array([r[1] for r in rows], pa.string()))
        first, second, place = distinct_terms(a, b)
        self.terms = Terms(first, second)
        own = [np.unique(place[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
        some = [q for q, x in enumerate(own) if len(x)]
        self.sizes = [len(own[q]) for q in some]
        self.members = np.concatenate([np.zeros(0, np.int64), *[own[q] for q in some]])
        self.at = np.cumsum([0, *self.sizes])
        self.names = [(i, rows[q][0], rows[q][2]) for i, q in enumerate(some)]
        self.weights = np.zeros(len(first), np.int64)

    def weigh(self, df: np.ndarray, n: int) -> None:
        self.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)


def packs(items: DataFrame, pack_words: int):
    """The items in packs, one after the other; equal rows are one item with a count."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("text IS NOT NULL").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    words = rows.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    n = max(1, -(-words // pack_words))
    for p in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == p)
        pack = Pack([(r.item_id, r.text, r.copies) for r in part.collect()])  # about pack_words words
        if pack.sizes:
            yield pack


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, block_rows: int = BLOCK_ROWS, pack_words: int = PACK_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, over a fresh index of docs."""
    root = shared_dir(docs.sparkSession)
    index = SearchIndex.build(docs, root, block_terms, block_rows)
    return finished(index.search(items, root, k), root)
