"""Toxicity by FTRL-proximal logistic regression.

Features of a text are the hashes of its words, word pairs and pairs that skip one word,
each present or not, in 2**BITS slots; and, in addition to the method's n-grams and
skip-grams, of its words' first STEM bytes, as insults here come as stems with changing
ends (`stem=0` leaves them out; the README has the score without them). Training goes through a bounded sample of labelled
documents in a fixed order, `epochs` times, with a learning rate for each coordinate and
L1 sparsity; what is left is a short list of slots and weights that every executor gets.

Only rows whose crc32(doc_id as text) modulo FOLDS is not HELD_OUT teach; doc_id, lang,
source and labels are never features. The sample is bounded by `sample` documents, those
with the smallest hashes of (seed, doc_id): a parameter of the fit, nothing else is
sampled. Of rows that repeat a doc_id the one with the smallest SHA-256 of its text
teaches, so there is one row a labelled doc_id, found before anything gathers.

Defined results: null and empty texts have no features and get the score of the bias.
Labels that are null teach nothing; a doc_id labelled twice counts as toxic if one label
says so. Without labels every score is 0. Rows that repeat are scored alike. Whole texts
are read, however long. A null doc_id is never held out. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .words import gram_hashes, key_hashes, mix, word_keys

BITS, STEM, FOLDS, HELD_OUT, SAMPLE, THRESHOLD = 20, 4, 4, 2, 12_000, 0.3
ALPHA, BETA, L1, L2, EPOCHS, SEED = 0.3, 1.0, 8.0, 0.1, 4, 17
BIAS = 0


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def features(column: pa.Array, stem: int = STEM) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of all texts, and the text of each; stem 0: word n-grams and skip-grams alone."""
    a, b, at, *stems = word_keys(column, stem)
    words = key_hashes(a, b)
    doc = np.repeat(np.arange(len(column)), np.diff(at))
    n = len(words)
    pairs = gram_hashes(words, 2)
    skips = mix(words[: max(0, n - 2)] * np.uint64(0xD6E8FEB86659FD93) + words[2:] + np.uint64(3))
    same2, same3 = doc[: len(pairs)] == doc[1:], doc[: len(skips)] == doc[2:]
    hashes = np.concatenate([mix(words), pairs[same2], skips[same3], *(mix(x + np.uint64(1)) for x in stems)])
    docs = np.concatenate([doc, doc[: len(pairs)][same2], doc[: len(skips)][same3], *(doc for _ in stems)])
    slots = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return np.maximum(slots, 1), docs


class Ftrl:
    """The state of FTRL-proximal: sums z and squared gradients n of each slot."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, slots) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(np.asarray(slots) == BIAS, 0.0, self.l1), 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, slots: np.ndarray, label: float) -> None:
        """One text: slots are distinct and include BIAS."""
        w = self.weights(slots)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(np.arange(1 << BITS))
        at = np.flatnonzero(w)
        return at, w[at]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, stem: int = STEM) -> list[tuple[int, float]]:
    """Slots and weights, learned in one task from at most `sample` labelled documents."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out() & F.col("doc_id").isNotNull())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = known.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", F.xxhash64("doc_id", F.lit(SEED)).alias("h")).orderBy("h", "doc_id").limit(sample)
    # at most `sample` rows of three numbers; map sides send one row a doc_id at most
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min(F.struct(F.sha2("text", 256), "text")).alias("x"))
    rows = rows.select("doc_id", "toxic", "h", "x.text").repartition(1).sortWithinPartitions("h", "doc_id")

    def run(batches):
        model, seen = Ftrl(), []
        for piece in slices(batches):
            slots, doc = features(piece.column("text"), stem)
            order = np.argsort(doc, kind="stable")
            cuts = np.searchsorted(doc[order], np.arange(piece.num_rows + 1))
            for i, y in enumerate(piece.column("toxic").to_pylist()):
                own = np.unique(slots[order[cuts[i] : cuts[i + 1]]]).astype(np.int32)
                seen.append((np.concatenate([[BIAS], own]).astype(np.int32), float(y > 0)))
        for _ in range(epochs):
            for slots, y in seen:
                model.learn(slots, y)
        at, w = model.sparse() if seen else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["slot", "weight"])

    return [(r.slot, r.weight) for r in rows.select("text", "toxic").mapInArrow(run, "slot BIGINT, weight DOUBLE").collect()]


def scores(column: pa.Array, weights: np.ndarray, known: bool, stem: int = STEM) -> np.ndarray:
    """Scores of texts; weights: of all slots."""
    if not known:
        return np.zeros(len(column))
    slots, doc = features(column, stem)
    some = weights[slots] != 0
    pairs = np.unique(doc[some] << BITS | slots[some])
    total = np.bincount(pairs >> BITS, weights=weights[pairs & ((1 << BITS) - 1)], minlength=len(column))
    return 1 / (1 + np.exp(-np.clip(total + weights[BIAS], -35, 35)))


def _dense(model: list[tuple[int, float]]) -> np.ndarray:
    dense = np.zeros(1 << BITS)
    for slot, weight in model:
        dense[slot] = weight
    return dense


def score(docs: DataFrame, model: list[tuple[int, float]], threshold: float = THRESHOLD, stem: int = STEM) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        dense = _dense(shared.value)
        for piece in slices(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scores(piece.column("text"), dense, bool(shared.value), stem))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id BIGINT, score DOUBLE")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def civil(docs: DataFrame, model: list[tuple[int, float]], threshold: float = THRESHOLD, stem: int = STEM) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        dense = _dense(shared.value)
        for piece in slices(batches):
            yield piece.filter(pa.array(scores(piece.column("text"), dense, bool(shared.value), stem) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, stem: int = STEM) -> DataFrame:
    return score(docs, fit(docs, labels, sample, epochs, stem), stem=stem)
