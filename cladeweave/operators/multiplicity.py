"""Pattern counts of many bootstrap replicates in one pass, by multiplicities of loci.

A replicate over all sites is a weight for each locus: how often it is drawn. So a block
finds a quartet's pattern at each site once, and each replicate's counts are sums of its
weights by pattern; the matrix is neither resampled nor written anew. Only sites
where one of the four samples has an ambiguity code are looked at for each replicate: its
coin is that of (seed, replicate, sample, site), so a locus that a replicate draws twice
counts twice as it was resolved there.

The weights of a block's loci travel to it by a join on the locus. What leaves a block is
a row of 256 counts for each quartet and replicate; these are added up by rank as usual.
One site a locus can't be counted so: each draw orders its sites anew (see bootstrap).
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import AMBIGUOUS, GAP, MISSING as NO_BASE, A, C, G, T
from ..session import shared_table
from .bootstrap import draws
from .packed import _CELLS, _EQUAL, CELLS, MISSING, TILE, Ranks, _added, _tiled, blocks, cell_column, rank_rows, unranked_rows

_CODES = {A: 0, C: 1, G: 2, T: 3}
#: Codes of a block: 0 to 3, MISSING, and from here on the ambiguity codes, in the order of AMBIGUOUS.
AMBIGUITY = 5
_HEADS = np.array([_CODES[x] for x, _ in AMBIGUOUS.values()], np.uint8)
_TAILS = np.array([_CODES[x] for _, x in AMBIGUOUS.values()], np.uint8)


def coins(seed: int, rep: int, samples: np.ndarray, sites: np.ndarray) -> np.ndarray:
    """The coin of each cell in a replicate: that of functions.chance.coin, here for the few cells that need one."""
    return np.array([md5(f"{seed}:{rep}:{i}:{s}".encode()).digest()[3] & 1 for i, s in zip(samples.tolist(), sites.tolist())], bool)


def ambiguous_codes(snps: DataFrame) -> DataFrame:
    """snps with code: 0 to 3, or from AMBIGUITY on a two-base code that is still to resolve; null where missing."""
    known = {**_CODES, **{code: AMBIGUITY + k for k, code in enumerate(AMBIGUOUS)}}
    base = F.when(F.col("base") == GAP, F.lit(NO_BASE)).otherwise(F.col("base"))
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return snps.withColumn("code", F.element_at(table, base)).drop("base")


class Weighted:
    """A block with the weights of its loci in each of some replicates."""

    def __init__(self, codes: np.ndarray, loci: np.ndarray, sites: np.ndarray, reps: np.ndarray, drawn: np.ndarray, seed: int):
        """drawn: rows of replicate, locus and how often the one draws the other."""
        self.codes, self.reps = codes, reps
        names, locus = np.unique(loci, return_inverse=True)
        weights = np.zeros((len(reps), len(names)))
        own = drawn[np.isin(drawn[:, 0], reps)]
        weights[np.searchsorted(reps, own[:, 0]), np.searchsorted(names, own[:, 1])] = own[:, 2]
        self.weights = weights[:, locus]
        # the cells with an ambiguity code, resolved for each replicate
        i, s = np.nonzero(codes >= AMBIGUITY)
        heads, tails = _HEADS[codes[i, s] - AMBIGUITY], _TAILS[codes[i, s] - AMBIGUITY]
        self.drawn = np.empty((len(reps), len(i)), np.uint8)
        for r, rep in enumerate(reps.tolist()):
            self.drawn[r] = np.where(coins(seed, rep, i, sites[s]), heads, tails)
        self.first = np.searchsorted(i, np.arange(len(codes) + 1))
        self.site = s

    def _row(self, i: int) -> np.ndarray:
        return self.codes[i] if i < len(self.codes) else np.full(self.codes.shape[1], MISSING, np.uint8)

    def _resolved(self, i: int, at: np.ndarray) -> np.ndarray:
        """A sample's codes at sites `at` in each replicate."""
        out = np.broadcast_to(self._row(i)[at], (len(self.reps), len(at))).copy()
        if i < len(self.codes):
            lo, hi = self.first[i], self.first[i + 1]
            where = np.searchsorted(at, self.site[lo:hi])  # all of them are among `at`
            out[:, where] = self.drawn[:, lo:hi]
        return out

    def counts(self, four: list[int]) -> np.ndarray:
        """256 counts for each replicate; weights are whole numbers, which sums of doubles keep."""
        rows = [self._row(i) for i in four]
        odd = np.maximum.reduce(rows) >= AMBIGUITY
        some = odd.any()
        a, b, c, d = (x[~odd] if some else x for x in rows)
        cell = a.astype(np.int64) * 125 + b.astype(np.int64) * 25 + c * np.int64(5) + d
        total = np.empty((len(self.reps), CELLS))
        for r, own in enumerate(self.weights):
            total[r] = np.bincount(cell, own[~odd] if some else own, CELLS)
        if some:
            at = np.flatnonzero(odd)
            a, b, c, d = (self._resolved(i, at).astype(np.int64) for i in four)
            every = np.arange(len(self.reps))[:, None] * CELLS + a * 125 + b * 25 + c * 5 + d
            total += np.bincount(every.reshape(-1), self.weights[:, at].reshape(-1), total.size).reshape(total.shape)
        out = total[:, _CELLS].astype(np.int64)
        out[:, _EQUAL] = 0
        return out


def multiplicities(snps: DataFrame, reps: list[int], seed: int) -> DataFrame:
    """rep, locus, m: how often each of the replicates draws a locus, for those that it draws."""
    drawn = draws(snps, max(reps), seed).where(F.col("rep").isin(reps))
    return drawn.groupBy("rep", "locus").agg(F.count(F.lit(1)).alias("m"))


def _numbers(column: pa.Array, i: int) -> np.ndarray:
    """A row's list of numbers; none where it is null."""
    return column[i].values.to_numpy() if column[i].is_valid else np.zeros(0, np.int64)


def replicate_counts(snps: DataFrame, quartets: DataFrame | Ranks, n: int, reps: int | list[int], seed: int, empty: bool = False) -> DataFrame:
    """rep, rank, cells (256 counts) over all sites of replicates 1..reps, or of those listed.

    quartets: Ranks or distinct rows for all replicates, or rows with rep, each replicate's
    own. empty: with the quartets that have no site, as rows of zeros.
    """
    spark = snps.sparkSession
    reps = list(range(1, reps + 1)) if isinstance(reps, int) else sorted(reps)
    own = not isinstance(quartets, Ranks) and "rep" in quartets.columns
    if not isinstance(quartets, Ranks):
        quartets = rank_rows(spark, quartets, n, ["rep"] if own else [])
    held = shared_table(blocks(ambiguous_codes(snps), n), "blocks")
    several = held.count()
    if not several and empty:
        rows = rank_rows(spark, quartets, n, ["rep"] if own else [])
        every = rows if own else rows.withColumn("rep", F.explode(F.array(*[F.lit(r).cast("long") for r in reps])))
        return every.select("rep", "rank", F.lit(bytes(2048)).alias("cells"))

    def loci(batches):
        for batch in batches:
            for row in batch.to_pylist():
                told = np.unique(np.frombuffer(row["loci"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(told), row["block"])), pa.array(told)], ["block", "locus"])

    here = held.select("block", "loci").mapInArrow(loci, "block BIGINT, locus BIGINT")
    weights = here.join(multiplicities(snps, reps, seed), "locus").groupBy("block").agg(F.collect_list(F.struct("rep", "locus", "m")).alias("w"))
    weights = weights.select("block", *[F.col(f"w.{c}").alias(f"w_{c}") for c in ("rep", "locus", "m")])
    rows = _tiled(held.join(weights, "block", "left"), quartets, [])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("n", "packed", "loci", "sites", "lo", "hi")}
                drawn = np.stack([_numbers(batch.column(f"w_{c}"), i) for c in ("rep", "locus", "m")], axis=1)
                chosen = np.array([batch.column("rep")[i].as_py()] if own else reps, np.int64)
                codes = np.frombuffer(row["packed"], np.uint8).reshape(row["n"], -1)
                block = Weighted(codes, np.frombuffer(row["loci"], np.int64), np.frombuffer(row["sites"], np.int64), chosen, drawn, seed)
                listed = _numbers(batch.column("ranks"), i) if batch.column("ranks")[i].is_valid else None
                lo, hi = (row["lo"], row["hi"]) if listed is None else (0, len(listed))
                step = max(1, TILE // len(chosen))
                for at in range(lo, hi, step):
                    ranks = np.arange(at, min(at + step, hi)) if listed is None else listed[at : at + step]
                    counts = np.stack([block.counts(four) for four in unranked_rows(ranks, n).tolist()]).reshape(-1, 256)
                    some = counts.any(axis=1) | empty
                    both = [np.tile(chosen, len(ranks))[some], np.repeat(ranks, len(chosen))[some]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, both), cell_column(counts[some])], ["rep", "rank", "cells"])

    found = rows.mapInArrow(run, "rep BIGINT, rank BIGINT, cells BINARY")
    return _added(found, ["rep"]) if several > 1 else found
