"""Scores of the three resolutions of a quartet from the singular values of its flattenings.

The rank is the least of the three matrices' numerical ranks, at most MOST_RANK; a
resolution's score is the norm of the singular values from that rank on. Numpy does it
for batches of quartets. A quartet without sites gets NO_DATA three times and a random
resolution by hash.

Two ways lead to counts: by blocks of the matrix that each see the quartets (packed), or
dense, where the whole matrix is small enough to go to every executor, with only quartets
as rows.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import Matrix, Ranks, blocks, cells_of, rank_rows, unranked_rows
from .quartets import NAMES

MOST_RANK, NO_DATA, TINY = 10, 0.001, 1e-9
SCORED = "i0 INT, i1 INT, i2 INT, i3 INT, s0 DOUBLE, s1 DOUBLE, s2 DOUBLE, res INT, nsnps BIGINT"
#: Cells (samples x sites, a byte each) of a matrix that goes to every executor at most.
DENSE_CELLS = 256 << 20


def singular_values(cells: np.ndarray) -> np.ndarray:
    """16 for each of the three flattenings of each row of 256 counts."""
    m = cells.reshape(-1, 4, 4, 4, 4).astype(np.float64)
    stacked = np.stack([m, m.transpose(0, 1, 3, 2, 4), m.transpose(0, 1, 4, 2, 3)], axis=1).reshape(-1, 3, 16, 16)
    return np.linalg.svd(stacked, compute_uv=False)


def values_beyond(cells: np.ndarray, most_rank: int = MOST_RANK) -> np.ndarray:
    """The three flattenings' singular values from the rank on, before it 0, for each row of 256 counts."""
    values = singular_values(cells)
    ranks = (values > values[..., :1] * 16 * np.finfo(np.float64).eps).sum(axis=-1).min(axis=1)
    ranks = np.minimum(ranks, most_rank)
    return np.where(np.arange(16) >= ranks[:, None, None], values, 0.0)


def norms(beyond: np.ndarray) -> np.ndarray:
    """Three scores for each row of values_beyond()."""
    found = np.sqrt((beyond**2).sum(axis=-1))
    return np.where(found < TINY, 0.0, found)


def scores(cells: np.ndarray, most_rank: int = MOST_RANK) -> np.ndarray:
    """Three scores for each row of 256 counts."""
    return norms(values_beyond(cells, most_rank))


def random_resolution(seed: int, rep: int, quartet) -> int:
    """The hash choice of a quartet without data."""
    key = ":".join(map(str, (seed, rep, *quartet)))
    return int(md5(key.encode()).hexdigest()[:8], 16) % 3


def resolve(quartets: np.ndarray, cells: np.ndarray, reps: np.ndarray, seed: int, most_rank: int = MOST_RANK) -> list[np.ndarray]:
    """s0, s1, s2, res, nsnps of quartets (k x 4) with counts (k x 256)."""
    return resolved_values(quartets, cells, reps, seed, most_rank)[0]


def resolved_values(quartets: np.ndarray, cells: np.ndarray, reps: np.ndarray, seed: int, most_rank: int = MOST_RANK) -> tuple[list[np.ndarray], np.ndarray]:
    """As resolve(), and the singular values (k x 3 x 16) whose norms the scores are."""
    nsnps = cells.sum(axis=1)
    s, beyond = np.full((len(cells), 3), NO_DATA), np.zeros((len(cells), 3, 16))
    res = np.zeros(len(cells), np.int32)
    some = nsnps > 0
    if some.any():
        beyond[some] = values_beyond(cells[some], most_rank)
        s[some] = norms(beyond[some])
        res[some] = s[some].argmin(axis=1)
    for i in np.flatnonzero(~some):
        res[i] = random_resolution(seed, int(reps[i]), quartets[i].tolist())
    return [*np.round(s, 6).T, res, nsnps.astype(np.int64)], beyond


def _batch(names, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def score_counts(dense: DataFrame, seed: int, most_rank: int = MOST_RANK, values: bool = False) -> DataFrame:
    """(rep,) i0..i3, s0..s2, res, nsnps from counts.dense_rows(). values: with v0..v2, the singular values whose norms the scores are (0 before the rank)."""
    keys = ["rep"] if "rep" in dense.columns else []
    more = ["v0", "v1", "v2"] if values else []

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                q = np.stack([part.column(n).to_numpy() for n in NAMES], axis=1)
                lists = part.column("cells")
                cells = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 256)
                reps = part.column("rep").to_numpy() if keys else np.zeros(len(q), np.int64)
                out, beyond = resolved_values(q, cells, reps, seed, most_rank)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(beyond[:, f].reshape(-1)), 16).cast(pa.list_(pa.float64())) for f in range(len(more))]
                yield _batch([*keys, *NAMES, "s0", "s1", "s2", "res", "nsnps", *more], [*([reps] if keys else []), *q.T, *out, *lists])

    return dense.mapInArrow(run, ("rep BIGINT, " if keys else "") + SCORED + "".join(f", {c} ARRAY<DOUBLE>" for c in more))


def score_cells(dense: DataFrame, n: int, seed: int, most_rank: int = MOST_RANK) -> DataFrame:
    """(rep,) i0..i3, s0..s2, res, nsnps from packed.cell_counts(); quartets without sites get NO_DATA."""
    keys = ["rep"] if "rep" in dense.columns else []

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                q = unranked_rows(part.column("rank").to_numpy(), n)
                reps = part.column("rep").to_numpy() if keys else np.zeros(len(q), np.int64)
                out = resolve(q, cells_of(part.column("cells")), reps, seed, most_rank)
                yield _batch([*keys, *NAMES, "s0", "s1", "s2", "res", "nsnps"], [*([reps] if keys else []), *q.T, *out])

    return dense.mapInArrow(run, ("rep BIGINT, " if keys else "") + SCORED)


def with_no_data(scored: DataFrame, quartets: DataFrame, seed: int) -> DataFrame:
    """scored plus the quartets that have no site: NO_DATA scores and a hash choice."""
    keys = ["rep"] if "rep" in scored.columns else []
    lone = quartets.join(scored.select(*keys, *NAMES), [*keys, *NAMES], "left_anti")
    return scored.unionByName(no_data(lone, seed).select(*scored.columns))


def no_data(quartets: DataFrame, seed: int) -> DataFrame:
    """Result rows of quartets without data."""
    from ..functions.chance import draw

    rep = F.col("rep") if "rep" in quartets.columns else F.lit(0)
    res = (draw(seed, rep, *map(F.col, NAMES)) % 3).cast("int")
    s = [F.lit(NO_DATA).alias(c) for c in ("s0", "s1", "s2")]
    keys = ["rep"] if "rep" in quartets.columns else []
    return quartets.select(*keys, *NAMES, *s, res.alias("res"), F.lit(0).cast("long").alias("nsnps"))


def spectra(dense: DataFrame) -> DataFrame:
    """(rep,) i0..i3, f, values (16 singular values, the largest first), nsnps from counts.dense_rows()."""
    keys = ["rep"] if "rep" in dense.columns else []

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                cells = part.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(-1, 256)
                values = singular_values(cells).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(3 * len(cells) + 1, dtype=np.int32) * 16), pa.array(values))
                again = [pa.array(np.repeat(part.column(c).to_numpy(), 3)) for c in [*keys, *NAMES]]
                f = pa.array(np.tile(np.arange(3, dtype=np.int32), len(cells)))
                yield pa.RecordBatch.from_arrays([*again, f, lists, pa.array(np.repeat(cells.sum(axis=1), 3))], [*keys, *NAMES, "f", "values", "nsnps"])

    return dense.mapInArrow(run, ("rep BIGINT, " if keys else "") + "i0 INT, i1 INT, i2 INT, i3 INT, f INT, values ARRAY<DOUBLE>, nsnps BIGINT")


def score_dense(codes: DataFrame, quartets: DataFrame | Ranks, n: int, seed: int, unlinked: bool = False, rep: int = 0, most_rank: int = MOST_RANK) -> DataFrame:
    """i0..i3, s0..s2, res, nsnps of every quartet against one replicate's codes, whose matrix has at most DENSE_CELLS cells.

    Executors pack the sites; the driver passes on a few rows of bytes.
    """
    packed = blocks(codes, n).cache()
    size = packed.agg(F.sum(F.length("packed"))).first()[0] or 0
    if size > DENSE_CELLS:
        raise ValueError(f"{size} cells are more than go to every executor; count by blocks")
    matrix = Matrix.of_rows(packed.toArrow().to_pylist(), n)
    packed.unpersist()
    shared = codes.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                q = unranked_rows(batch.slice(lo, 512).column("rank").to_numpy(), n)
                cells = shared.value.unlinked_counts(q) if unlinked else shared.value.counts(q)
                yield _batch([*NAMES, "s0", "s1", "s2", "res", "nsnps"], [*q.T, *resolve(q, cells, np.full(len(q), rep), seed, most_rank)])

    return rank_rows(codes.sparkSession, quartets, n).mapInArrow(run, SCORED)
