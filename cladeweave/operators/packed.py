"""The matrix as packed blocks of sites, and pattern counts of quartets by tiles of ranks and blocks.

A block holds a byte a cell (a base's code, 4 where missing) of all samples for a range of
site numbers, about BLOCK_CELLS cells, so any task's share has a bound. Quartets are known
by their ranks: all of a universe are intervals of numbers, chosen ones lists of about
PART numbers. A task takes a block and an interval or a list, unranks in numpy and counts;
neither a quartet nor a count passes the driver, and all quartets of any universe take
one pass over the blocks.

What a block says of a quartet is a row of 256 counts. Where there are several blocks, a task
takes HELD quartets at most through all of them, or through one group of them while there
are fewer tasks than cores want, and adds up in place: what moves is the blocks, and a row
a quartet and group. Rows of several groups are added up behind a shuffle by rank, as
streams of sorted rows: no group is held whole.

Where one site a locus counts, a block's states are (locus, place and pattern of the first
site that counts there). Two states of one locus merge into the one of the earlier place,
in any order, so loci need not be runs of sites nor end with a block. Loci that no other
block holds are settled as counts at once; only states of loci in several blocks travel.
With a seed each locus counts at a random site: place is then a hash of quartet and site.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from hashlib import md5
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_table
from .quartets import NAMES, rank_of

BLOCK_CELLS, PART, PARTS, TILE = 1 << 20, 1 << 16, 1 << 12, 256
#: Quartets that a task adds up counts of several blocks for (2 KB each), and cells of a block where each site is hashed for each quartet.
HELD, HASHED_CELLS = 1 << 14, 1 << 16
#: Ranks that a broadcast table of lists holds at most.
SMALL = 1 << 20
MISSING = 4
_BASES = np.arange(256)
#: Of each of the 256 patterns the cell among those of four codes, MISSING included; the patterns of four equal bases.
CELLS = 625
_CELLS = (_BASES >> 6) * 125 + (_BASES >> 4 & 3) * 25 + (_BASES >> 2 & 3) * 5 + (_BASES & 3)
_EQUAL = np.arange(4) * 85
PARTIAL = "rank BIGINT, cells BINARY, locus BIGINT, first BIGINT, key BINARY"


@dataclass(frozen=True)
class Ranks:
    """The quartets of n samples with ranks from start up to end (all without an end): numbers, never rows."""

    n: int
    start: int = 0
    end: int | None = None

    @property
    def last(self) -> int:
        return comb(self.n, 4) if self.end is None else min(self.end, comb(self.n, 4))

    def __len__(self) -> int:
        return max(0, self.last - self.start)


def unranked_rows(ranks: np.ndarray, n: int) -> np.ndarray:
    """Quartets (rows of four) of ranks, by the combinatorial number system."""
    left, out = comb(n, 4) - 1 - ranks.astype(np.int64), np.empty((len(ranks), 4), np.int32)
    for place, k in enumerate((4, 3, 2, 1)):
        tops = np.array([comb(t, k) for t in range(n)], np.int64)
        top = np.searchsorted(tops, left, side="right") - 1
        out[:, place] = n - 1 - top
        left -= tops[top]
    return out


class Matrix:
    """Packed codes (samples x sites) with each site's locus and number, in order of locus and site."""

    def __init__(self, codes: np.ndarray, locus: np.ndarray, site: np.ndarray):
        order = np.lexsort((site, locus))
        if (np.diff(order) != 1).any():
            codes, locus, site = np.ascontiguousarray(codes[:, order]), locus[order], site[order]
        self.codes, self.locus, self.site = codes, locus, site

    @classmethod
    def of_rows(cls, rows: list[dict], n: int) -> "Matrix":
        """One matrix of n samples from rows of blocks()."""
        parts, locus, site = [np.zeros((n, 0), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in sorted(rows, key=lambda r: r["block"]):
            own = np.frombuffer(r["packed"], np.uint8).reshape(r["n"], -1)[:n]
            parts.append(np.concatenate([own, np.full((n - len(own), own.shape[1]), MISSING, np.uint8)]))
            locus.append(np.frombuffer(r["loci"], np.int64))
            site.append(np.frombuffer(r["sites"], np.int64))
        return cls(np.concatenate(parts, axis=1), np.concatenate(locus), np.concatenate(site))

    def _row(self, i: int) -> np.ndarray:
        """A sample's codes; one that the matrix lacks is missing everywhere."""
        return self.codes[i] if i < len(self.codes) else np.full(self.codes.shape[1], MISSING, np.uint8)

    def counts(self, quartets: np.ndarray) -> np.ndarray:
        """256 counts for each quartet, over all sites. Quartets in a row that share their first three samples are counted together."""
        out = np.zeros((len(quartets), 256), np.int64)
        many = max(1, (1 << 16) // max(1, self.codes.shape[1]))
        new = np.flatnonzero((quartets[1:, :3] != quartets[:-1, :3]).any(axis=1)) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(quartets)]):
            if lo < hi:
                a, b, c = (self._row(i).astype(np.int64) for i in quartets[lo, :3].tolist())
                three = a * 125 + b * 25 + c * 5
            for at in range(lo, hi, many):
                last = np.stack([self._row(d) for d in quartets[at : min(at + many, hi), 3].tolist()])
                cell = three + last + np.arange(len(last))[:, None] * CELLS
                out[at : at + len(last)] = np.bincount(cell.reshape(-1), minlength=len(last) * CELLS).reshape(-1, CELLS)[:, _CELLS]
        out[:, _EQUAL] = 0
        return out

    def _told(self, q) -> np.ndarray:
        """Where the sites stand that count for a quartet."""
        a, b, c, d = (self._row(i) for i in q)
        return np.flatnonzero((a < 4) & (b < 4) & (c < 4) & (d < 4) & ~((a == b) & (b == c) & (c == d)))

    def _patterns(self, q, at: np.ndarray) -> np.ndarray:
        a, b, c, d = (self._row(i)[at].astype(np.int64) for i in q)
        return (a << 6) | (b << 4) | (c << 2) | d

    def firsts(self, q) -> tuple[np.ndarray, np.ndarray]:
        """Where the first site of each locus stands that counts for a quartet, and its pattern."""
        at = self._told(q)
        if len(at):
            locus = self.locus[at]
            at = at[np.concatenate([[True], locus[1:] != locus[:-1]])]
        return at, self._patterns(q, at)

    @cached_property
    def _texts(self) -> list[bytes]:
        return [b"%d" % s for s in self.site.tolist()]

    def drawn(self, q, seed: int, rep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As firsts, but of each locus the site with the least chance.order_key(seed, rep, *q, site); with these keys, as two numbers."""
        at, texts = self._told(q), self._texts
        if not len(at):
            return at, self._patterns(q, at), np.zeros((0, 2), ">u8")
        head = ":".join(map(str, (seed, rep, *map(int, q), ""))).encode()
        keys = np.frombuffer(b"".join([md5(head + texts[i]).digest() for i in at.tolist()]), ">u8").reshape(-1, 2)
        new = np.flatnonzero(np.append(True, np.diff(self.locus[at]) != 0))
        high = keys[:, 0].astype(np.uint64)
        least = np.repeat(np.minimum.reduceat(high, new), np.diff(np.append(new, len(at))))
        left = np.flatnonzero(high == least)  # mostly one a locus
        left = left[np.lexsort((self.site[at[left]], keys[left, 1].astype(np.uint64), self.locus[at[left]]))]
        left = left[np.append(True, np.diff(self.locus[at[left]]) != 0)]
        return at[left], self._patterns(q, at[left]), keys[left]

    def unlinked_counts(self, quartets: np.ndarray) -> np.ndarray:
        """256 counts for each quartet, of the first site that counts in each locus."""
        return np.stack([np.bincount(self.firsts(q)[1], minlength=256) for q in quartets]) if len(quartets) else np.zeros((0, 256), np.int64)


def blocks(codes: DataFrame, n: int, cells: int | None = None) -> DataFrame:
    """(rep,) block, n, loci, sites, packed: rows that hold a range of site numbers of all samples, about `cells` cells. n: about how many samples there are."""
    keys = ["rep"] if "rep" in codes.columns else []
    width = max(1, (cells or BLOCK_CELLS) // max(1, n))
    known = codes.where(F.col("code").isNotNull())
    rows = known.select(*keys, F.expr(f"site div {width}").alias("block"), "sample_idx", "locus", "site", F.col("code").cast("int").alias("code"))
    names = [*keys, "block", "n", "loci", "sites", "packed"]

    def pack(table: pa.Table) -> pa.Table:
        sample, code = (table.column(c).to_numpy() for c in ("sample_idx", "code"))
        sites, first, place = np.unique(table.column("site").to_numpy(), return_index=True, return_inverse=True)
        cells = np.full((int(sample.max()) + 1, len(sites)), MISSING, np.uint8)
        cells[sample, place] = code
        loci = table.column("locus").to_numpy()[first]
        values = [*(table.column(k)[0].as_py() for k in keys), table.column("block")[0].as_py(), len(cells), loci.astype(np.int64).tobytes(), sites.astype(np.int64).tobytes(), cells.tobytes()]
        kinds = [*(pa.int64() for _ in keys), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names)

    kind = ("rep BIGINT, " if keys else "") + "block BIGINT, n INT, loci BINARY, sites BINARY, packed BINARY"
    if keys:
        rows = rows.withColumn("rep", F.col("rep").cast("long"))
    return rows.groupBy(*keys, "block").applyInArrow(pack, kind)


def torn_loci(held: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, torn: the loci of each block that other blocks hold too."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                loci = np.unique(np.frombuffer(row["loci"], np.int64))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(loci), row[k])) for k in keys), pa.array(np.full(len(loci), row["block"])), pa.array(loci)], [*keys, "block", "locus"])

    here = held.select(*keys, "block", "loci").mapInArrow(run, "".join(f"{k} BIGINT, " for k in keys) + "block BIGINT, locus BIGINT")
    several = here.groupBy(*keys, "locus").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select(*keys, "locus")
    return here.join(several, [*keys, "locus"]).groupBy(*keys, "block").agg(F.collect_list("locus").alias("torn"))


def _tiled(held: DataFrame, quartets: DataFrame | Ranks, keys: list[str]) -> DataFrame:
    """held with each block once for every part of the quartets (lo and hi, or ranks; for rows with rep, each replicate's own)."""
    own = ["rep"] if not isinstance(quartets, Ranks) and "rep" in quartets.columns else []
    if isinstance(quartets, Ranks):
        step = max(PART, -(-len(quartets) // PARTS))
        parts = max(1, -(-len(quartets) // step))
        rows = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        lo = F.lit(quartets.start).cast("long") + F.col("part").cast("long") * step
        rows = rows.withColumn("lo", lo).withColumn("hi", F.least(lo + step, F.lit(quartets.last).cast("long"))).withColumn("ranks", F.lit(None).cast("array<bigint>"))
    else:
        total = quartets.count()
        parts = max(1, -(-total // PART))
        lists = quartets.groupBy(*own, F.pmod(F.xxhash64("rank"), F.lit(parts)).cast("int").alias("part")).agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
        if total <= SMALL:
            rows = held.join(F.broadcast(lists))  # at most SMALL numbers
        else:
            rows = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(lists, "part")
        rows = rows.withColumn("lo", F.lit(0).cast("long")).withColumn("hi", F.lit(0).cast("long"))
    return rows if parts == 1 and not own else rows.repartition(*keys, *own, "block", "part")


def _grouped(held: DataFrame, quartets: DataFrame | Ranks, keys: list[str], sizes: dict) -> tuple[DataFrame, int]:
    """As _tiled, with a partition for each replicate, part of at most about HELD quartets and group of blocks; and the number of groups. sizes: blocks of each replicate."""
    total = len(quartets) if isinstance(quartets, Ranks) else quartets.count()
    parts = max(1, -(-total // HELD))
    groups = max(1, min(max(sizes.values()), -(-2 * held.sparkSession.sparkContext.defaultParallelism // (parts * len(sizes)))))
    rows = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    lo = F.lit(0).cast("long")
    if isinstance(quartets, Ranks):
        lo = quartets.start + F.col("part").cast("long") * HELD
        rows = rows.withColumn("ranks", F.lit(None).cast("array<bigint>")).withColumn("lo", lo).withColumn("hi", F.least(lo + HELD, F.lit(quartets.last).cast("long")))
    else:
        lists = quartets.groupBy(F.pmod(F.xxhash64("rank"), F.lit(parts)).cast("int").alias("part")).agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
        rows = rows.join(F.broadcast(lists) if total <= SMALL else lists, "part").withColumn("lo", lo).withColumn("hi", lo)
    place = F.array_position(F.array(*[F.lit(rep) for rep in sorted(sizes)]), F.col(keys[0])) - 1 if keys else F.lit(0)
    number = (place * parts + F.col("part")) * groups + F.pmod("block", F.lit(groups))
    return rows.repartitionById(len(sizes) * parts * groups, number.cast("int")), groups


def _partials(matrix: Matrix, ranks: np.ndarray, n: int, unlinked: bool, torn: np.ndarray, chance: tuple[int, int] | None = None) -> tuple[np.ndarray, list, list]:
    """Rows of 256 counts for ranks, (rank, locus, place and pattern) of the torn loci and, for random sites by chance (seed, rep), their keys."""
    quartets = unranked_rows(ranks, n)
    if not unlinked:
        return matrix.counts(quartets), [], []
    if not len(torn) and chance is None:
        return matrix.unlinked_counts(quartets), [], []
    cut, states, drawn, counts = np.isin(matrix.locus, torn), [], [], np.zeros((len(ranks), 256), np.int64)
    for k, four in enumerate(quartets):
        at, cell, key = matrix.drawn(four, *chance) if chance else (*matrix.firsts(four), None)
        late = cut[at]
        counts[k] = np.bincount(cell[~late], minlength=256)
        states.append(np.stack([np.full(int(late.sum()), ranks[k]), matrix.locus[at[late]], matrix.site[at[late]] * 256 + cell[late]], axis=1))
        drawn += [] if key is None else [row.tobytes() for row in key[late]]
    return counts, states, drawn


def rank_rows(spark: SparkSession, quartets: DataFrame | Ranks, n: int, keys: list[str] = []) -> DataFrame:
    """(keys,) rank of each quartet, as rows."""
    if isinstance(quartets, Ranks):
        return spark.range(quartets.start, max(quartets.start, quartets.last)).withColumnRenamed("id", "rank")
    return quartets.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("rank").cast("long").alias("rank") if "rank" in quartets.columns else rank_of(n).alias("rank"))


def cell_counts(codes: DataFrame, quartets: DataFrame | Ranks, n: int, unlinked: bool = False, empty: bool = False, block_cells: int | None = None, seed: int | None = None) -> DataFrame:
    """(rep,) rank, cells (256 counts as 64-bit numbers) of quartets, over all sites or one site a locus.

    quartets: Ranks, or distinct rows with i0..i3 (or rank) of n samples. empty: with the
    quartets that have no site, as rows of zeros. seed: with one site a locus, a random one.
    """
    if n < 4:
        raise ValueError("counts of quartets need the number of samples")
    keys = ["rep"] if "rep" in codes.columns else []
    spark = codes.sparkSession
    if not isinstance(quartets, Ranks):
        quartets = rank_rows(spark, quartets, n)
    hashed = unlinked and seed is not None
    held = shared_table(blocks(codes, n, block_cells or (HASHED_CELLS if hashed else None)), "blocks")
    sizes = {row[keys[0]] if keys else 0: row["count"] for row in held.groupBy(*keys).count().collect() if row["count"]}  # one row a replicate
    most = max(sizes.values(), default=0)
    if not most and empty and not keys:
        return rank_rows(spark, quartets, n).withColumn("cells", F.lit(bytes(2048)))
    several = most > 1
    if unlinked and several:
        held = held.join(torn_loci(held, keys), [*keys, "block"], "left")
    else:
        held = held.withColumn("torn", F.lit(None).cast("array<bigint>"))

    def run(batches):
        sums = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                told = tuple(row[k] for k in keys)
                matrix, torn = Matrix.of_rows([row], n), np.array(row["torn"] or [], np.int64)
                every = np.arange(row["lo"], row["hi"]) if row["ranks"] is None else np.array(row["ranks"], np.int64)
                if several:  # one key a partition
                    total = sums.setdefault((told, row["part"]), (every, np.zeros((len(every), 256), np.int64)))[1]
                for at in range(0, len(every), TILE):
                    ranks = every[at : at + TILE]
                    counts, states, drawn = _partials(matrix, ranks, n, unlinked, torn, (seed, told[0] if told else 0) if hashed else None)
                    if several:
                        total[at : at + TILE] += counts
                        ranks, counts = ranks[:0], counts[:0]
                    some = counts.any(axis=1) | empty
                    late = np.concatenate(states) if states else np.zeros((0, 3), np.int64)
                    if some.any() or len(late):
                        yield named(told, _partial_rows(ranks[some], counts[some], late, drawn))
        for (told, _), (every, total) in sums.items():
            for at in range(0, len(every), TILE):
                counts = total[at : at + TILE]
                some = counts.any(axis=1) | empty
                yield named(told, _partial_rows(every[at : at + TILE][some], counts[some], np.zeros((0, 3), np.int64), []))

    def named(told: tuple, out: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(np.full(out.num_rows, x)) for x in told), *out.columns], [*keys, *out.schema.names])

    kind = "".join(f"{k} BIGINT, " for k in keys)
    tiles, groups = _grouped(held, quartets, keys, sizes) if several else (_tiled(held, quartets, keys), 1)
    found = tiles.mapInArrow(run, kind + PARTIAL)
    if groups == 1 and not (several and unlinked):
        return found.select(*keys, "rank", "cells")
    if hashed:
        found = shared_table(found, "drawn")  # read twice, and dear
    rows = found.where("cells IS NOT NULL").select(*keys, "rank", "cells")
    if unlinked:
        least = F.min(F.struct("key", "first"))["first"] if hashed else F.min("first")
        first = found.where("cells IS NULL").groupBy(*keys, "rank", "locus").agg(least.alias("first"))
        late = first.groupBy(*keys, "rank", (F.col("first") % 256).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        rows = rows.withColumn("cell", F.lit(None).cast("int")).withColumn("n", F.lit(None).cast("long")).unionByName(late.withColumn("cells", F.lit(None).cast("binary")).select(*keys, "rank", "cells", "cell", "n"))
    return _added(rows, keys)


def _partial_rows(ranks: np.ndarray, counts: np.ndarray, late: np.ndarray, drawn: list[bytes]) -> pa.RecordBatch:
    m, k = len(ranks), len(late)
    cells = pa.concat_arrays([cell_column(counts), pa.nulls(k, pa.binary())])
    columns = [pa.array(np.concatenate([ranks, late[:, 0]])), cells]
    columns += [pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(late[:, c])]) for c in (1, 2)]
    columns.append(pa.array([None] * m + (drawn or [None] * k), pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["rank", "cells", "locus", "first", "key"])


def cell_column(counts: np.ndarray) -> pa.Array:
    """Rows of 256 counts as binary values."""
    data = np.ascontiguousarray(counts, np.int64)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * 2048
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def cells_of(column: pa.Array) -> np.ndarray:
    """Counts (rows of 256) of a column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.int64).reshape(-1, 256) if len(column) else np.zeros((0, 256), np.int64)


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys and rank added up, as a stream of sorted rows. Rows with cell and n add a single count."""
    names = [*keys, "rank"]
    spread = "cell" in rows.columns

    def sums(table: pa.Table):
        told = np.stack([table.column(c).to_numpy() for c in names], axis=1)
        new = np.flatnonzero(np.append(True, (told[1:] != told[:-1]).any(axis=1)))
        place, cells = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(told)))), table.column("cells").combine_chunks()
        dense = cells.is_valid().to_numpy(zero_copy_only=False)
        total = np.zeros((len(new), 256), np.int64)
        np.add.at(total, place[dense], cells_of(cells.drop_null()))
        if spread and not dense.all():
            one = table.filter(pa.array(~dense))
            np.add.at(total, (place[~dense], one.column("cell").to_numpy()), one.column("n").to_numpy())
        return told[new], total

    def out(told: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in told.T), cell_column(total)], [*names, "cells"])

    def run(batches):
        last, carried = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                told, total = sums(pa.Table.from_batches([batch.slice(lo, 1024)]))
                if last is not None and (told[0] == last[0]).all():
                    total[0] += carried[0]
                elif last is not None:
                    yield out(last, carried)
                if len(told) > 1:
                    yield out(told[:-1], total[:-1])
                last, carried = told[-1:], total[-1:]
        if last is not None:
            yield out(last, carried)

    dealt = rows.repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, "".join(f"{k} BIGINT, " for k in names) + "cells BINARY")


def sparse_counts(dense: DataFrame, n: int) -> DataFrame:
    """(rep,) i0..i3, r, c, n of cell_counts()."""
    keys = ["rep"] if "rep" in dense.columns else []

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts = cells_of(part.column("cells"))
                q, cell = np.nonzero(counts)
                columns = [*(part.column(k).to_numpy()[q] for k in keys), *unranked_rows(part.column("rank").to_numpy(), n)[q].T, (cell // 16).astype(np.int32), (cell % 16).astype(np.int32), counts[q, cell]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*keys, *NAMES, "r", "c", "n"])

    return dense.mapInArrow(run, "".join(f"{k} BIGINT, " for k in keys) + "i0 INT, i1 INT, i2 INT, i3 INT, r INT, c INT, n BIGINT")


def pattern_totals(dense: DataFrame, n: int) -> DataFrame:
    """i0, r, c, quartets, n, marked of cell_counts(): how many quartets that begin with i0 hold a pattern, at how many sites, and that number weighted by where the other three samples stand.

    A task adds its quartets up, so what leaves it is as small as the samples are few.
    """

    def run(batches):
        sums = np.zeros((n, 3, 256), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                q, counts = unranked_rows(part.column("rank").to_numpy(), n).astype(np.int64), cells_of(part.column("cells"))
                mark = ((q[:, 1] * n + q[:, 2]) * n + q[:, 3]) % 1009
                for i in np.unique(q[:, 0]).tolist():  # ranks in a row mostly begin alike
                    own = q[:, 0] == i
                    for k, told in enumerate((counts[own] > 0, counts[own], counts[own] * mark[own, None])):
                        sums[i, k] += told.sum(axis=0)
        i, cell = np.nonzero(sums[:, 0])
        columns = [i.astype(np.int32), (cell // 16).astype(np.int32), (cell % 16).astype(np.int32), *(sums[i, k, cell] for k in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i0", "r", "c", "quartets", "n", "marked"])

    found = dense.select("rank", "cells").mapInArrow(run, "i0 INT, r INT, c INT, quartets BIGINT, n BIGINT, marked BIGINT")
    return found.groupBy("i0", "r", "c").agg(*[F.sum(x).alias(x) for x in ("quartets", "n", "marked")])


def asked_counts(codes: DataFrame, quartets: DataFrame | Ranks, n: int, unlinked: bool = False, seed: int | None = None) -> DataFrame:
    """(rep,) i0..i3, r, c, n of the distinct quartets given, over all sites or one site a locus, a random one with a seed."""
    return sparse_counts(cell_counts(codes, quartets, n, unlinked, seed=seed), n)
