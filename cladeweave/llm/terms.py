"""Runs of chosen characters in Arrow text columns, as keys and as strings, by numpy.

Texts come as one buffer of UTF-8 bytes with offsets (see words.buffers); what belongs to
a run is told byte by byte, and a run never crosses the end of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import buffers, range_keys

_BYTES = np.arange(256)
#: Digits, ASCII letters and all bytes of other characters: what terms of the search are made of.
ALNUM = (_BYTES >= 0x80) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
_ASCII_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
#: The first byte of U+00C0 to U+00FF in UTF-8; their second is the last byte of the number less LATIN.
LEAD, LATIN = 0xC3, 0x40
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CONTINUES = (_BYTES & 0xC0) == 0x80


def latin_letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to A-Z, a-z and U+00C0 to U+00FF."""
    inside = _ASCII_LETTER[data] | (data == LEAD)
    inside[1:] |= data[:-1] == LEAD
    return inside


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes marked inside, cut where a text starts."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[offsets < len(inside)]
    first[at] |= inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = at[at > 0] - 1
    last[at] |= inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def term_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (two arrays, see words) of all texts' terms, A-Z lower-cased, and each text's offset among them."""
    data, offsets = buffers(column)
    starts, ends = runs(ALNUM[data], offsets)
    a, b = range_keys(_LOWER[data], starts, ends)
    return a, b, np.searchsorted(starts, offsets, side="left")


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[starts:ends] as strings; the ranges are in order and apart."""
    sizes = ends - starts
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    taken = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(taken)))


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Tally:
    """Counts by keys that are added up in bounded memory: what outgrows `most` rows is given out and begun anew."""

    def __init__(self, keys: list[str], most: int = 400_000):
        self.keys, self.most, self.held, self.rows = keys, most, [], 0

    def add(self, table: pa.Table):
        """Take rows of keys and n in; yields what has to leave."""
        self.held.append(table)
        self.rows += table.num_rows
        if self.rows > self.most:
            merged = self._merged()
            if merged.num_rows > self.most // 2:
                yield from self._out(merged)
                merged = merged.slice(0, 0)
            self.held, self.rows = [merged], merged.num_rows

    def rest(self):
        if self.held:
            yield from self._out(self._merged())
            self.held, self.rows = [], 0

    def _merged(self) -> pa.Table:
        found = pa.concat_tables(self.held).group_by(self.keys, use_threads=False).aggregate([("n", "sum")])
        return found.rename_columns([c if c != "n_sum" else "n" for c in found.column_names]).select([*self.keys, "n"])

    def _out(self, table: pa.Table):
        yield from table.to_batches(max_chunksize=16_384)
