"""The merges of a byte-level BPE vocabulary, applied to many pieces in step by numpy.

Each piece is a column of ids, one a byte at first, beside the ranks of its neighbouring
pairs. In each step every column merges the first of its pairs of the lowest rank, until
no column has a pair that the vocabulary merges: what the library does, piece by piece.
Ids stay where they are; each knows the places of the ids before and behind it.
"""

from __future__ import annotations

import json

import numpy as np

#: Bytes of the longest piece; widths of the matrices that pieces are dealt into.
MOST, WIDTHS = 64, (6, 10, 16, 28, 64)
_NONE = np.int32(2**31 - 1)
#: A pair's rank << 7 | place, so that the least one is the one to merge; from _LAST on there is no rank.
_LAST = np.int32((1 << 24) - 1 << 7)


def _placed(ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.minimum(ranks, _LAST >> 7) << 7 | places.astype(np.int32)


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself where it prints, else the next from U+0100 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printed else chr(next(others)) for b in range(256)]


class Merges:
    def __init__(self, base: list[int], pairs: list[tuple[int, int, int]]):
        """base: the id of each byte; pairs: left and right id and the id of both, by rank."""
        self.base = np.array(base, np.int32)
        left, right, both = (np.array(x, np.int64) for x in zip(*pairs))
        keys, self.both = left << 32 | right, both.astype(np.int32)
        self.bits = max(10, (4 * len(pairs)).bit_length())
        self.keys, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE)
        todo, at = np.arange(len(pairs)), self._places(keys)
        while len(todo):  # a place that is taken sends a pair to the next one
            free = self.keys[at[todo]] < 0
            self.keys[at[todo][free]] = keys[todo][free]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        self.rank[at] = np.arange(len(pairs))
        #: Ranks of all pairs of bytes.
        self.of_bytes = self._ranks(np.repeat(self.base, 256), np.tile(self.base, 256))

    @classmethod
    def of(cls, library) -> "Merges | None":
        """The merges of a tokenizers file; None where it does more than plain byte-level BPE."""
        spec = json.loads(library.to_str())
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space"):
            return None
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters = byte_letters()
        if not all(c in vocab for c in letters):
            return None
        return cls([vocab[c] for c in letters], [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x1E3779B97F4A7C15 >> 63 - self.bits) & ((1 << self.bits) - 1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; _NONE where they don't merge or one is missing (-1)."""
        keys = left.astype(np.int64) << 32 | right
        at = self._places(keys)
        held = self.keys[at]
        found = np.where((held == keys) & (right >= 0), self.rank[at], _NONE)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            found[todo[hit]] = self.rank[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return found

    def _merged(self, ids: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Columns of ids with all merges done, -1 where an id went into the one before; ids: with -1 before and behind each column's own; pairs: of each id and the next."""
        height, n = ids.shape
        done, own = ids, np.arange(n)
        links = np.repeat(np.arange(height)[:, None], n, axis=1)
        before, behind = links - 1, links + 1
        while True:
            best = pairs.min(axis=0)
            go = np.flatnonzero(best < _LAST)
            if 2 * len(go) < len(own):
                done[:, own] = ids
                if not len(go):
                    return done
                ids, pairs, before, behind = (np.take(x, go, axis=1) for x in (ids, pairs, before, behind))
                best, own, go = best[go], own[go], np.arange(len(go))
            m = len(own)
            best = best[go] if len(go) < m else best
            j = (best & 127).astype(np.int64)
            at = j * m + go
            second = behind.reshape(-1)[at] * m + go
            third = behind.reshape(-1)[second]
            first = before.reshape(-1)[at]
            flat, flat_pairs, new = ids.reshape(-1), pairs.reshape(-1), self.both[best >> 7]
            flat[at], flat[second] = new, -1
            flat_pairs[second] = _LAST
            behind.reshape(-1)[at] = third
            before.reshape(-1)[third * m + go] = j
            ranks = self._ranks(np.concatenate([new, flat[first * m + go]]), np.concatenate([flat[third * m + go], new]))
            flat_pairs[np.concatenate([at, first * m + go])] = _placed(ranks, np.concatenate([j, first]))

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of data[starts:ends], pieces of at most MOST bytes, and their ids one after the other."""
        size = ends - starts
        counts, parts, order = np.zeros(len(starts), np.int64), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        least = 0
        for width in WIDTHS:
            own = np.flatnonzero((size > least) & (size <= width))
            least = width
            if not len(own):
                continue
            rows = np.arange(width)[:, None]
            inside = rows < size[own]
            letters = data[np.minimum(starts[own] + rows, len(data) - 1)]
            ids, pairs = np.full((width + 2, len(own)), -1, np.int32), np.full((width + 2, len(own)), _LAST)
            ids[1:-1] = np.where(inside, self.base[letters], -1)
            pairs[1:-2] = _placed(np.where(inside[1:], self.of_bytes[letters[:-1].astype(np.int32) << 8 | letters[1:]], _NONE), rows[1:])
            found = np.ascontiguousarray(self._merged(ids, pairs).T)
            kept = found >= 0
            counts[own] = kept.sum(axis=1)
            parts.append(found[kept])
            order.append(own)
        order, ids = np.concatenate(order), np.concatenate(parts)
        # from width by width to the order of the pieces
        first = np.cumsum(counts) - counts
        n = counts[order]
        flat = np.empty(len(ids), np.int32)
        flat[np.repeat(first[order] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return counts, flat
