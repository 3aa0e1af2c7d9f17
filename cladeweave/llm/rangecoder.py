"""An adaptive context-mixing range coder for token ids, many blocks in step.

A block is up to BLOCK ids and is coded on its own, so blocks can be read in any order;
numpy codes one id of every block of a chunk at a time.

The distribution of one id is a weighted sum of three predictions:

- order 0: how often each id stands in the chunk;
- order 1: how often it follows the id before it, for pairs that stand there LEAST_PAIR
  times or more;
- order 2: the id that last followed the same two ids in this block. A cell that two
  contexts share holds the last id of its context as it is, since its place speaks of
  that id's list, and a part of a hash of both: a mistaken hash only costs bytes.

What a chunk's blocks start from, the counts of orders 0 and 1, is the chunk's prior; it
is stored once a chunk. Within a block the rest adapts: the contexts of order 2 and how
often they were right in a row, the weight of order 2 for each such number, and the
weight of order 1 against order 0 for each class of contexts (how much of what follows
an id the prior's pairs hold). The latter takes LEVELS steps, so that the decoder finds
an id in sums made once for each step. An id's interval is the sum of its three shares.

Arithmetic coding: a range of 63 bits, of which 16 leave whenever it falls under 2**47.
Words leave with a seventeenth bit, the carry, that is added to the word before when all
of a block's are there; so the decoder needs the range alone.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK, LEAST_PAIR, SLOT_BITS, RATE = 1024, 3, 8, 5
#: Shares of 256 that order 1 gets against order 0; none where an id has no listed pairs.
LEVELS = np.array([0, 112, 176, 216, 238, 250], dtype=np.int64)
_LEVEL_OF = np.abs(np.arange(256)[:, None] - LEVELS[None, 1:]).argmin(1) + 1
_LEVEL_OF[0] = 0
#: Where weights of order 2 start, by the hits in a row before, of 2**16.
_TRUST = np.array([6000, 26000, 44000, 56000, 61000, 63000, 64000, 64500], dtype=np.int64)
#: The decoder's guide cuts a list's sums into two to four parts for each entry, 2**GUIDE_BITS at most.
GUIDE_BITS = 12
_U = np.uint64
_LEAST, _REST = _U(1 << 47), _U((1 << 47) - 1)
#: Of a symbol's start and share in one number: the share.
_SHARE = (1 << 32) - 1


def _shares(counts: np.ndarray, first: np.ndarray, total: int) -> np.ndarray:
    """Counts of consecutive groups (starting at first) as shares that add up to total, each 1 at least; the largest of a group takes the rest."""
    if not len(counts):
        return counts.astype(np.int64)
    sizes = np.diff(np.append(first, len(counts)))
    sums = np.add.reduceat(counts, first)
    shares = counts * np.repeat((total - sizes), sizes) // np.repeat(sums, sizes) + 1
    group = np.repeat(np.arange(len(first)), sizes)
    order = np.lexsort((counts, group))
    top = order[np.append(first[1:], len(counts)) - 1]
    shares[top] += total - np.add.reduceat(shares, first)
    return shares


def _rounded(counts: np.ndarray) -> np.ndarray:
    """Counts with four significant bits: the prior gets shorter."""
    drop = np.maximum(np.int64(0), np.frexp(counts.astype(float))[1].astype(np.int64) - 4)
    return counts >> drop << drop


class Prior:
    """Counts of a chunk's ids and pairs and what coding takes of them; symbols are ranks of the ids that the chunk holds."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, ctx: np.ndarray, nxt: np.ndarray, pairs: np.ndarray, level: np.ndarray):
        """ids, counts: of symbols; ctx, nxt, pairs: listed pairs in order and their counts; level: of each symbol as a context."""
        self.ids, self.counts, self.ctx, self.nxt, self.pairs, self.level = ids, counts, ctx, nxt, pairs, level
        d = len(ids)
        self.scale = max(16, int(d).bit_length() + 1)
        total = 1 << self.scale
        self.f0 = _shares(counts, np.zeros(1, np.int64), total)
        self.F0 = np.cumsum(self.f0) - self.f0
        # an entry without a share of its own leads each context's list, so that each place has an entry at or before it
        self.size = np.bincount(ctx, minlength=d)
        self.base = np.cumsum(self.size) - self.size + np.arange(d)
        self.entries = n = d + len(ctx)
        self.at = np.arange(len(ctx)) + ctx + 1
        self.sym = np.zeros(n, np.int64)
        self.sym[self.at] = nxt
        self.f1, self.F1 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        first = np.flatnonzero(np.diff(ctx, prepend=-1))
        self.f1[self.at] = _shares(pairs, first, total)
        run = np.cumsum(self.f1) - self.f1
        self.F1 = run - np.repeat(run[self.base], self.size + 1)
        # start << 32 | share, of symbols in order 0; of places (2 * entry, plus 1 if the symbol is the entry's own) in order 1
        self.packed0 = self.F0 << 32 | self.f0
        self.packed1 = np.stack([self.F1 + self.f1 << 32, self.F1 << 32 | self.f1], axis=1).reshape(-1)
        # a symbol and its place in one number, with three bits left below: symbol << place_bits | place << 3
        self.place_bits = (2 * n).bit_length() + 3
        self.places = (1 << self.place_bits - 3) - 1

    def for_decoding(self) -> None:
        """What only the decoder needs."""
        d, n, size, ctx, at = len(self.ids), self.entries, self.size, self.ctx, self.at
        self.of_slot = np.repeat(np.arange(d, dtype=np.int32), self.f0)
        self.codes = self.sym << self.place_bits | np.arange(n) * 2 + 1 << 3
        a = LEVELS[:, None]
        self.sums = (a * self.F1 + (256 - a) * self.F0[self.sym]).astype(np.int32).reshape(-1)
        # guide: for each level and list how many entries begin before each part of the sums; contexts without a list share a row of one part
        lists = np.flatnonzero(size)
        bits = np.zeros(d, np.int64)
        bits[lists] = np.minimum(GUIDE_BITS, np.frexp(size[lists] - 0.5)[1] + 1)
        rows = (1 << bits[lists]) + 2
        row, shift = np.zeros(d, np.int64), 8 + self.scale - bits
        row[lists] = 3 + np.cumsum(rows) - rows
        self.guide_size = 3 + int(rows.sum())
        before = np.repeat(np.append(0, (np.cumsum(size) - size)[lists]), np.append(3, rows))
        guide = []
        for i in range(len(LEVELS)):
            mark = row[ctx] - (-self.sums[i * n + at].astype(np.int64) >> shift[ctx])
            guide.append((np.cumsum(np.bincount(mark, minlength=self.guide_size)) - before).astype(np.uint16 if d < 1 << 16 else np.uint32))
        self.guide = np.concatenate(guide)
        # of a context in one number: place in the guide << 32 | first entry << 8 | shift
        self.lists = row << 32 | self.base << 8 | shift

    @classmethod
    def of(cls, ids: np.ndarray, block: int) -> tuple["Prior", np.ndarray]:
        """The prior of a chunk's ids; its symbols and their places, in one number each, step by step for all blocks. A block's first context is symbol 0."""
        counts = np.bincount(ids)
        known = np.flatnonzero(counts)
        counts, d, total = counts[known], len(known), len(ids)
        rank = np.zeros(int(known[-1]) + 1, np.uint64)
        rank[known] = np.arange(d)
        symbols = rank[ids]
        keys = np.zeros(total, np.uint64)
        keys[1:] = symbols[:-1]
        keys[::block] = 0
        keys *= _U(d)
        keys += symbols
        del symbols
        lanes = -(-total // block)
        # where each goes: steps below each other, blocks side by side
        cell = (np.arange(lanes, dtype=np.uint64)[:, None] + np.arange(block, dtype=np.uint64) * _U(lanes)).reshape(-1)[:total]
        bits = (block * lanes - 1).bit_length()
        if (d * d - 1).bit_length() + bits <= 64:  # sorted as one number each
            keys <<= _U(bits)
            keys |= cell
            keys.sort()
            np.bitwise_and(keys, _U((1 << bits) - 1), out=cell)
            keys >>= _U(bits)
        else:
            order = np.argsort(keys)
            keys, cell = keys[order], cell[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys = keys[first].astype(np.int64)
        n = np.diff(np.append(first, total))
        keep = n >= LEAST_PAIR
        ctx, nxt, pairs = keys[keep] // d, keys[keep] % d, n[keep]
        held = np.bincount(ctx, pairs, d) / np.maximum(np.bincount(keys // d, n, d), 1)
        level = _LEVEL_OF[np.minimum(255, (held * 256)).astype(np.int64)]
        level[np.bincount(ctx, minlength=d) == 0] = 0
        prior = cls(known, _rounded(counts), ctx, nxt, _rounded(pairs), level)
        # the last entry of the list that isn't beyond the symbol
        entry = np.cumsum(keep) + keys // d
        codes = keys % d << prior.place_bits | 2 * entry + keep << 3
        cells = np.zeros(block * lanes, np.int64)
        cells[cell.view(np.int64)] = np.repeat(codes, n)
        return prior, cells.reshape(block, lanes)

    def tobytes(self) -> bytes:
        size = np.bincount(self.ctx, minlength=len(self.ids))
        gaps = np.diff(self.nxt, prepend=0)
        first = np.flatnonzero(np.diff(self.ctx, prepend=-1))
        gaps[first] = self.nxt[first]
        head = np.array([len(self.ids), len(self.ctx)], "<u4").tobytes()
        planes = [np.diff(self.ids, prepend=0), self.counts, size, gaps, self.pairs]
        body = b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in planes) + self.level.astype(np.uint8).tobytes()
        return head + zlib.compress(body, 6)

    @classmethod
    def frombytes(cls, raw: bytes) -> "Prior":
        d, n = np.frombuffer(raw[:8], "<u4").tolist()
        body, at, planes = zlib.decompress(raw[8:]), 0, []
        for k in (d, d, d, n, n):
            planes.append(np.frombuffer(body, np.uint8, 4 * k, at).reshape(4, k).T.copy().view("<u4").reshape(-1).astype(np.int64))
            at += 4 * k
        ids, counts, size, gaps, pairs = planes
        ctx = np.repeat(np.arange(d), size)
        run = np.cumsum(gaps)
        first = np.cumsum(size) - size
        nxt = run - np.repeat((run - gaps)[first[size > 0]], size[size > 0])
        return cls(np.cumsum(ids), counts, ctx, nxt, pairs, np.frombuffer(body, np.uint8, d, at).astype(np.int64))


class _Mixer:
    """What n blocks learn as they go."""

    def __init__(self, prior: Prior, n: int):
        self.p = prior
        lanes = np.arange(n)
        self.one = 8 + prior.scale
        # cells of order 2: a part of the hash, the last id, symbol and place, hits; an empty one's last id is none
        width = len(prior.ids).bit_length()
        self.last_at = prior.place_bits + width
        self.hash_mask, self.tag_mask, self.code_mask = -(1 << self.last_at + width), -(1 << self.last_at), (1 << self.last_at) - 8
        self.cells = np.full(n << SLOT_BITS, -1, np.int64)
        self.cell_base = lanes << SLOT_BITS
        self.trust = np.tile(_TRUST, n)
        self.trust_base = lanes * len(_TRUST)
        self.weight = np.tile(LEVELS << 8, n)
        self.weight_base = lanes * len(LEVELS)
        self.before = self.last = np.zeros(n, np.int64)

    def predict(self, k: int) -> None:
        last = self.last[:k]
        self.level_at = self.weight_base[:k] + self.p.level[last]
        self.w = self.weight[self.level_at]
        self.step = _LEVEL_OF[self.w >> 8]
        self.a = LEVELS[self.step]
        self.b = 256 - self.a
        key = (self.before[:k] << 32 | last) * 0x1E3779B97F4A7C15
        self.slot = self.cell_base[:k] + (key.view(np.uint64) >> _U(64 - SLOT_BITS)).view(np.int64)
        self.tag = key << SLOT_BITS & self.hash_mask | last << self.last_at
        cell = self.cells[self.slot]
        # lanes whose context has been seen, and what order 2 says there
        self.seen = (cell & self.tag_mask == self.tag).nonzero()[0]
        value = cell[self.seen]
        self.guess, self.hits = value & self.code_mask, value & 7
        self.trust_at = self.trust_base[self.seen] + self.hits
        self.t = self.trust[self.trust_at]
        self.w2 = self.t >> 4  # of 4096

    def interval(self, both: np.ndarray, late: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and share of symbols in the sum of all orders, from both in the sum of orders 0 and 1; late, hit: which are beyond order 2's guess or are it, where there is one."""
        self.both = both & _SHARE
        seen, w2 = both[self.seen], self.w2 << self.one
        w01 = 4096 - self.w2
        start, share = both >> 32 << 12, self.both << 12
        start[self.seen], share[self.seen] = w01 * (seen >> 32) + w2 * late, w01 * (seen & _SHARE) + w2 * hit
        return start.view(np.uint64), share.view(np.uint64)

    def learn(self, k: int, codes: np.ndarray, symbols: np.ndarray, listed: np.ndarray, hit: np.ndarray) -> None:
        """listed: what order 1 adds to a symbol's share in the sum of orders 0 and 1."""
        self.trust[self.trust_at] = self.t + ((hit * 65535 - self.t) >> RATE)
        # the part of the share that order 1 has, of 2**16, 1/256 at least; what isn't listed speaks for order 0
        part = (listed * 65024 / self.both).astype(np.int64)
        part += (listed == 0) * 16128 + 256
        self.weight[self.level_at] = self.w + (part - self.w >> RATE)
        self.weight[:: len(LEVELS)] = 0
        cell = self.tag | codes
        cell[self.seen] |= np.minimum(self.hits + 1, len(_TRUST) - 1) * hit
        self.cells[self.slot] = cell
        self.before, self.last = self.last[:k], symbols


def _sizes(total: int, block: int) -> np.ndarray:
    n = -(-total // block)
    sizes = np.full(n, block)
    sizes[-1:] = total - block * (n - 1)
    return sizes


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[bytes]]:
    """The chunk's prior, and one payload for each block of `block` ids; the last may be shorter."""
    total = len(ids)
    if total == 0:
        return b"", []
    prior, cells = Prior.of(ids, block)
    sizes = _sizes(total, block)
    n, last = len(sizes), int(sizes[-1])
    mixer = _Mixer(prior, n)
    top = _U(12 + 8 + prior.scale)
    low, size = np.zeros(n, np.uint64), np.full(n, 1 << 63, np.uint64)
    out, at = np.zeros((512, n), np.uint32), np.arange(n)  # words below each other, where the next one of a block goes
    for t in range(int(sizes[0])):
        k = n - (t >= last)
        if t % 64 == 0 and int(at.max()) // n + 4 * 64 + 8 > len(out):  # an id takes three words at most
            out = np.concatenate([out, np.zeros((512, n), np.uint32)])
        codes = cells[t, :k]
        symbols, places = codes >> prior.place_bits, codes >> 3 & prior.places
        mixer.predict(k)
        own = codes[mixer.seen]
        hit = mixer.guess == own
        first = mixer.a * prior.packed1[places]
        start, share = mixer.interval(first + mixer.b * prior.packed0[symbols], mixer.guess < own, hit)
        low_k, size_k = low[:k], size[:k]
        r = size_k >> top
        low_k += r * start
        np.multiply(r, share, out=size_k)
        lanes, flat = (size_k < _LEAST).nonzero()[0], out.reshape(-1)
        while len(lanes):
            lo, sz, here = low_k[lanes], size_k[lanes] << _U(16), at[lanes]
            flat[here] = lo >> _U(47)
            at[lanes] = here + n
            low_k[lanes], size_k[lanes] = (lo & _REST) << _U(16), sz
            lanes = lanes[sz < _LEAST]
        mixer.learn(k, codes, symbols, first & _SHARE, hit)
    out.reshape(-1)[at] = (low + _REST) >> _U(47)
    ends = at // n + 1
    out = out[: int(ends.max())]
    for i in range(len(out) - 1, 0, -1):
        out[i - 1] += out[i] >> 16
    words = np.ascontiguousarray(out.astype("<u2").T)
    return prior.tobytes(), [words[i, :end].tobytes() for i, end in enumerate(ends.tolist())]


def _placed(prior: Prior, mixer: _Mixer, y: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols that hold y in the sum of orders 0 and 1, with their places; start and share of each there, and what order 1 adds to the share."""
    held = prior.lists[contexts]
    row = mixer.step * prior.guide_size + (held >> 32) + (y >> (held & 255))
    low = prior.guide[row]
    more = prior.guide[1:][row] - low
    entry = (held >> 8 & 0xFFFFFF) + low
    sums = mixer.step * prior.entries
    open_ = (more > 0).nonzero()[0]
    more = more[open_].astype(np.int64)
    while len(open_):  # the last of the `more` entries behind that begins at y or before
        at, half = entry[open_], more + 1 >> 1
        under = prior.sums[sums[open_] + at + half] <= y[open_]
        entry[open_] = at + half * under
        more -= half
        left = more.nonzero()[0]
        open_, more = open_[left], more[left]
    codes = prior.codes[entry]
    first = mixer.a * prior.packed1[2 * entry + 1]
    both = first + mixer.b * prior.packed0[codes >> prior.place_bits]
    beyond = (y >= (both >> 32) + (both & _SHARE)).nonzero()[0]
    a, b, places = mixer.a[beyond], mixer.b[beyond], 2 * entry[beyond]
    behind = prior.packed1[places]
    # numbers under 2**24: the quotient's whole part is exact
    symbols = prior.of_slot[((y[beyond] - a * (behind >> 32)) / b).astype(np.int64)].astype(np.int64)
    codes[beyond] = symbols << prior.place_bits | places << 3
    both[beyond] = a * behind + b * prior.packed0[symbols]
    first[beyond] = 0
    return codes, both, first & _SHARE


def decode(model: bytes, payloads: list[bytes], total: int, block: int = BLOCK) -> np.ndarray:
    """The ids of all blocks, `total` of them."""
    n = len(payloads)
    if n == 0:
        return np.zeros(0, np.int64)
    prior, sizes = Prior.frombytes(model), _sizes(total, block)
    prior.for_decoding()
    width = max(map(len, payloads)) // 2 + 8
    words = np.zeros((n, width), np.uint16)
    for i, p in enumerate(payloads):
        words[i, : len(p) // 2] = np.frombuffer(p, "<u2")
    words = np.ascontiguousarray(words.T)
    lead, flat = words[:4].astype(np.uint64), words.reshape(-1)
    off = lead[0] << _U(48) | lead[1] << _U(32) | lead[2] << _U(16) | lead[3]  # the code less low, in halves of the range's unit
    at, last_word, last = np.arange(n) + 4 * n, width * n - 1, int(sizes[-1])
    size = np.full(n, 1 << 63, np.uint64)
    mixer = _Mixer(prior, n)
    top, most = _U(12 + 8 + prior.scale), _U((1 << 20 + prior.scale) - 1)
    cells = np.zeros((block, n), np.uint16 if len(prior.ids) <= 1 << 16 else np.uint32)
    for t in range(int(sizes[0])):
        k = n - (t >= last)
        mixer.predict(k)
        off_k, size_k = off[:k], size[:k]
        r = size_k >> top
        twice = r << _U(1)
        v = np.minimum(off_k // twice, most).view(np.int64)
        seen, own = mixer.seen, v[mixer.seen]
        w01, w2 = 4096 - mixer.w2, mixer.w2 << mixer.one
        guess = mixer.a[seen] * prior.packed1[mixer.guess >> 3 & prior.places] + mixer.b[seen] * prior.packed0[mixer.guess >> prior.place_bits]
        begin = w01 * (guess >> 32)
        end = begin + w2 + w01 * (guess & _SHARE)
        late = own >= end
        hit = (own >= begin) ^ late
        y = v >> 12
        # numbers under 2**36 by numbers up to 2**12: the quotient's whole part is exact
        rest = ((own - w2 * late) / w01).astype(np.int64)
        rest += hit * ((guess >> 32) - rest)
        y[seen] = rest
        codes, both, listed = _placed(prior, mixer, y, mixer.last[:k])
        symbols = codes >> prior.place_bits
        start, share = mixer.interval(both, late, hit)
        off_k -= twice * start
        np.multiply(r, share, out=size_k)
        lanes = (size_k < _LEAST).nonzero()[0]
        while len(lanes):
            sz, here = size_k[lanes] << _U(16), at[lanes]
            off_k[lanes] = off_k[lanes] << _U(16) | flat[here]
            at[lanes] = np.minimum(here + n, last_word)
            size_k[lanes] = sz
            lanes = lanes[sz < _LEAST]
        cells[t, :k] = symbols
        mixer.learn(k, codes, symbols, listed, hit)
    return prior.ids[np.ascontiguousarray(cells.T).reshape(-1)[:total]]
