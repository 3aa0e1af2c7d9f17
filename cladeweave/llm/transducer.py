"""A byte-level BPE tokenizer compiled to finite-state form, run by numpy.

Level one is a deterministic transducer over character classes that cuts a text into the
tokenizer's pieces (words with a leading space, numbers, marks, white space,
contractions). Its transitions say whether a piece starts at this character, at the one
before, or both: all the look-ahead the tokenizer's pattern has. Texts are laid end to
end with a symbol between them that resets the state, and cut into chunks of CHUNK
symbols; the map from each possible state before a chunk to the state behind it is found
for all chunks at once, the maps compose by a parallel prefix scan, and a second run
from the true states reads the output off.

Level two is a deterministic transducer over the characters of a piece. What the merges
emit for a piece isn't settled before its end, so inner transitions emit nothing, and the
transition that leads from a piece's last state back to the first one is annotated with
the number of tokens. The merges' whole automaton would have a state for every start of
every piece there can be, so it is compiled as texts reach it: new transitions make new
states, and a new end's tokens are counted once, from the tokenizer's merges (see merges;
by the tokenizers library where a tokenizer has more than merges, and for long pieces).
All pieces of a batch take a step at a time. States live in a table of fixed size that starts anew when half
full; pieces over LONGEST characters are one transition, in the table of whole pieces.

Where ids are asked for, a second table of fixed size, with WAYS places for a hash, keeps
those of whole pieces. It compares a piece's key, which holds the bytes themselves up to 15 of
them and a 128-bit digest beyond (see words), never a plain hash.

Special strings inside texts are single tokens, as the library's default has it.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa

from .merges import MOST, Merges
from .words import buffers, key_hashes, range_keys

CHUNK = 256
TABLE_BITS, WAYS, POOL, LINES = 21, 4, 1 << 23, 2000
STATE_BITS, LONGEST, GROUP = 21, 64, 1 << 18

# character classes
END, LETTER, STMD, RV, ELL, E, NUMBER, SPACE, BLANK, QUOTE, MARK = range(11)
# states: between pieces, in letters, numbers or marks, behind a quote that starts a piece,
# that and r or v, that and l, in one space, in a run ending in a space, in one other blank, in a run ending in one
FRESH, IN_L, IN_N, IN_M, IN_Q, IN_QR, IN_QL, SP, SPS, BL, BLS = range(11)
HERE, BEFORE = 1, 2
_STARTS = {**dict.fromkeys((LETTER, STMD, RV, ELL, E), IN_L), NUMBER: IN_N, SPACE: SP, BLANK: BL, QUOTE: IN_Q, MARK: IN_M}


def _step(state: int, c: int) -> tuple[int, int]:
    """The next state, and where a piece starts."""
    if state in (IN_QR, IN_QL):
        if c == (E if state == IN_QR else ELL):
            return FRESH, 0
        to, out = _step(IN_L, c)
        return to, out | BEFORE
    if c == END:
        return FRESH, 0
    kind = _STARTS[c]
    if state in (SP, SPS, BL, BLS):
        if c == SPACE:
            return SPS, 0
        if c == BLANK:
            return BLS, 0
        late = BEFORE if state in (SPS, BLS) else 0
        if state in (SP, SPS):  # the space leads the piece
            return (IN_M if c == QUOTE else kind), late
        return kind, HERE | late
    if state == IN_Q:
        if c in (STMD, RV, ELL):
            return {STMD: FRESH, RV: IN_QR, ELL: IN_QL}[c], 0
        if c in (QUOTE, MARK):
            return IN_M, 0
    if state == IN_M and c in (QUOTE, MARK) or state == kind and state in (IN_L, IN_N):
        return state, 0
    return kind, HERE


_N = 11
_NEXT = np.array([_step(s, c)[0] for s in range(_N) for c in range(_N)], dtype=np.uint8)
_OUT = np.array([_step(s, c)[1] for s in range(_N) for c in range(_N)], dtype=np.uint8)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    found = np.full(0x110000, MARK, dtype=np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    text = "".join(map(chr, points))
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, text):
            found[points[m.start() : m.end()]] = c
    found[0x1C:0x20] = MARK  # separators that Python counts as white space and Unicode doesn't
    for chars, c in (("stmd", STMD), ("rv", RV), ("l", ELL), ("e", E), (" ", SPACE), ("'", QUOTE)):
        found[[ord(x) for x in chars]] = c
    return found


def run(symbols: np.ndarray) -> np.ndarray:
    """Outputs of the transducer for a sequence of classes, from FRESH on."""
    n = -(-len(symbols) // CHUNK)
    if n == 0:
        return np.zeros(0, np.uint8)
    padded = np.zeros(n * CHUNK, np.uint8)
    padded[: len(symbols)] = symbols
    cells = np.ascontiguousarray(padded.reshape(n, CHUNK).T)
    maps = np.repeat(np.arange(_N, dtype=np.uint8)[:, None], n, axis=1)
    for c in cells:
        maps = _NEXT[maps * np.uint8(_N) + c]
    reach = 1  # maps[:, k] leads through chunks k - reach + 1 .. k
    while reach < n:
        joined = maps.copy()
        joined[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach], axis=0)
        maps, reach = joined, reach * 2
    state = np.zeros(n, np.uint8)
    state[1:] = maps[FRESH, :-1]
    out = np.empty((CHUNK, n), np.uint8)
    for i, c in enumerate(cells):
        at = state * np.uint8(_N) + c
        out[i] = _OUT[at]
        state = _NEXT[at]
    return out.T.reshape(-1)[: len(symbols)]


def _resets(raw: bytes, offsets: np.ndarray, special: bytes | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Where texts start and special strings start and end, and the special strings' places; those across two texts don't count."""
    resets, inside, at = [offsets[offsets < len(raw)]], [], raw.find(special) if special else -1
    while at >= 0:
        end = at + len(special)
        if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, end - 1, "right"):
            resets.append(np.array([at, end] if end < len(raw) else [at]))
            inside.append((at, end))
            at = raw.find(special, end)
        else:
            at = raw.find(special, at + 1)
    return np.unique(np.concatenate(resets)), inside


def pieces(data: np.ndarray, offsets: np.ndarray, special: bytes | None) -> np.ndarray:
    """Byte positions at which pieces start, by the transducer; data is valid UTF-8, texts start at offsets."""
    if not len(data):
        return np.zeros(0, np.int64)
    raw = data.tobytes()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    symbols = classes()[np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)]
    resets, inside = _resets(raw, offsets, special)
    cuts = np.searchsorted(lead, resets)
    place = np.arange(len(lead)) + np.searchsorted(cuts, np.arange(len(lead)), "right")
    full = np.zeros(len(lead) + len(cuts) + 1, np.uint8)
    full[place] = symbols
    out = run(full)
    starts = (out & HERE).astype(bool)
    starts[:-1] |= (out[1:] & BEFORE).astype(bool)
    starts = lead[starts[place]]
    for at, end in inside:
        starts = starts[(starts <= at) | (starts >= end)]
    return starts


_KINDS = np.array([0, 1, 1, 1, 1, 1, 2, 4, 5, 3, 3], dtype=np.uint8)  # letters 1, numbers 2, marks 3, space 4, other blanks 5
_SHORT = re.compile(rb"'(?:s|t|re|ve|m|ll|d)")


@functools.cache
def _kinds() -> np.ndarray:
    return _KINDS[classes()]


def compared(data: np.ndarray, offsets: np.ndarray, special: bytes | None) -> np.ndarray:
    """The same positions as pieces(), by comparing each character with its neighbours; contractions are put right one by one."""
    if not len(data):
        return np.zeros(0, np.int64)
    raw = data.tobytes()
    kind = _kinds()[np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)]
    one_byte = len(kind) == len(data)
    lead = None if one_byte else np.flatnonzero((data & 0xC0) != 0x80)
    resets, inside = _resets(raw, offsets, special)
    cuts = resets if one_byte else np.searchsorted(lead, resets)
    before, after = np.zeros(len(kind), np.uint8), np.zeros(len(kind), np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[cuts] = 0
    after[cuts[cuts > 0] - 1] = 0
    blank, beside = kind >= 4, before < 4
    first = (blank & (beside | ((after < 4) & (after > 0)))) | (~blank & ((before == 5) | (beside & (before != kind))))
    starts = np.zeros(len(data), bool)
    starts[np.flatnonzero(first) if one_byte else lead[first]] = True
    ends = np.append(resets, len(data))
    for m in _SHORT.finditer(raw):
        at, end = m.span()
        if starts[at]:
            stop = ends[np.searchsorted(ends, at, "right")]
            if end <= stop:
                starts[at + 1] = False
                if end < stop:
                    starts[end] = True
    for at, end in inside:
        starts[at + 1 : end] = False
    return np.flatnonzero(starts)


def _utf32(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)


class Tokenizer:
    """A tokenizers file; ids and counts of whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = special[0].encode() if special else None
        self.merges = Merges.of(self.library)
        (self.line_end,) = self.library.encode("\n", add_special_tokens=False).ids
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.keys = None  # the table of whole pieces
        self.states = None  # the states of level two

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of tokens of pieces, and all their ids; the order in which both come."""
        raw = memoryview(data)
        size = ends - starts
        long = np.full(len(starts), True) if self.merges is None else size > MOST
        if self.special is not None:
            for i in np.flatnonzero(size == len(self.special)):
                long[i] |= raw[starts[i] : ends[i]] == self.special
        short, rest = np.flatnonzero(~long), np.flatnonzero(long)
        counts, flat = self.merges.encode(data, starts[short], ends[short]) if len(short) else (np.zeros(0, np.int64), np.zeros(0, self.kind))
        if len(rest):
            more, ids, order = self._encoded([str(raw[s:e], "utf-8") for s, e in zip(starts[rest].tolist(), ends[rest].tolist())])
            counts, flat, rest = np.concatenate([counts, more]), np.concatenate([flat.astype(self.kind), ids]), rest[order]
        return counts, flat.astype(self.kind), np.concatenate([short, rest])

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of tokens of strings that hold no line end, or only blanks, and all their ids; the order in which both come."""
        # strings that end in no blank stay pieces of their own on the lines of a text, and one call encodes many
        alone = np.fromiter((t[-1].isspace() for t in texts), bool, len(texts))
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        plain = [texts[i] for i in order[: len(order) - alone.sum()]]
        blocks = ["\n".join(plain[i : i + LINES]) + "\n" for i in range(0, len(plain), LINES)]
        found = [np.array(x.ids, self.kind) for x in self.library.encode_batch_fast(blocks, add_special_tokens=False)]
        lines = np.concatenate([np.zeros(0, self.kind), *found])
        ends = np.flatnonzero(lines == self.line_end)
        counts, flat = np.diff(ends, prepend=-1) - 1, lines[lines != self.line_end]
        if alone.any():
            found = [x.ids for x in self.library.encode_batch_fast([texts[i] for i in np.flatnonzero(alone)], add_special_tokens=False)]
            counts = np.concatenate([counts, np.fromiter(map(len, found), np.int64, len(found))])
            flat = np.concatenate([flat, np.fromiter((i for x in found for i in x), self.kind)])
        if len(counts) != len(texts):
            raise RuntimeError("the tokenizer doesn't cut lines as its pattern says")
        return counts, flat, order

    def _learn(self, data: np.ndarray, a: np.ndarray, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> None:
        """Encode pieces with keys a, b and put them in the table at slots of their own."""
        counts, flat, order = self._encode(data, starts, ends)
        a, b, slot = a[order], b[order], slot[order]
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(flat), len(self.pool) // 2), self.kind)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.keys[slot, 0], self.keys[slot, 1] = a, b
        self.spans[slot] = self.used + np.cumsum(counts) - counts << 32 | counts
        self.used += len(flat)

    @staticmethod
    def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (key_hashes(a, b) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _looked_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of pieces, and where the ids of each begin in the pool. A pool that is nearly full starts anew before."""
        if self.keys is None or self.used > POOL - POOL // 8:
            self.keys = np.zeros((1 << TABLE_BITS, 2), np.uint64)
            self.spans = np.zeros(1 << TABLE_BITS, np.int64)  # place in the pool << 32 | count
            self.pool, self.used = np.zeros(POOL, self.kind), 0
        a, b = range_keys(data, starts, ends)
        slots = self._slots(a, b)
        spans = np.zeros(len(starts), np.int64)
        todo = np.arange(len(starts))
        while len(todo):  # pieces that share a slot take turns
            for way in range(WAYS):
                slot = slots[todo] ^ way
                # both numbers of a key by one look, as 16 bytes
                kept = self.keys.view(np.complex128)[slot, 0].view(np.uint64)
                first = way == 0 and len(todo) == len(a)
                hit = (kept[::2] == (a if first else a[todo])) & (kept[1::2] == (b if first else b[todo]))
                got = np.flatnonzero(hit)
                spans[todo[got]] = self.spans[slot[got]]
                todo = todo[~hit]
                if not len(todo):
                    break
            else:
                slot = slots[todo]
                for way in range(1, WAYS):  # the first place that is empty, else the first
                    slot = np.where((self.keys[slot, 1] != 0) & (self.keys[slots[todo] ^ way, 1] == 0), slots[todo] ^ way, slot)
                _, alone = np.unique(slot, return_index=True)  # of pieces that share a slot the first
                new = todo[alone]
                self._learn(data, a[new], b[new], starts[new], ends[new], slot[alone])
        return spans & 0xFFFFFFFF, spans >> 32

    def ids(self, column: pa.Array, cut=None) -> tuple[np.ndarray, np.ndarray]:
        """Per text the number of its tokens, and all ids one after the other. cut: pieces or compared."""
        data, offsets = buffers(_valid(column))
        starts = (cut or compared)(data, offsets, self.special)
        ends = np.append(starts[1:], len(data)).astype(np.int64) if len(starts) else starts
        count, place = self._looked_up(data, starts, ends)
        total = np.concatenate([[0], np.cumsum(count)])
        flat = self.pool[np.repeat(place - total[:-1], count) + np.arange(total[-1])]
        return np.diff(total[np.searchsorted(starts, offsets)]), flat

    def _reset(self) -> None:
        """Level two with its first state only. A state's key is the state before it and a character; `emits` annotates the transition from it back to the first state, 0 where none is known."""
        self.states, self.emits = np.zeros(1 << STATE_BITS, np.int64), np.zeros(1 << STATE_BITS, np.int32)
        self.n_states = 0

    def _moved(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states behind states (-1: the first) by characters c."""
        last = (1 << STATE_BITS) - 1
        key = (state + 2) << 21 | c
        slot = (key * 0x1E3779B97F4A7C15 >> 63 - STATE_BITS) & last
        todo = np.flatnonzero(self.states[slot] != key)
        while len(todo):  # by the place of its key, and the next ones while others stand there
            free = todo[self.states[slot[todo]] == 0]
            # of keys that claim one place the last gets it
            self.states[slot[free]] = key[free]
            todo = todo[self.states[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & last
            todo = todo[self.states[slot[todo]] != key[todo]]
        return slot

    def _run(self, chars: np.ndarray, first: np.ndarray, size: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Token counts of pieces, the longest first, of about GROUP characters together: first, size in characters, starts, stops in bytes."""
        if self.states is None or self.n_states > (1 << STATE_BITS) // 2:
            self._reset()
        ends = np.empty(len(first), np.int64)
        state = np.full(len(first), -1)
        for k in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -k, "left"))
            state = self._moved(state[:n], chars[first[:n] + k].astype(np.int64))
            ends[:n] = state
        new, one = np.unique(ends[self.emits[ends] == 0], return_index=True)
        if len(new):
            lanes = np.flatnonzero(self.emits[ends] == 0)[one]
            counts, _, order = self._encode(data, starts[lanes], stops[lanes])
            self.emits[new[order]] = counts
            self.n_states = int(np.count_nonzero(self.states))
        return self.emits[ends]

    def counts(self, column: pa.Array) -> np.ndarray:
        """Per text the number of its tokens, by the two transducers alone but for very long pieces."""
        data, offsets = buffers(_valid(column))
        starts = pieces(data, offsets, self.special)
        if not len(starts):
            return np.zeros(len(column), np.int64)
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        chars = _utf32(data)
        if len(chars) == len(data):
            first, last = starts, ends
        else:
            lead = np.cumsum((data & 0xC0) != 0x80)
            first, last = lead[starts] - 1, np.append(lead[starts[1:]] - 1, len(chars))
        size = last - first
        total = np.zeros(len(starts), np.int64)
        long = np.flatnonzero(size > LONGEST)
        if len(long):
            total[long], _ = self._looked_up(data, starts[long], ends[long])
        order = np.flatnonzero(size <= LONGEST)
        order = order[np.argsort(LONGEST - size[order].astype(np.uint8), kind="stable")]
        group = np.cumsum(size[order]) // GROUP
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
            own = order[lo:hi]
            total[own] = self._run(chars, first[own], size[own], data, starts[own], ends[own])
        run_ = np.concatenate([[0], np.cumsum(total)])
        return np.diff(run_[np.searchsorted(starts, offsets)])


def _valid(column: pa.Array) -> pa.Array:
    """Bytes that aren't UTF-8 become U+FFFD, as any reader of text makes them."""
    data, _ = buffers(column)
    try:
        data.tobytes().decode("utf-8")
        return column
    except UnicodeDecodeError:
        raw = column.cast(pa.large_binary()).to_pylist()
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw], pa.large_string())


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One for each worker process."""
    return Tokenizer(path)
