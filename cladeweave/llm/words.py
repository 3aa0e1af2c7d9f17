"""Words and word shingles of Arrow text columns as numbers, by numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased. Its key is
two 64-bit numbers. Up to PACKED bytes the key holds the bytes themselves and their
number, so equal keys are equal words; a longer word's key is its 128-bit xxh3 digest
with a mark that no short word has. A word's hash is a 64-bit mix of its key. Neither
depends on where the word stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

PIECE, PACKED = 1 << 20, 15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_LONG = np.uint64(0xFF << 56)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of data[starts:ends], range by range: two arrays."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 9,), "<u8", buffer=padded, strides=(1,))
    size = ends - starts
    a = eights[starts] & _FIRST[np.minimum(size, 8)]
    rest = np.clip(size - 8, 0, 7)
    b = size.astype(np.uint64) << np.uint64(56)
    more = np.flatnonzero(rest)
    b[more] |= eights[starts[more] + 8] & _FIRST[rest[more]]
    long = np.flatnonzero(size > PACKED)
    if len(long):
        raw = memoryview(data)
        digests = b"".join([xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(starts[long].tolist(), ends[long].tolist())])
        both = np.frombuffer(digests, dtype=">u8").astype(np.uint64)
        a[long], b[long] = both[1::2], both[::2] | _LONG
    return a, b


def key_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a ^ mix(b + np.uint64(0x632BE59BD9B4E019)))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends], range by range."""
    return key_hashes(*range_keys(data, starts, ends))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray):
    """Ends of pieces of about PIECE bytes; each is a document's start or follows a blank."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            k = offsets[np.searchsorted(offsets, end, side="right") - 1]
            if k > at:
                end = int(k)
            else:
                stop = int(offsets[np.searchsorted(offsets, end, side="right")])
                while end < stop:
                    blank = np.flatnonzero(_BLANK[data[end : min(stop, end + PIECE)]])
                    if len(blank):
                        end += int(blank[0]) + 1
                        break
                    end = min(stop, end + PIECE)
        yield at, end
        at = end


def word_bounds(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; breaks: where texts start."""
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = breaks[breaks < len(data)]
    first[at] |= solid[at]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    at = at[at > 0] - 1
    last[at] |= solid[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_keys(column: pa.Array, stem: int = 0):
    """Keys (two arrays) of the words of all texts one after the other, and each text's offset among them.

    stem: also hashes of the words' first so many bytes, as a fourth array.
    """
    data, offsets = buffers(column)
    none = np.zeros(0, np.uint64)
    first, second, stems, starts = [none], [none], [none], [np.zeros(0, np.int64)]
    for lo, hi in _cuts(data, offsets):
        inside = offsets[(offsets >= lo) & (offsets < hi)] - lo
        s, e = word_bounds(data[lo:hi], inside)
        lower = _LOWER[data[lo:hi]]
        a, b = range_keys(lower, s, e)
        first.append(a)
        second.append(b)
        if stem:
            stems.append(range_hashes(lower, s, np.minimum(e, s + stem)))
        starts.append(s + lo)
    found = np.concatenate(first), np.concatenate(second), np.searchsorted(np.concatenate(starts), offsets, side="left")
    return (*found, np.concatenate(stems)) if stem else found


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and each text's offset among them."""
    a, b, at = word_keys(column)
    return key_hashes(a, b), at


def gram_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of all windows of `width` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, (width * 0x632BE59BD9B4E019 + salt) & (2**64 - 1), dtype=np.uint64)
    for j in range(width):
        total += words[j : j + n] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    return mix(total)


def shingle_sets(column: pa.Array, width: int = 5):
    """For each text the sorted distinct hashes of its shingles; a shorter text is one shingle, one without words none."""
    words, at = word_hashes(column)
    grams = gram_hashes(words, width)
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo >= width:
            yield np.unique(grams[lo : hi - width + 1])
        elif hi > lo:
            yield gram_hashes(words[lo:hi], int(hi - lo))
        else:
            yield grams[:0]
