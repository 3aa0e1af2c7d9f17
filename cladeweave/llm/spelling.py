"""Spelling variant grouping by rolling-hash deletions.

Words are counted over all texts. A word's form is the more frequent word, at least
`factor` times as frequent, that differs from it by one inserted, deleted or replaced
code point; following forms leads to its root.

Polynomial prefix and suffix hashes of a word give the hashes of all its deletions (the
word without one code point) in one numpy expression. Each is a row (key, rest, pos,
rank), and so is the whole word, at place WHOLE. Rows are dealt by the key's top bits and
sorted, so equal rests stand together, and these are the verified groups: `rest` is the
deletion itself, and equal keys of other rests part there. In a group

- two words differ by one replaced code point if they lack it at the same place. Such
  words are counted and their best one found by their number alone, with no pairs;
- a whole word and a deletion of another one differ by one inserted code point. A run of
  equal code points gives the same deletion at each of its places; only its first counts.

Two words near each other share one such group and place, so sums over groups count each
near word once. Ranks number the words by falling count, then in code-point order, so the
best near word is the one of the smallest rank. Groups hold at most as many rows as there
are letters to insert, so none outgrows a task, and a word in any number of texts is one row.

Roots come by pointer jumping: counts at least double from a word to its form, so a few
doublings of the pointers reach every root.

Rests of over LONG code points are told apart by 128-bit digests, so that a long word's
rows stay small; words of up to LONG are told apart by the rests themselves.

Defined results: null and empty texts have no words. A text counts with its own doc_id;
rows that repeat are counted each. A null doc_id stands as nothing before the colon of the
hash that picks the runs to shorten. Whole texts count, however long, and words of any
length. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finished, shared_dir, slices, small_batches, written
from .terms import CONTINUES, LATIN, LEAD, Tally, latin_letters, lower, runs, strings
from .words import buffers

LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: One run in so many, by its hash, loses a code point.
SHORTENED = 97
LONG, WHOLE = 64, -1
_PRIME = (1 << 31) - 1
_BASES = (1_103_515_245 % _PRIME, 1_812_433_253 % _PRIME)
KEYS = "key BIGINT, rest BINARY, pos INT, first BOOLEAN, rank BIGINT"
NEAR = "rank BIGINT, near BIGINT, best BIGINT"
_NONE = np.iinfo(np.int64).max
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):  # the table of CRC-32
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of data[starts:ends], each going on from a CRC-32 before it."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    long = int((size > LONG).sum())
    out = np.empty(len(size), np.uint32)
    raw = memoryview(data)
    for i in order[:long].tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]], int(before[i]))
    order = order[long:]
    at, left = starts[order], size[order]
    state = ~before[order].astype(np.uint32)
    for j in range(int(left.max(initial=0))):
        k = int(np.searchsorted(-left, -j, side="left"))  # those with more than j bytes come first
        state[:k] = _CRC[(state[:k] ^ data[at[:k] + j]) & 255] ^ (state[:k] >> 8)
    out[order] = ~state
    return out


def words_of(column: pa.Array, ids: list, shortened: int = SHORTENED, least: int = LEAST_LENGTH) -> pa.Array:
    """The words of all texts one after the other, lower-cased, a chosen few of them shortened; those of under `least` code points are left out."""
    data, offsets = buffers(column)
    starts, ends = runs(latin_letters(data), offsets)
    data = lower(data)
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    text = np.searchsorted(offsets, starts, side="right") - 1
    hashes = crcs(data, starts, ends, before[text])
    ahead = np.concatenate([[0], np.cumsum(CONTINUES[data])])
    size = ends - starts - (ahead[ends] - ahead[starts])
    odd = hashes % np.uint32(shortened) == 0
    raw, short = data.tobytes() if odd.any() else b"", []
    for s, e, h in zip(starts[odd].tolist(), ends[odd].tolist(), hashes[odd].tolist()):
        word = raw[s:e].decode()
        at = h % len(word)
        word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            short.append(word)
    plain = ~odd & (size >= least)
    return pa.concat_arrays([strings(data, starts[plain], ends[plain]), pa.array(short, pa.large_string())])


def word_counts(docs: DataFrame, least_count: int = LEAST_COUNT, shortened: int = SHORTENED, least: int = LEAST_LENGTH) -> DataFrame:
    """word, n of the words that occur often enough; tasks add up their own counts before the shuffle."""

    def run(batches):
        tally = Tally(["word"])
        for piece in slices(batches):
            found = words_of(piece.column("text"), piece.column("doc_id").to_pylist(), shortened, least).value_counts()
            yield from tally.add(pa.table({"word": found.field("values"), "n": found.field("counts")}))
        yield from tally.rest()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def ranked(words: DataFrame) -> DataFrame:
    """words with rank: a number that grows in the order of falling count, then of the word."""
    return words.repartitionByRange(F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word").withColumn("rank", F.monotonically_increasing_id())


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as one byte a code point, and their offsets."""
    data, offsets = buffers(column)
    second = np.concatenate([[False], data[:-1] == LEAD])
    kept = data != LEAD
    at = np.concatenate([[0], np.cumsum(kept)])
    return np.where(second, data + np.uint8(LATIN), data)[kept], at[offsets]


def deletion_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length (rows of a matrix): the key of each without its i-th code point, and the key of each whole."""
    m, length = words.shape
    keys, whole = np.zeros((m, length), np.int64), np.zeros(m, np.int64)
    values = words.astype(np.int64) + 1
    for base in _BASES:
        power = np.ones(length + 1, np.int64)
        for j in range(length):
            power[j + 1] = power[j] * base % _PRIME
        prefix, suffix = np.zeros((m, length + 1), np.int64), np.zeros((m, length + 1), np.int64)
        for j in range(length):
            prefix[:, j + 1] = (prefix[:, j] * base + values[:, j]) % _PRIME
            suffix[:, length - 1 - j] = (values[:, length - 1 - j] * power[j] + suffix[:, length - j]) % _PRIME
        found = (prefix[:, :-1] * power[length - 1 :: -1] + suffix[:, 1:]) % _PRIME
        keys, whole = keys << 31 | found, whole << 31 | prefix[:, -1]
    return keys, whole


def _rests(row: bytes) -> list[bytes]:
    """A word without each of its code points in turn, and the word; long ones as digests."""
    every = [row[:i] + row[i + 1 :] for i in range(len(row))] if len(row) <= LONG + 1 else (row[:i] + row[i + 1 :] for i in range(len(row)))
    return [x if len(x) <= LONG else xxhash.xxh3_128_digest(x) for x in itertools.chain(every, [row])]


def key_rows(column: pa.Array, rank: np.ndarray):
    """Record batches of KEYS of words."""
    data, at = letters(column)
    size = np.diff(at)
    for length in np.unique(size).tolist():
        own = np.flatnonzero(size == length)
        step = max(1, 65_536 // (length + 1))
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            words = data[at[part][:, None] + np.arange(length)]
            keys, whole = deletion_keys(words)
            first = np.ones(words.shape, bool)
            first[:, 1:] = words[:, 1:] != words[:, :-1]
            everywhere = np.concatenate([np.arange(length), [WHOLE]]).astype(np.int32)
            columns = [
                pa.array(np.concatenate([keys, whole[:, None]], axis=1).reshape(-1)),
                pa.array([x for row in words for x in _rests(row.tobytes())], pa.binary()),
                pa.array(np.tile(everywhere, len(part))),
                pa.array(np.concatenate([first, np.zeros((len(part), 1), bool)], axis=1).reshape(-1)),
                pa.array(np.repeat(rank[part], length + 1)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "rest", "pos", "first", "rank"])


def _near_rows(table: pa.Table) -> pa.RecordBatch:
    """NEAR of whole groups of rows sorted by key, rest, pos and rank."""
    key, pos, rank = (table.column(c).to_numpy() for c in ("key", "pos", "rank"))
    first = table.column("first").to_numpy().astype(bool)
    rest = table.column("rest").combine_chunks()
    n = len(key)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | ~pc.equal(rest[1:], rest[:-1]).to_numpy(zero_copy_only=False)
    placed = new.copy()
    placed[1:] |= pos[1:] != pos[:-1]
    # words that lack a code point at the same place: all but the first have the first as their best
    starts = np.flatnonzero(placed)
    size = np.diff(np.append(starts, n))
    second = np.where(size > 1, rank[np.minimum(starts + 1, n - 1)], _NONE)
    of = np.cumsum(placed) - 1
    near, best = size[of] - 1, rank[starts][of]
    best[starts] = second
    whole = pos == WHOLE
    near[whole], best[whole] = 0, _NONE
    best[near == 0] = _NONE
    # a whole word and the words that have it as a deletion
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    inserted = np.add.reduceat(first.astype(np.int64), heads)
    least = np.minimum.reduceat(np.where(first, rank, _NONE), heads)
    known = np.minimum.reduceat(np.where(whole, rank, _NONE), heads)
    near[whole], best[whole] = inserted[group[whole]], least[group[whole]]
    met = first & (known[group] < _NONE)
    near[met] += 1
    best[met] = np.minimum(best[met], known[group[met]])
    some = near > 0
    return pa.RecordBatch.from_arrays([pa.array(rank[some]), pa.array(near[some].astype(np.int64)), pa.array(best[some])], ["rank", "near", "best"])


def near_counts(words: DataFrame) -> DataFrame:
    """rank, near (words one code point away), best (the smallest rank among them) of the words that have some."""

    def keys(batches):
        for batch in batches:
            yield from key_rows(batch.column("word"), batch.column("rank").to_numpy())

    def groups(batches):
        tail = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            last = table.column("key").to_numpy()
            cut = int(np.searchsorted(last, last[-1], side="left"))  # the last key may go on
            if cut:
                yield _near_rows(table.slice(0, cut))
            tail = table.slice(cut)
        if tail is not None and tail.num_rows:
            yield _near_rows(tail)

    rows = words.select("word", "rank").mapInArrow(keys, KEYS)
    dealt = rows.repartition(F.shiftrightunsigned("key", 50)).sortWithinPartitions("key", "rest", "pos", "rank")
    return dealt.mapInArrow(groups, NEAR).groupBy("rank").agg(F.sum("near").alias("near"), F.min("best").alias("best"))


def roots(forms: DataFrame, root: str) -> DataFrame:
    """rank, top: where the pointers (rank, form) end, by doubling them until none moves."""
    at = written(forms.select("rank", F.col("form").alias("top")), root, "tops_0")
    for k in itertools.count(1):
        ahead = at.select(F.col("rank").alias("top"), F.col("top").alias("next"))
        moved = written(at.join(ahead, "top", "left").select("rank", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("moved")), root, f"tops_{k}")
        at = moved.select("rank", "top")
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, factor: int = FACTOR, shortened: int = SHORTENED, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n, form, form_n, root, n_near of every word."""
    small_batches(docs.sparkSession)
    root = shared_dir(docs.sparkSession)
    words = written(ranked(written(word_counts(docs, least_count, shortened, least_length), root, "counts")), root, "words")
    near = written(near_counts(words), root, "near")
    other = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    told = words.join(near, "rank", "left").join(other, "best", "left")
    good = F.col("form_n") >= factor * F.col("n")
    told = told.select("rank", "word", "n", F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"), F.when(good, F.col("best")).alias("best"), F.coalesce("near", F.lit(0)).alias("n_near"))
    told = written(told, root, "told")
    tops = roots(told.where("best IS NOT NULL").select("rank", F.col("best").alias("form")), root)
    named = tops.join(words.select(F.col("rank").alias("top"), F.col("word").alias("root")), "top").select("rank", "root")
    rows = told.join(named, "rank", "left")
    return finished(rows.select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near"), root)
