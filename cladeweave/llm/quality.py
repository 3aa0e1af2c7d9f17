"""Quality rules: counts that any text must stand, and how far a text is from its language.

A document is kept when it passes the base counts (enough words, few of them in repeated
windows) and its histograms of character classes and of common words are near those of
its language, by the Jensen-Shannon distance (the root of the divergence in bits, 0 to 1).

The references come from all documents that pass the base counts, language by language:
for each character class the median of the documents' shares (in steps of 1 / STEPS, so
that junk that many documents share doesn't move it), and the shares of the language's
COMMON most frequent words (each at least one in RAREST) and of all others together. A language has a reference if it
has at least LEAST_SHARE of all words, so there are at most 1 / LEAST_SHARE of them and
what is broadcast is bounded. Ties among frequent words go by the word.

Guards: the fewer characters or words a text has, the farther it is by chance alone. So a
text may be sqrt(far ** 2 + noise / size) apart, a text of under LEAST_CHARS characters
isn't judged by its characters, one of under LEAST_TERMS words not by its words, and one
whose language has no reference (a null language too) by neither: what isn't judged is
kept if it passes the base counts.

Words of the base counts are runs of non-blanks as they stand. Words of the histograms
are runs of digits, letters and non-ASCII characters with A-Z lower-cased. Repeated
windows are found by hashes and confirmed word by word.

Defined results: null and empty texts have no words and fail. Whole texts count, however
long. Rows that repeat are judged alike. Extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, small_batches, written
from .terms import ALNUM, CONTINUES, LEAD, Tally, lower, runs, strings
from .words import buffers, gram_hashes, key_hashes, mix, range_keys, word_bounds

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: A language's common words: how many at most, and at least one of so many of its words each. The share of all words that a language with a reference has.
COMMON, RAREST, LEAST_SHARE = 200, 5000, 1 / 1000
LEAST_CHARS, LEAST_TERMS, STEPS = 200, 100, 1000
#: How far texts may be from their language (distance of a long one; what a short one's size adds), by characters and by words.
CHARS_APART, WORDS_APART = (0.14, 20.0), (0.25, 30.0)

#: Character classes, in the order of the histograms.
CLASSES = ["vowel", "consonant", "upper", "digit", "blank", "line", "stop", "symbol", "ascii", "latin", "other"]
_CLASS = np.full(256, CLASSES.index("ascii"), np.uint8)
for _name, _members in (("vowel", b"aeiou"), ("consonant", b"bcdfghjklmnpqrstvwxyz"), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("blank", b" \t"), ("line", b"\n"), ("stop", b".,;:!?'\"()-"), ("symbol", b"#*$%&|<>")):
    _CLASS[list(_members)] = CLASSES.index(_name)
_CLASS[0x80:] = CLASSES.index("other")
_CLASS[LEAD] = CLASSES.index("latin")
_BLANKS = b" \t\n\x0b\x0c\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_KINDS = "doc_id BIGINT, " + ", ".join(f"{c} BIGINT" for c in BASE) + ", base_failed BOOLEAN"
JUDGED = _KINDS + ", chars_apart DOUBLE, words_apart DOUBLE, kept BOOLEAN"


def repeated(a: np.ndarray, b: np.ndarray, at: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Which words (keys a, b; texts start at `at`) stand in a window of words that their text holds twice or more."""
    n = len(a)
    marked = np.zeros(n, bool)
    if n < width:
        return marked
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    here = np.flatnonzero(np.arange(n - width + 1) + width <= at[1:][text[: n - width + 1]])
    told = mix(gram_hashes(key_hashes(a, b), width)[here] + mix(text[here].astype(np.uint64) + np.uint64(1)))
    slot = (told >> np.uint64(44)).astype(np.int64)
    some = np.bincount(slot, minlength=1)[slot] > 1  # what is alone in its slot is found once
    told, here = told[some], here[some]
    order = np.argsort(told, kind="stable")
    told, here = told[order], here[order]
    alike = np.flatnonzero(told[1:] == told[:-1])
    one, two = here[alike], here[alike + 1]
    if not all((a[one + d] == a[two + d]).all() and (b[one + d] == b[two + d]).all() for d in range(width)) or not (text[one] == text[two]).all():
        return _plainly(a, b, at, width)
    edge = np.zeros(n + 1, np.int64)
    starts = np.unique(np.concatenate([one, two]))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _plainly(a: np.ndarray, b: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """As repeated, without hashes."""
    marked = np.zeros(len(a), bool)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        words, seen = list(zip(a[lo:hi].tolist(), b[lo:hi].tolist())), {}
        for k in range(hi - lo - width + 1):
            seen.setdefault(tuple(words[k : k + width]), []).append(lo + k)
        for places in seen.values():
            if len(places) > 1:
                for p in places:
                    marked[p : p + width] = True
    return marked


class Profile:
    """The counts of a column of texts: base counts, character classes, and where the terms stand."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = buffers(column)
        data, offsets = self.data, self.offsets
        n = len(offsets) - 1
        held = np.zeros((n, 256), np.int64)
        for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            held[i] = np.bincount(data[lo:hi], minlength=256)
        starts, ends = word_bounds(data, offsets)
        at = np.searchsorted(starts, offsets, side="left")
        again = np.concatenate([[0], np.cumsum(repeated(*range_keys(data, starts, ends), at))])
        self.chars = held[:, ~CONTINUES].sum(axis=1)
        self.base = {
            "n_words": np.diff(at), "word_chars": self.chars - held[:, list(_BLANKS)].sum(axis=1), "n_symbols": held[:, _CLASS == CLASSES.index("symbol")].sum(axis=1),
            "n_dup_lines": self._dup_lines(), "n_repeat_words": np.diff(again[at]),
        }
        self.failed = (self.base["n_words"] < LEAST_WORDS) | (100 * self.base["n_repeat_words"] > MOST_REPEATED * self.base["n_words"])
        self.classes = np.stack([held[:, (_CLASS == k) & ~CONTINUES].sum(axis=1) for k in range(len(CLASSES))], axis=1)
        lead = np.flatnonzero(data == LEAD)
        upper = lead[data[lead + 1] < 0x9F]  # U+00C0 to U+00DE
        moved = np.bincount(np.searchsorted(offsets, upper, side="right") - 1, minlength=n)
        self.classes[:, CLASSES.index("upper")] += moved
        self.classes[:, CLASSES.index("latin")] -= moved
        self.starts, self.ends, self.lower = *runs(ALNUM[data], offsets), lower(data)
        self.at = np.searchsorted(self.starts, offsets, side="left")

    def _dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line, text by text."""
        found, raw = [], self.data.tobytes()
        for lo, hi in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            lines = [x for x in raw[lo:hi].split(b"\n") if x.strip(_BLANKS)]
            found.append(len(lines) - len(set(lines)))
        return np.array(found, np.int64)

    def terms(self, chosen: np.ndarray | None = None) -> pa.Array:
        """The terms of all texts, or of the texts chosen, one after the other."""
        starts, ends = self.starts, self.ends
        if chosen is not None:
            own = np.repeat(chosen, np.diff(self.at))
            starts, ends = starts[own], ends[own]
        return strings(self.lower, starts, ends)

    def columns(self, ids: pa.Array) -> list[pa.Array]:
        return [ids, *[pa.array(self.base[c].astype(np.int64)) for c in BASE], pa.array(self.failed)]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and base_failed of every row."""

    def run(batches):
        for piece in slices(batches):
            yield pa.RecordBatch.from_arrays(Profile(piece.column("text")).columns(piece.column("doc_id")), ["doc_id", *BASE, "base_failed"])

    small_batches(docs.sparkSession)
    return _rows(docs).mapInArrow(run, _KINDS)


def _told(lang: str, rows, step: pa.Array | None = None) -> pa.RecordBatch:
    n = len(rows["name"])
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), rows["name"].cast(pa.string()), pa.nulls(n, pa.int32()) if step is None else step, rows["n"]], ["lang", "name", "step", "n"])


def corpus_counts(docs: DataFrame) -> DataFrame:
    """lang, name, step, n over all documents that pass the base counts: how often each word stands in them (step null), and how many of them have each step of a character class's share; tasks add up their own before the shuffle."""

    def run(batches):
        words, steps_of = {}, {}
        for piece in slices(batches):
            profile = Profile(piece.column("text"))
            langs = piece.column("lang").to_pylist()
            steps = profile.classes * STEPS // np.maximum(profile.chars, 1)[:, None]
            for lang in sorted({x for x, bad in zip(langs, profile.failed) if x is not None and not bad}):
                own = np.array([x == lang for x in langs]) & ~profile.failed
                found = profile.terms(own).value_counts()
                for told in words.setdefault(lang, Tally(["name"])).add(pa.table({"name": found.field("values"), "n": found.field("counts")})):
                    yield _told(lang, told)
                held = steps_of.setdefault(lang, np.zeros((len(CLASSES), STEPS + 1), np.int64))
                for k in range(len(CLASSES)):
                    held[k] += np.bincount(steps[own & (profile.chars >= LEAST_CHARS), k], minlength=STEPS + 1)
        for lang, tally in words.items():
            for told in tally.rest():
                yield _told(lang, told)
            kind, step = np.nonzero(steps_of[lang])
            names = pa.array([CLASSES[k] for k in kind], pa.large_string())
            yield _told(lang, {"name": names, "n": pa.array(steps_of[lang][kind, step])}, pa.array(step.astype(np.int32)))

    counted = _rows(docs).mapInArrow(run, "lang STRING, name STRING, step INT, n BIGINT")
    return counted.groupBy("lang", "name", "step").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """lang, kind (class or word), name, value: for each language that has a reference the classes' median steps, and the counts of its `common` most frequent words and (name null) of all words."""
    small_batches(docs.sparkSession)
    counts = written(corpus_counts(docs), shared_dir(docs.sparkSession), "corpus_counts")
    words = counts.where("step IS NULL")
    totals = words.groupBy("lang").agg(F.sum("n").alias("value"))
    every = totals.agg(F.sum("value").alias("every"))
    large = totals.crossJoin(every).where(F.col("value") >= F.col("every") * LEAST_SHARE).select("lang", "value")
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "name")  # at most `common` rows of a language leave a task
    top = words.withColumn("place", F.row_number().over(first)).where(F.col("place") <= common)
    top = top.join(F.broadcast(large), "lang").where(F.col("n") * RAREST >= F.col("value")).drop("value")
    # STEPS rows at most for each class: the first step up to which half of the documents are
    ahead = Window.partitionBy("lang", "name").orderBy("step")
    steps = counts.where("step IS NOT NULL").withColumn("upto", F.sum("n").over(ahead)).withColumn("all", F.sum("n").over(Window.partitionBy("lang", "name")))
    medians = steps.where("2 * upto >= all").groupBy("lang", "name").agg(F.min("step").cast("long").alias("value"))
    told = lambda df, kind, name, value: df.select("lang", F.lit(kind).alias("kind"), name.cast("string").alias("name"), F.col(value).alias("value"))
    rows = told(top, "word", F.col("name"), "n").unionByName(told(totals, "word", F.lit(None), "value")).unionByName(told(medians, "class", F.col("name"), "value"))
    return rows.join(large.select("lang"), "lang", "left_semi")


class Languages:
    """The references of all languages, as each task needs them: at most 1 / LEAST_SHARE languages of COMMON words."""

    def __init__(self, rows: list):
        self.classes, self.words, self.shares, total = {}, {}, {}, {r.lang: r.value for r in rows if r.name is None}
        for r in sorted((r for r in rows if r.name is not None), key=lambda r: (r.lang, -r.value, r.name)):
            if r.kind == "class":
                self.classes.setdefault(r.lang, np.zeros(len(CLASSES)))[CLASSES.index(r.name)] = r.value
            else:
                self.words.setdefault(r.lang, []).append(r.name)
                self.shares.setdefault(r.lang, []).append(r.value / total[r.lang])
        self.classes = {k: v / v.sum() for k, v in self.classes.items()}
        self.shares = {k: np.array([*v, max(0.0, 1 - math.fsum(v))]) for k, v in self.shares.items()}
        self.words = {k: pa.array(v, pa.large_string()) for k, v in self.words.items()}


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of histograms (rows of counts) from a reference (shares)."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    middle = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / middle), 0.0).sum(axis=1) for x in (p, np.broadcast_to(reference, p.shape))]
    return np.sqrt(np.clip((parts[0] + parts[1]) / 2, 0.0, 1.0))


def judged(piece: pa.RecordBatch, known: Languages, by_chars: tuple[float, float], by_words: tuple[float, float]) -> pa.RecordBatch:
    profile = Profile(piece.column("text"))
    n = piece.num_rows
    langs = piece.column("lang").to_pylist()
    chars, words = np.full(n, np.nan), np.full(n, np.nan)
    terms = np.diff(profile.at)
    for lang in sorted({x for x in langs if x in known.classes or x in known.words}):
        own = np.array([x == lang for x in langs])
        long = own & (profile.chars >= LEAST_CHARS)
        if long.any() and lang in known.classes:
            chars[long] = distances(profile.classes[long], known.classes[lang])
        many = own & (terms >= LEAST_TERMS)
        if many.any() and lang in known.words:
            common, rows = len(known.words[lang]), int(many.sum())
            place = pa.compute.fill_null(pa.compute.index_in(profile.terms(many), known.words[lang]), common).to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(rows), terms[many])
            counts = np.bincount(text * (common + 1) + place, minlength=rows * (common + 1)).reshape(rows, common + 1)
            words[many] = distances(counts, known.shares[lang])
    allowed = lambda far, noise, size: np.sqrt(far * far + noise / np.maximum(size, 1))
    kept = ~profile.failed & ~(chars > allowed(*by_chars, profile.chars)) & ~(words > allowed(*by_words, terms))
    apart = [pa.array(x, from_pandas=True) for x in (chars, words)]  # not a number: not judged
    return pa.RecordBatch.from_arrays([*profile.columns(piece.column("doc_id")), *apart, pa.array(kept)], ["doc_id", *BASE, "base_failed", "chars_apart", "words_apart", "kept"])


def quality(docs: DataFrame, by_chars: tuple[float, float] = CHARS_APART, by_words: tuple[float, float] = WORDS_APART, reference: DataFrame | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, chars_apart, words_apart (null where not judged) and kept of every row. reference: as references() gives it, from another corpus."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = (references(docs) if reference is None else reference).collect()  # bounded: see references()
    shared = spark.sparkContext.broadcast(Languages(rows))

    def run(batches):
        for piece in slices(batches):
            yield judged(piece, shared.value, by_chars, by_words)

    return _rows(docs).mapInArrow(run, JUDGED)
