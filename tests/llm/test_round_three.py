"""Ranked search, spelling variants and quality rules against brute-force versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cladeweave.llm import decontam, exact_dedup, neardup, quality, rangecoder, search, spelling
from cladeweave.llm.common import shared_dir
from cladeweave.llm.terms import Tally
from cladeweave.llm.words import range_keys

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, block INT, q INT, rank INT, n INT, word STRING, name STRING, key INT, kept INT, score INT"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def frame(spark, rows, schema=DOCS):
    """Rows of (id, text) or (id, text, lang) with columns whose names the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "x", 1, 2, 3, 4, "w", "m", 5, 6, 7) for r in rows], schema)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def odd_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "ñandú", "zeta7", "eta's", "theta.", "ÉTÉ", "日本", "the", "of", "x" * 40]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(n)]
    out += [(n, None), (n + 1, ""), (n + 2, " \n.,"), (3, out[3][1]), (3, out[3][1]), (None, out[5][1]), (None, "délta only here"), (-7, "alpha " * 3000), (n + 3, "délta only here"), (n + 4, "B" * 70_000 + " alpha")]
    return out


# --- ranked search


def ranked(rows, items, k=10):
    """item number -> [(score, ids of that score that may stand there)] as the contract says it, in whole numbers."""
    docs = [(i, re.findall(TERM, lower(t or ""))) for i, t in rows]
    docs = [(i, w) for i, w in docs if w]
    n, total = len(docs), sum(len(w) for _, w in docs)
    df = collections.Counter(t for _, w in docs for t in set(w))
    out = []
    for item_id, text in items:
        hits = []
        for i, w in docs:
            tf = collections.Counter(w)
            m = 100 - 90 + (90 * len(w) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in sorted(set(re.findall(TERM, lower(text or "")))) if tf[t])
            if score > 0:
                hits.append((-score, i is None, i or 0, i))
        out += [(item_id, r + 1, h[3], -h[0]) for r, h in enumerate(sorted(hits)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms, block_rows, pack_words", [(400_000, 2048, 10**6), (300, 20, 10**6), (60, 9, 40)])
def test_search(spark, block_terms, block_rows, pack_words, monkeypatch):
    monkeypatch.setattr(search, "FIRST", 1 if block_terms == 300 else 8)
    monkeypatch.setattr(search, "GROWTH", 4)
    rows = odd_rows(1, 60 if block_terms == 60 else 120)
    items = [(1, "alpha of délta"), (2, "ZETA7 zeta7 été"), (3, None), (4, ""), (5, "nowhere"), (None, "日本 the"), (6, "alpha"), (6, "alpha"), (7, "only here"), (8, "B" * 70_000)]
    bench = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], "item_id BIGINT, text STRING, q INT, copies INT, rank INT")
    docs = frame(spark, rows).repartition(3)
    got = [tuple(r) for r in search.search(docs, bench, block_terms=block_terms, block_rows=block_rows, pack_words=pack_words).collect()]
    assert sorted(got, key=str) == ranked(rows, items)


def test_search_reads_few_blocks(spark):
    # one item's words stand in one block only: after its first waves nothing else can reach the threshold
    rows = [(i, f"w{i % 5} w{i % 7} common") for i in range(2000)] + [(5000 + i, "needle needle w1") for i in range(12)]
    root = shared_dir(spark)
    index = search.SearchIndex.build(frame(spark, rows).coalesce(1), root, block_rows=1, block_terms=50)
    asked = []
    scored = index._scored
    index._scored = lambda chosen, shared, k: (asked.append(chosen.count()), scored(chosen, shared, k))[1]
    bench = spark.createDataFrame([(1, "needle common")], "item_id BIGINT, text STRING")
    got = [tuple(r) for r in index.search(bench, root).collect()]
    assert sorted(got, key=str) == ranked(rows, [(1, "needle common")])
    assert sum(asked) < index.index.count()
    again = search.SearchIndex(spark, root)  # a built index serves other searches
    assert again.n == len(rows) and again.search(bench, shared_dir(spark)).count() == 10


def test_search_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "alpha")], "item_id BIGINT, text STRING")
    docs = frame(spark, odd_rows(2))
    for d, b in ((docs.limit(0), bench), (docs, bench.limit(0)), (docs.where("text IS NULL"), bench)):
        found = search.search(d, b)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_terms_of_equal_hashes(monkeypatch):
    words = np.frombuffer(b"aabbccdd", np.uint8)
    a, b = range_keys(words, np.arange(0, 8, 2), np.arange(2, 9, 2))
    for hashes in (None, lambda a, b: np.zeros(len(a), np.uint64)):
        if hashes:
            monkeypatch.setattr(search, "key_hashes", hashes)
        first, second, place = search.distinct_terms(np.concatenate([a, a]), np.concatenate([b, b]))
        assert len(first) == 4 and (first[place] == np.concatenate([a, a])).all() and (second[place] == np.concatenate([b, b])).all()
        found = search.Terms(first[:3], second[:3]).among(first, second)
        assert sorted(found.tolist()) == [-1, 0, 1, 2]
        assert all(x < 0 or first[x] == first[i] for i, x in enumerate(found))


def test_shares_beyond_64_bits():
    sizes = np.array([1, 10**9, 7], np.int64)
    n, total = 10**12, 3 * 10**15
    assert search.shares(sizes, n, total).tolist() == [10 + 90 * x * n // total for x in sizes.tolist()]
    for numbers in ([0], [255, 3], [256], [70_000], [1 << 40], []):
        assert search.unpacked(search.packed(np.array(numbers, np.int64))).tolist() == numbers


# --- spelling variants


def words_counted(rows, shortened, least=5):
    out = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % shortened == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                out[run] += 1
    return out


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(rows, shortened=97, least_count=3, factor=2):
    n = {w: c for w, c in words_counted(rows, shortened).items() if c >= least_count}
    out, forms = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= factor * n[w] else None
        out[w] = len(others)
    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w
    return sorted((w, n[w], forms[w], None if forms[w] is None else n[forms[w]], root(w), out[w]) for w in n)


def spelled(seed):
    rng = random.Random(seed)
    base = ["hello", "letter", "mississippi", "élèves", "naïveté", "aaaaaa", "abababab", "straße", "x" * 70 + "y" * 30, "ab" * 45]
    made = []
    for w in base:
        count = rng.choice([60, 200])
        made += [w] * count
        for _ in range(12):
            v = list(w)
            for _ in range(rng.choice([1, 1, 2])):
                k = rng.randrange(len(v))
                how = rng.randrange(3)
                if how == 0 and len(v) > 1:
                    del v[k]
                elif how == 1:
                    v[k] = rng.choice("aelépxyÉ")
                else:
                    v.insert(k, rng.choice("aelépxyÉ"))
            made += ["".join(v)] * rng.choice([1, 3, 3, 7, 30, 30])
    rng.shuffle(made)
    rows = [(i, rng.choice([" ", ", ", "\n1"]).join(made[i * 40 : i * 40 + 40])) for i in range(len(made) // 40 + 1)]
    return rows + [(None, "hello HELLO hellp"), (None, None), (1000, ""), (4, rows[4][1]), (4, rows[4][1]), (1001, "q" * 80_000 + " 1")]


@pytest.mark.parametrize("seed, shortened", [(1, 97), (2, 5), (3, 2)])
def test_spelling_variants(spark, seed, shortened):
    rows = spelled(seed)
    got = [tuple(r) for r in spelling.variants(frame(spark, rows), shortened=shortened).select("word", "n", "form", "form_n", "root", "n_near").collect()]
    want = grouped(rows, shortened)
    assert sorted(got) == want and any(r[2] for r in want) and any(r[4] != r[2] for r in want if r[2])


def test_spelling_with_keys_that_collide(spark, monkeypatch):
    # every deletion of a length has one key: groups are told apart by the rests themselves
    def poor(words):
        m, length = words.shape
        return np.full((m, length), length, np.int64), np.full(m, length + 1, np.int64)

    rows = spelled(5)
    words = sorted(words_counted(rows, 97).items(), key=lambda x: (-x[1], x[0]))
    words = [w for w, c in words if c >= 3]
    monkeypatch.setattr(spelling, "deletion_keys", poor)
    tables = pa.Table.from_batches(list(spelling.key_rows(pa.array(words), np.arange(len(words)))))
    table = tables.sort_by([(c, "ascending") for c in ("key", "rest", "pos", "rank")])
    found = spelling._near_rows(table).to_pandas().groupby("rank").agg({"near": "sum", "best": "min"})
    for i, w in enumerate(words):
        others = [j for j, x in enumerate(words) if near(w, x)]
        assert (len(others), min(others, default=None)) == ((int(found.near[i]), int(found.best[i])) if i in found.index else (0, None))


def test_spelling_of_a_hot_word_and_of_nothing(spark):
    many = [(i, "commonword " * 30) for i in range(3000)] + [(5000 + i, f"comm{chr(97 + i % 26)}nword") for i in range(260)]
    got = {r.word: r for r in spelling.variants(frame(spark, many), shortened=10**9).collect()}
    assert got["commonword"].n == 90_010 and got["commonword"].n_near == 25 and got["commanword"].n_near == 25
    assert got["commanword"].form == "commonword" and got["commanword"].n == 10
    for docs in (frame(spark, many).limit(0), frame(spark, [(1, None), (2, "ab cd"), (3, "abcdef")])):
        found = spelling.variants(docs)
        assert found.count() == 0 and set(found.columns) == {"word", "n", "form", "form_n", "root", "n_near"}


def test_crc_goes_on():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 4000, 300))
    ends = starts + rng.integers(0, 200, 300)
    before = rng.integers(0, 1 << 32, 300).astype(np.uint32)
    got = spelling.crcs(data, starts, ends, before)
    assert got.tolist() == [zlib.crc32(data[s:e].tobytes(), int(b)) for s, e, b in zip(starts, ends, before)]


def test_tally_in_bounded_memory():
    tally, out = Tally(["k"], 50), []
    want = collections.Counter()
    rng = random.Random(2)
    for _ in range(40):
        keys = [rng.choice("abcdefghij") + str(rng.randrange(20)) for _ in range(30)]
        want.update(keys)
        out += tally.add(pa.table({"k": keys, "n": [1] * 30}))
    out += tally.rest()
    got = collections.Counter()
    for batch in out:
        for r in batch.to_pylist():
            got[r["k"]] += r["n"]
    assert got == want and not list(tally.rest())


# --- quality rules


def base_of(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.defaultdict(list)
    for k in range(len(w) - 4):
        grams[tuple(w[k : k + 5])].append(k)
    marked = {p + d for places in grams.values() if len(places) > 1 for p in places for d in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(marked) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed


def quality_rows():
    rng = random.Random(4)
    common = ["the", "of", "and", "to", "in", "that", "is"]
    letters = "etaoinshrdlucmfw"
    say = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(n)) + "."
    good = [(i, say(rng.randrange(30, 400)).capitalize()) for i in range(150)]
    bad = [(1000 + i, t.upper()) for i, (_, t) in enumerate(good[:10]) if len(t) > 600] + [(2000 + i, " ".join(x + "###" for x in t.split())) for i, (_, t) in enumerate(good[10:20]) if len(t) > 600]
    odd = [(3000, None), (3001, ""), (3002, "one two"), (3003, "a b c d e f g h i j " * 3), (3004, "x y\n" * 20), (3005, "z" * 90_000), (3006, "\n\n \n"), (3007, "é À ß 日本 🙂 # | < and more words to have ten"), (5, good[5][1]), (5, good[5][1]), (None, good[7][1]), (3008, "w " * 20_000)]
    return good, bad, odd


def test_quality_rules(spark):
    good, bad, odd = quality_rows()
    every = [(*r, "en") for r in good + bad + odd] + [(4000, good[0][1], None), (4001, good[1][1], "xx"), (4002, "ÿ " * 40, None)]
    got = collections.defaultdict(list)
    for r in quality.quality(frame(spark, every).repartition(3)).collect():
        got[r.doc_id].append(r)
    for i, text, *_ in every:
        for r in got[i]:
            assert tuple(r[c] for c in [*quality.BASE, "base_failed"]) == base_of(text), (i, r)
            assert not (r.kept and r.base_failed)
    assert sum(map(len, got.values())) == len(every)
    assert all(r.kept for i, *_ in good for r in got[i]), [r for i, *_ in good for r in got[i] if not r.kept]
    assert len(bad) > 5 and not any(r.kept for i, _ in bad for r in got[i])
    assert len({(r.kept, r.chars_apart) for r in got[5]}) == 1 and len(got[5]) == 3
    assert got[4000][0].kept and got[4000][0].chars_apart is None  # no language, no verdict but the base counts'
    assert quality.quality(frame(spark, []).limit(0)).count() == 0


def test_references_are_shares_and_medians(spark):
    good, bad, _ = quality_rows()
    rows = {(r.kind, r.name): r.value for r in quality.references(frame(spark, good + bad), common=5).collect()}
    kept = [t for _, t in good + bad if not base_of(t)[-1]]
    terms = collections.Counter(w for t in kept for w in re.findall(TERM, lower(t)))
    want = sorted(terms.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert {k: v for (kind, k), v in rows.items() if kind == "word" and k is not None} == dict(want) and rows["word", None] == sum(terms.values())
    shares = sorted(1000 * sum(c in "aeiou" for c in t) // len(t) for t in kept if len(t) >= 200)
    assert rows["class", "vowel"] == shares[(len(shares) - 1) // 2]
    # a reference from one corpus judges another one
    told = quality.quality(frame(spark, bad), reference=quality.references(frame(spark, good)))
    assert not any(r.kept for r in told.collect())


def test_distance_by_hand():
    got = quality.distances(np.array([[1, 1, 0], [0, 0, 4], [2, 2, 0]]), np.array([0.5, 0.5, 0.0]))
    assert np.allclose(got, [0, 1, 0])
    p, q = np.array([0.2, 0.3, 0.5]), np.array([0.1, 0.6, 0.3])
    m = (p + q) / 2
    want = math.sqrt(((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2)
    assert abs(quality.distances(np.array([[2, 3, 5]]), q)[0] - want) < 1e-12


def test_repeated_words_by_hashes_and_plainly(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(80))) for _ in range(40)]
    column = pa.array(texts)
    want = [base_of(t)[4] for t in texts]
    assert quality.Profile(column).base["n_repeat_words"].tolist() == want
    monkeypatch.setattr(quality, "mix", lambda x: np.zeros_like(x))  # all windows have one hash
    assert quality.Profile(column).base["n_repeat_words"].tolist() == want


# --- repeated rows, repeated passages and several batches in the earlier operators


def near_groups(rows):
    """doc_id -> smallest doc_id of its component, from all pairs of sets."""
    sets = collections.defaultdict(set)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i].add(frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in sets}


def test_near_copies_that_repeat_a_doc_id_many_times(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(9000)}" for _ in range(60)]
    one, two = " ".join(base), " ".join([*base[:-1], "other"])
    rows = [(1, one)] * 20_000 + [(2, two)] * 20_000 + [(3, "nothing like it at all here"), (3, "nor this one which is else")]
    began = time.time()
    found = neardup.near_dedup(frame(spark, rows).repartition(8))
    got = {tuple(r) for r in found.select("doc_id", "component_id", "kept").distinct().collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True)} and found.count() == len(rows)
    assert time.time() - began < 90


def test_a_doc_id_with_many_texts(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(50)]
    near = lambda: " ".join(w if rng.random() > 0.02 else word() for w in base)
    rows = [(7, near()) for _ in range(300)] + [(8, near()) for _ in range(300)] + [(9, " ".join(word() for _ in range(40))) for _ in range(200)] + [(5, " ".join(base)), (6, "five words of a kind here")]
    rows += [(9, "five words of a kind here"), (4, "alone with these words and more of them"), (None, " ".join(base)), (2, None), (2, "")]
    want = near_groups([r for r in rows if r[0] is not None and r[0] != 7 and r[0] != 8] + [r for r in rows if r[0] in (7, 8)][::20])
    got = collections.defaultdict(set)
    for r in neardup.near_dedup(frame(spark, rows)).collect():
        got[r.doc_id].add(r.component_id)
    assert got.pop(None) == {None}
    assert dict(got) == {i: {c} for i, c in want.items()}


def tiled(a, b, width=5):
    """Words of a that greedy tiling by b covers."""
    taken_a, taken_b, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not taken_a[i + n] and not taken_b[j + n]:
                    n += 1
                if n >= width and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return total
        total += best[0]
        for d in range(best[0]):
            taken_a[best[1] + d] = taken_b[best[2] + d] = True


def cover(text, items):
    piece = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"])
    ids, covers = decontam.judged(piece, decontam.Items(items, 5))
    return ids[0], covers[0]


@pytest.mark.parametrize("seed", range(3))
def test_tiling_of_passages_that_both_sides_repeat(seed):
    rng = random.Random(seed)
    for _ in range(60):
        passages = [" ".join(rng.choice("pqrs") for _ in range(rng.randint(5, 8))) for _ in range(2)]
        mixed = lambda tag, n: " ".join(x for k in range(n) for x in (rng.choice(passages), f"{tag}{k}"))
        items = [(k, mixed("i", rng.randint(1, 4))) for k in range(3)]
        text = mixed("d", rng.randint(1, 6))
        want = max((tiled(t.split(), text.split()) / len(t.split()), -k) for k, t in items)
        assert cover(text, items) == ((-want[1], pytest.approx(want[0])) if want[0] else (None, 0.0))


def test_tiling_takes_time_in_proportion():
    began = time.time()
    text = " ".join(f"p q r s t u d{k}" for k in range(4000))
    assert cover(text, [(0, " ".join(f"p q r s t u i{k}" for k in range(400)))]) == (0, pytest.approx(6 / 7))
    opening = "o1 o2 o3 o4 o5 o6 o7 o8"
    block = decontam.Items([(k, opening + " " + " ".join(f"i{k}w{j}" for j in range(12))) for k in range(8000)], 5)
    piece = pa.RecordBatch.from_arrays([pa.array([f"{opening} and {opening}"] * 20)], ["text"])
    assert decontam.judged(piece, block) == ([0] * 20, [pytest.approx(0.4)] * 20)
    assert time.time() - began < 10


def test_items_without_id_and_with_one_that_repeats(spark):
    rng = random.Random(3)
    say = lambda: " ".join(f"b{rng.randrange(10_000)}" for _ in range(20))
    a, b, c, d = say(), say(), say(), say()
    bench = spark.createDataFrame([(None, a), (None, b), (4, c), (4, d), (9, c), (None, c), (None, None), (5, None)] + [(6, f"{say()} x{k}") for k in range(300)], "item_id BIGINT, text STRING")
    docs = frame(spark, [(1, f"in {a} here"), (2, b), (3, f"x {c} y"), (4, d), (5, "clean words only and nothing else"), (6, None)])
    for words in (decontam.BLOCK_WORDS, 500):
        got = {r.doc_id: (r.item_id, r.contaminated) for r in decontam.decontaminate(docs, bench, block_words=words).collect()}
        assert got == {1: (None, True), 2: (None, True), 3: (4, True), 4: (4, True), 5: (None, False), 6: (None, False)}
        assert {r.doc_id for r in decontam.clean(docs, bench, block_words=words).collect()} == {5, 6}
    # rows that repeat an item are one item, and a block holds about so many words whatever the ids
    sizes = [len(x.value.a) for x in decontam.blocks(bench.unionByName(bench), 5, 500)]
    assert len(sizes) > 5 and max(sizes) < 1500


def test_digest_index_over_three_batches(spark):
    rng = random.Random(5)
    index = exact_dedup.DigestIndex(spark, f"{shared_dir(spark)}/index", 4)
    known = {}
    for name in ("one", "two", "three"):
        rows = [(rng.choice([None, *range(50)]), rng.choice(["a", "b  b", "b b", "c", f"{name} own", None, ""])) for _ in range(80)]
        rows += [(None, f"{name} nobody")] * 3 + [(i, "hot in two") for i in range(3000 if name == "two" else 1)]
        normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        own = collections.defaultdict(list)
        for i, t in rows:
            own[normal(t)].append(i)
        fresh = {t for t in own if t not in known}
        for t in fresh:
            known[t] = min((i for i in own[t] if i is not None), default=None)
        want = collections.Counter((i, known[normal(t)], len(own[normal(t)]), normal(t) in fresh and i == known[normal(t)]) for i, t in rows)
        digested = exact_dedup.digests(frame(spark, rows))
        index.add(digested, name)
        got = index.decide(digested, len(rows), name).select("doc_id", "keep_id", "group_size", "kept")
        assert collections.Counter(map(tuple, got.collect())) == want
    index.close()


# --- token files


def test_coder_keeps_contexts_of_many_ids_apart():
    """Order 2's cells hold the last id itself: a guess found by a mistaken hash still belongs to the last id's list, so nothing is decoded wrongly."""
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50_000, (60_000, 3))[rng.integers(0, 60_000, 350_000)].reshape(-1)
    prior, blocks = rangecoder.encode(ids)
    assert (rangecoder.decode(prior, blocks, len(ids)) == ids).all()


@pytest.mark.parametrize("total,block", [(1, 64), (63, 64), (64, 64), (65, 64), (6000, 1000), (5000, 7), (40_000, 1024)])
def test_coder_odd_sizes(total, block):
    rng = np.random.default_rng(total)
    for ids in (np.full(total, 7), rng.integers(0, 4, total), rng.integers(0, 2, total) * 50_256, np.minimum(rng.zipf(1.2, total), 50_256), np.where(rng.random(total) < 0.999, 0, rng.integers(0, 50_257, total))):
        prior, blocks = rangecoder.encode(ids, block)
        assert len(blocks) == -(-total // block)
        assert (rangecoder.decode(prior, blocks, total, block) == ids).all()
        own = ids[len(ids) // block // 2 * block :][:block]
        assert (rangecoder.decode(prior, [blocks[len(ids) // block // 2]], len(own), block) == own).all() if len(own) else True


