"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladeweave.llm import chat, decontam, exact_dedup, line_dedup, merges, mixing, neardup, oracles, queries, rangecoder, token_counts, token_files, toxicity, transducer, urls
from cladeweave.llm.common import shared_dir
from cladeweave.llm.queries import vocabulary
from cladeweave.llm.words import mix, range_hashes, shingle_sets, word_hashes

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, hash STRING, tag INT, c INT, kept INT, _hot INT, size INT, score INT"
BLANKS = " \t\n\x0b\x0c\r"
# two words that any polynomial hash modulo a power of 2 takes for one
THUE_MORSE = ["".join("ab"[(bin(i).count("1") + k) % 2] for i in range(2048)) for k in (0, 1)]


def frame(spark, rows):
    """documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 1, 2, 3, 4, 5, 6) for i, t, s in rows], DOCS)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))


def odd_texts(rng):
    say = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma", "délta", "ñandú", "zeta7", "eta's", "theta."]) for _ in range(n))
    base = say(60)
    return [None, "", " \n\t ", "one", "one two three four", "A B C D E", base, base, base.upper(), base + " tail", base.replace(" ", "\n"), say(5000), "x" * 70_000, "line one is quite long here\nB\n" + say(9), "line one is quite long here\n" + say(8), "LINE ONE is quite long here \n" + say(7), "\x1c\x85 odd\u2003blank", "日本語 テキスト 🙂 done"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = odd_texts(rng)
    out = [(i, t, ["b", "a", None, "c"][i % 4]) for i, t in enumerate(texts)]
    return out + [(6, texts[6], "b"), (6, texts[6], "b"), (None, texts[7], "a"), (None, None, None)]


def test_words_do_not_depend_on_pieces(rows):
    texts = [t for _, t, _ in rows]
    hashes, at = word_hashes(pa.array(texts, pa.string()))
    known = {}
    for i, t in enumerate(texts):
        own = hashes[at[i] : at[i + 1]].tolist()
        assert len(own) == len(words(t))
        for w, h in zip(words(t), own):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_mixing(spark, rows):
    docs = frame(spark, rows + [(100, "w " * 10, "d"), (101, "w " * 3, "e"), (102, " ", "f")])
    got = mixing.mix(docs).collect()
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len(words(r.text))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        left, open_ = sum(size.values()) - 3 * sum(size[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / open_ for s in order}
        new = {s for s in order if s not in full and target[s] > 3 * size[s]}
        if not new:
            break
        full |= new
    taken = collections.Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert full and all(abs(taken[s] - target[s]) < 1 for s in order)
    mixed = collections.Counter()
    texts = collections.defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text)
    for r in mixing.mixed(docs).collect():
        mixed[r.source] += len(words(r.text))
        assert any(t is not None and t.startswith(r.text) for t in texts[r.doc_id])
    assert mixed == +taken
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_mixing_of_rows_that_repeat(spark):
    # one doc_id or none for all rows: other texts, and equal rows that stand on the cut
    made = [(None, f"w{i} x y z", "a") for i in range(3000)] + [(7, "a b c", "b")] * 2000 + [(8, f"t{i} u", "b") for i in range(50)]
    docs = frame(spark, made + [(9, "v " * 40_000, "c")])
    plan = mixing.mix(docs).collect()
    target = {r.source: r.target for r in plan}
    taken, copies = collections.Counter(), collections.Counter()
    for r in plan:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(plan) == docs.count() and all(abs(taken[s] - target[s]) < 1 for s in target)
    assert len({(r.epochs, r.part) for r in plan if r.doc_id == 7}) > 1
    mixed = collections.Counter()
    for r in mixing.mixed(docs).collect():
        mixed[r.source] += len(words(r.text))
        copies[(r.doc_id, r.text)] += 1
    assert mixed == taken and all(n <= 3 for (i, _), n in copies.items() if i is None)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, plan), key=str)


def test_mixing_agrees_for_any_number_of_ranges(spark, rows, monkeypatch):
    docs = frame(spark, rows)
    want = sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect()), key=str)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect()), key=str) == want


URLS = ["https://Www.Example.COM/en/x?q#f", "http://a.example.com/en/1", "http://example.com/EN/", "https://x.net/es/1", "http://net/fr/", "http://notnet/fr/", None, "nope", "http://", "http://h.org?x=/en/", "http://com", "http://y.com/", "ftp://u://v/en/", "http://example.com:80/en/"]


def url_parts(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "<p>", 1.0) for i, u in enumerate(URLS)], "page_id BIGINT, url STRING, html STRING, score DOUBLE")
    for r in urls.url_filter(pages).collect():
        host, path = url_parts(URLS[r.page_id])
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else ("block" if r.score >= 0.5 else "allow"))
    assert urls.url_filter(pages.limit(0)).count() == 0


def test_urls_that_repeat_and_long_ones(spark):
    rules = (("block", "a.org", "/b"), ("allow", "b.a.org", "/"), ("block", "a.org", "/c/"), ("allow", "org", "/b/c/"))
    table = ["http://a.org/b"] * 3 + ["http://x.b.a.org/b", "http://b.a.org/" + "p/" * 50_000, "http://a.org/b/c/"]
    pages = spark.createDataFrame([(i, u, "<p>", 1.0, "h") for i, u in enumerate(table)], "page_id BIGINT, url STRING, html STRING, score DOUBLE, host STRING")
    got = {r.page_id: r for r in urls.url_filter(pages, rules=rules).collect()}
    assert [got[i].rule for i in range(6)] == ["a.org/b"] * 3 + ["b.a.org/"] * 2 + ["org/b/c/"]
    assert got[0].verdict == "block" and len(got[4].path) == 100_001
    # of equally long rules that fit the first by code point
    tied = (("block", "c.org", "/"), ("allow", "org", "/d/"), ("allow", "xc.org", "/"))
    (row,) = urls.url_filter(pages.limit(0).union(spark.createDataFrame([(1, "http://c.org/d/", "", 0.0, "")], pages.schema)), rules=tied).collect()
    assert (row.rule, row.verdict) == ("c.org/", "block")


def test_urls_fit_by_plain_gradient_descent(spark):
    rng = random.Random(6)
    table = [(f"{rng.choice(['shop', 'news', 'win'])}{k % 7}.net", f"/{rng.choice('abc')}/{k}", k % 3 == 0) for k in range(25)]
    table += [table[0]] * 500 + [(*table[1][:2], True), ("n.net", "/", None)]  # a url that repeats is one row, blocked if a label says so
    w = urls.fit(spark.createDataFrame(table, "host STRING, path STRING, blocked BOOLEAN"), steps=8)
    known = {}
    for h, p, y in table:
        if y is not None:
            known[h, p] = known.get((h, p), False) or y

    def slot(gram, salt):
        raw = np.frombuffer(gram, np.uint8)
        return int(mix(range_hashes(raw, np.array([0]), np.array([len(raw)])) + np.uint64(salt))[0] >> np.uint64(64 - urls.BITS))

    rows = []
    for (h, p), y in known.items():
        grams = [slot(t[i : i + n], s) for s, t in ((1, f"^{h}$".encode()), (2, f"^{p}$".encode())) for n in urls.NGRAMS for i in range(len(t) - n + 1)]
        rows.append((grams, float(y)))
    weight, speed = collections.defaultdict(float), collections.defaultdict(float)
    for _ in range(8):
        slope = collections.defaultdict(float)
        for grams, y in rows:
            z = sum(weight[g] for g in grams) / len(grams) ** 0.5 + weight["bias"]
            wrong = 1 / (1 + np.exp(-z)) - y
            for g in grams:
                slope[g] += wrong / len(grams) ** 0.5 / len(rows)
            slope["bias"] += wrong / len(rows)
        for g in slope:
            speed[g] = 0.9 * speed[g] - urls.RATE * (slope[g] + urls.DECAY * weight[g])
            weight[g] += speed[g]
    dense = np.zeros_like(w)
    for g, x in weight.items():
        dense[-1 if g == "bias" else g] = x
    assert np.allclose(w, dense, atol=1e-9) and np.count_nonzero(w) > 100


def test_urls_model_learns(spark):
    make = lambda n, a, b: [(f"{a}{k}.site.org", f"/{b}/{k}") for k in range(n)]
    table = [(*x, True) for x in make(80, "casino", "win")] + [(*x, False) for x in make(80, "docs", "read")]
    w = urls.fit(spark.createDataFrame(table, "host STRING, path STRING, blocked BOOLEAN"))
    test = [(i, h, p) for i, (h, p) in enumerate(make(120, "casino", "win")[80:] + make(120, "docs", "read")[80:])]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(test, "page_id BIGINT, host STRING, path STRING"), w, ()).collect()}
    assert all(got[i] == ("block" if i < 40 else "allow") for i in got)


def test_line_dedup(spark, rows):
    docs = frame(spark, [r for r in rows if r[0] is not None])
    seen = collections.defaultdict(set)
    key = lambda line: lower(line.strip(BLANKS))
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                seen[key(line)].add(i)
    gone = lambda i, line: len(seen.get(key(line), ())) >= 3 and max(seen[key(line)]) != i
    want = sorted((i, len((t or "").split("\n")), sum(gone(i, x) for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t, _ in rows if i is not None)
    assert any(w[2] for w in want)
    for salts in (1, 16):
        got = line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs, salts=salts))
        assert sorted(map(tuple, got.collect())) == want
    got = line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs, salts=1, run_rows=2))
    assert sorted(map(tuple, got.collect())) == want
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
    # rows without doc_id are one document, smaller than any other
    line = "this line is long enough to count"
    odd = frame(spark, [(None, line, "s"), (None, "x\n" + line, "s"), (4, line + "\ny", "s"), (2, line, "s"), (None, None, "s")])
    left = line_dedup.apply_bitmaps(odd, line_dedup.line_dedup(odd)).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_dropped) for r in left) == [(0, "", 0), (0, "", 1), (0, "x", 1), (2, "", 1), (4, line + "\ny", 0)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_transducer_equals_library(library):
    rng = random.Random(5)
    parts = ["a", "s", "t", "re", "ve", "'", "''", " ", "  ", "\n", "\t", "1", "²", "é", "ñ", "!", "<|endoftext|>", "<|", "ll", "'ll", "'re", "'ra", "'S", "字", "🙂", "\u0301", "'l", "'v", "\x1c", "\x85", "\u200b", "٣", "ǅ", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["", "x" * 5000, " " * 3000 + "y", *THUE_MORSE, "é" * 64, "é" * 65]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert transducer.tokenizer(vocabulary()).counts(pa.array(texts, pa.string())).tolist() == [len(w.ids) for w in want]
    for cut in (transducer.pieces, transducer.compared):
        counts, ids = transducer.tokenizer(vocabulary()).ids(pa.array(texts, pa.string()), cut)
        at = np.concatenate([[0], np.cumsum(counts)])
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == want[i].ids, text


def test_merges_equal_library(library):
    rng = random.Random(15)
    texts = ["".join(rng.choice(["th", "e", "in", "g", "ö", "ß", "日", "x", "Z", "7", "ing", "qu"]) for _ in range(rng.randint(1, 20))) for _ in range(2000)]
    texts = [t for t in texts if len(t.encode()) <= merges.MOST and not re.search("[0-9]", t)]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(t) for t in raw])
    counts, ids = merges.Merges.of(library).encode(np.frombuffer(b"".join(raw), np.uint8), ends - [len(t) for t in raw], ends)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    pieces = [len(library.pre_tokenizer.pre_tokenize_str(t)) for t in texts]
    at = np.cumsum(counts)
    for t, w, n, lo, hi in zip(texts, want, pieces, at - counts, at):
        assert n > 1 or ids[lo:hi].tolist() == w, t
    assert pieces.count(1) > 100


def test_without_known_merges_the_library_counts(library, monkeypatch):
    monkeypatch.setattr(merges.Merges, "of", classmethod(lambda cls, library: None))
    monkeypatch.setattr(transducer, "POOL", 4000)
    tok = transducer.Tokenizer(vocabulary())
    texts = [f"alpha{k} beta{k * 7}'s  naïve\n" * 3 + "<|endoftext|>" for k in range(900)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for lo in range(0, 900, 300):  # the pool starts anew
        column = pa.array(texts[lo : lo + 300])
        assert tok.counts(column).tolist() == [len(w) for w in want[lo : lo + 300]]
        assert tok.ids(column)[1].tolist() == [i for w in want[lo : lo + 300] for i in w]


def test_token_counts(spark, rows, library):
    got = token_counts.token_counts(frame(spark, rows), vocabulary()).collect()
    want = collections.Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in rows)
    assert collections.Counter(map(tuple, got)) == want


def test_range_coder_round_trip():
    rng = np.random.default_rng(2)
    for ids in ([], [0], [50256] * 3, rng.integers(0, 50257, 5000), np.zeros(4097, int), rng.zipf(1.3, 9000) % 50257):
        ids = np.asarray(ids, dtype=np.int64)
        for block in (64, 2048):
            prior, blocks = rangecoder.encode(ids, block)
            assert (rangecoder.decode(prior, blocks, len(ids), block) == ids).all()
            for k in range(len(blocks)):  # each block on its own
                own = ids[k * block : (k + 1) * block]
                assert (rangecoder.decode(prior, [blocks[k]], len(own), block) == own).all()


def test_range_coder_beats_zlib():
    rng = np.random.default_rng(3)
    step = rng.integers(0, 3000, (3000, 4))
    ids = [0]
    for k in rng.integers(0, 4, 60_000).tolist():
        ids.append(int(step[ids[-1], k]) if rng.random() < 0.9 else int(rng.zipf(1.4) % 3000))
    prior, blocks = rangecoder.encode(np.array(ids))
    raw = np.array(ids, "<u2").tobytes()
    zlibbed = sum(len(zlib.compress(raw[i : i + 2 * rangecoder.BLOCK], 9)) for i in range(0, len(raw), 2 * rangecoder.BLOCK))
    assert len(prior) + sum(map(len, blocks)) < 0.7 * zlibbed


def test_token_files(spark, rows, library):
    out = f"{shared_dir(spark)}/tokens"
    token_files.write_tokens(frame(spark, rows), vocabulary(), out, chunk_ids=500, block=128)
    got = token_files.read_documents(spark, out).orderBy("start").collect()
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    want = collections.Counter((i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    named = [r.doc_id for r in got if r.doc_id is not None]
    assert named == sorted(named)
    row = token_files.read_file(spark, out).first().asDict()
    broken = bytearray(row["payload"])
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        token_files.read_tokens(row | {"payload": bytes(broken)})
    empty = f"{shared_dir(spark)}/tokens"
    token_files.write_tokens(frame(spark, rows).limit(0), vocabulary(), empty)
    assert token_files.read_documents(spark, empty).count() == 0


def test_chat_fold(spark):
    log = [
        (1, 1, "delta", 1, "user", "Hel"), (1, 2, "delta", 1, "user", "lo"), (1, 3, "delta", 2, "assistant", "bad"), (1, 4, "regenerate", 2, "assistant", None),
        (1, 5, None, 2, "assistant", "go"), (1, 6, "delta", 2, "assistant", "od"), (1, 7, "delta", 3, "user", "x"), (1, 8, "edit", 1, "user", "Hi"),
        (1, 9, "delta", 2, "assistant", "yo"), (1, 10, "what", 9, "user", "?"), (2, 1, "delta", 1, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id BIGINT, seq BIGINT, kind STRING, turn BIGINT, role STRING, text STRING")
    assert sorted(map(tuple, chat.fold(events).collect())) == [(1, 1, "user", "Hi"), (1, 2, "assistant", "yo"), (2, 1, "", "")]


def test_chat_fold_of_random_logs(spark):
    rng = random.Random(12)
    log = []
    for conv in range(40):
        for seq in range(rng.randint(1, 25)):
            log.append((conv, seq, rng.choice(["delta", "delta", "delta", "edit", "regenerate"]), rng.randint(1, 4), rng.choice(["user", "assistant"]), f"{seq}."))
    want = {}
    for conv, _, kind, turn, role, text in log:
        turns = want.setdefault(conv, {})
        if kind != "delta":
            for t in [t for t in turns if t >= turn]:
                del turns[t]
        had = turns.get(turn, (role, ""))
        turns[turn] = (had[0], had[1] + ("" if kind == "regenerate" else text))
    events = spark.createDataFrame([(*r, "x", 1) for r in log], "conv_id BIGINT, seq BIGINT, kind STRING, turn BIGINT, role STRING, text STRING, place STRING, at INT")
    got = collections.defaultdict(dict)
    for r in chat.fold(events.repartition(5)).collect():
        got[r.conv_id][r.turn] = (r.role, r.text)
    assert got == want


def test_chat_of_long_texts_and_clashing_columns(spark):
    said = "<|x" * 60_000
    rows = [(1, 0, "user", said, "a", 1, 2), (1, 1, "assistant", said + "y", "b", 1, 2)]
    table = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING, seq STRING, formatted INT, loss INT")
    (row,) = chat.parse(chat.format_chats(chat.events_of_turns(table))).collect()
    assert [(t.role, t.text) for t in row.turns] == [(r[2], r[3]) for r in rows] and row.learned == [said + "y"]


def test_chat_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "<|", "<||", "<<|im_end|>", "|im_start|>", "a\nb\n", "", None, "<|nl|>", "🙂<|im_start|>"]
    turns = [(c, t, r, x) for c, k in enumerate(itertools.permutations(said, 2)) for t, (r, x) in enumerate(zip(("user", "assistant"), k))]
    turns += [(500, 0, "we\n<|nl|>ird\n", "x"), (500, 0, "we\n<|nl|>ird\n", "x"), (500, 1, None, "y")]
    table = spark.createDataFrame(turns, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    got = {r.conv_id: r for r in chat.parse(chat.format_chats(chat.events_of_turns(table))).collect()}
    for c, group in itertools.groupby(turns, key=lambda r: r[0]):
        group = list(group)
        assert [(x.role, x.text) for x in got[c].turns] == [(r or "", x or "") for _, _, r, x in group]
        assert got[c].learned == [x or "" for _, _, r, x in group if r == "assistant"]
        assert got[c].formatted.count("<|im_start|>") == len(group) == got[c].formatted.count("<|im_end|>")
    assert chat.format_chats(chat.events_of_turns(table.limit(0))).count() == 0


def test_toxicity(spark, rows):
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice(["sun", "tree", "river", "walks", "slowly", "by", "the", "green", "house"]) for _ in range(40))
    made = [(1000 + i, plain() + (" you awful" + rng.choice(["ness", "er", "ly"]) + " fool" if i % 3 == 0 else ""), "s") for i in range(900)]
    docs = frame(spark, rows + made)
    labels = spark.createDataFrame([(i, 1, int("awful" in t)) for i, t, _ in made] + [(1, 1, None), (None, 1, 1)], "doc_id BIGINT, quality INT, toxic INT")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(made) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: int("awful" in t) for i, t, _ in made}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    # what held-out labels say changes nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, toxicity.toxicity(docs, flipped).collect()), key=str) == sorted(map(tuple, got), key=str)
    kept = toxicity.civil(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert toxicity.toxicity(docs, labels.limit(0)).where("score <> 0").count() == 0


def test_toxicity_fit_by_plain_ftrl(spark):
    rng = random.Random(2)
    made = [(i, " ".join(rng.choice(["Bad", "good", "tree", "so-so", "river"]) for _ in range(rng.randint(0, 9))), "s") for i in range(60)]
    again = [(3, "bad bad other words here", "s")] * 3  # of a doc_id's texts the one with the smallest digest teaches
    labels = [(i, 1, int("Bad" in t)) for i, t, _ in made] + [(5, 1, 1), (6, 1, None)]
    model = dict(toxicity.fit(frame(spark, made + again), spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT"), epochs=3))
    text, label = {}, {}
    for i, t, _ in made + again:
        text[i] = min(text.get(i, t), t, key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    for i, _, y in labels:
        if y is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            label[i] = max(label.get(i, 0), y)
    order = spark.createDataFrame([(i,) for i in label], "doc_id BIGINT").orderBy(F.xxhash64("doc_id", F.lit(toxicity.SEED)), "doc_id")
    rows = []
    for (i,) in order.collect():
        w = words(text[i])
        named = {("w", x) for x in w} | {("p", *x) for x in zip(w, w[1:])} | {("s", *x) for x in zip(w, w[2:])} | {("t", x[: toxicity.STEM]) for x in w}
        slots = set(toxicity.features(pa.array([text[i]]))[0].tolist())
        assert len(slots) == len(named)
        rows.append((slots | {toxicity.BIAS}, label[i]))
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        size = max(abs(z[k]) - (0 if k == toxicity.BIAS else toxicity.L1), 0)
        return -np.sign(z[k]) * size / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for slots, y in rows:
            w = {k: weight(k) for k in slots}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for k in slots:
                rate = ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / toxicity.ALPHA
                z[k] += g - rate * w[k]
                n[k] += g * g
    want = {k: weight(k) for k in z if weight(k)}
    assert model.keys() == want.keys() and all(abs(model[k] - want[k]) < 1e-9 for k in want)
    assert toxicity.features(pa.array([made[9][1]]), 0)[0].size < toxicity.features(pa.array([made[9][1]]))[0].size


def groups(docs):
    sets = collections.defaultdict(list)
    for i, t in docs:
        w = words(t)
        sets[i].append(frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else []))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i in ids}, sets


def near_copies(rng, n, vocabulary=4000):
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passage = [word() for _ in range(60)]
    out = []
    for g in range(n):
        base = [word() for _ in range(rng.choice([6, 30, 90, 400]))]
        if g % 3 == 0:
            base = passage + base
        for _ in range(rng.choice([1, 1, 2, 12, 40])):
            rate = rng.choice([0, 0.005, 0.02, 0.05, 0.1])
            out.append(" ".join(word() if rng.random() < rate else w for w in base))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup(spark, rows, seed):
    rng = random.Random(seed)
    made = rows + [(1000 + i, t, "s") for i, t in enumerate(near_copies(rng, 30))]
    rng.shuffle(made)
    want, sets = groups([(i, t) for i, t, _ in made if i is not None])
    got = neardup.near_dedup(frame(spark, made)).collect()
    assert len(got) == len(made)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert neardup.near_dedup(frame(spark, made).limit(0)).count() == 0


def test_set_sizes():
    rng = random.Random(1)
    for _ in range(2000):
        texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(2)]
        texts[1] = texts[0] if rng.random() < 0.2 else texts[1]
        x, y = neardup.Words.of(pa.array(texts), 5)
        a, b = groups(enumerate(texts))[1].values()
        assert neardup.set_sizes(x, y, 5) == (len(a[0]), len(b[0]), len(a[0] | b[0]))
    same = [neardup.Words(np.repeat(x.a, 5), np.repeat(x.b, 5), 5) for x in neardup.Words.of(pa.array(["a", "b"]), 5)]
    same[1].grams = same[0].grams  # one hash, other words
    assert neardup.set_sizes(*same, 5) == (1, 1, 2)


def test_near_dedup_compares_words(spark):
    made = [(i, " ".join(w for _ in range(3)) + " and so on and so forth", "s") for i, w in enumerate(THUE_MORSE * 2)]
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_dedup(frame(spark, made)).collect()) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_common_passage_makes_no_pairs(spark):
    # three of five shingles in common: nothing is alike, however many there are
    docs = frame(spark, [(i, f"please see our full report on item w{i}", "s") for i in range(3000)])
    root = shared_dir(spark)
    sets = neardup.written(neardup.sketched(docs, 64, 5), root, "sets")
    classes = neardup.written(neardup.classified(sets), root, "classes")
    lists = neardup.written(neardup.retained(classes, root), root, "lists")
    texts = neardup.gathered(docs, classes, lists, sets, root)
    places = neardup.prefixes(texts, lists, 5).withColumn("comp", F.col("doc"))
    assert neardup._across(places).count() == 0
    assert neardup.near_dedup(docs).where("kept").count() == 3000


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", 7)
    rng = random.Random(8)
    rows = [(1, i, n := rng.randint(20, 30), n, 1, i) for i in range(60)]
    lists = spark.createDataFrame(rows, "v BIGINT, doc BIGINT, n BIGINT, m BIGINT, at BIGINT, comp BIGINT")
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a, b in itertools.combinations(rows, 2) if 4 * min(a[2], b[2]) >= 3 * max(a[2], b[2])}
    assert {tuple(r) for r in neardup._across(lists).collect()} == want


def test_components_of_a_path(spark):
    n = 300
    edges = spark.createDataFrame([(i * 7919 % n, (i + 1) * 7919 % n) for i in range(n - 1)], "a BIGINT, b BIGINT")
    got = neardup.components(edges, shared_dir(spark), "path").collect()
    assert {r.comp for r in got} == {0} and len(got) == n - 1


def test_tiles():
    # 0..9 stands at 20 in the other text, 5..16 at 40: the longest first, then what is left
    side = lambda words: decontam.Side(np.array(words, np.uint64), np.ones(len(words), np.uint64), np.ones(len(words), bool))
    other = [*range(100, 120), *range(10), *range(130, 140), *range(5, 17)]
    assert decontam.tiles(side(range(17)), side(other), 5) == [(5, 40, 12), (0, 20, 5)]
    assert decontam.tiles(side([]), side([]), 5) == []


def judged(texts, items):
    piece = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    return list(zip(*decontam.judged(piece, decontam.Items(list(enumerate(items)), 5))))


@pytest.mark.parametrize("seed", range(4))
def test_tiling_of_repetitive_texts(seed):
    rng = random.Random(seed)
    some = lambda n, k: " ".join(rng.choice("abcd"[:k]) for _ in range(n))
    items = [some(rng.randint(5, 30), rng.randint(1, 3)) for _ in range(4)]
    texts = [some(rng.randint(0, 60), rng.randint(1, 4)) for _ in range(30)]
    for text, got in zip(texts, judged(texts, items)):
        covers = max((brute_tiles(words(t), words(text), 5) / len(words(t)), -k) for k, t in enumerate(items))
        assert got == ((-covers[1], pytest.approx(covers[0])) if covers[0] else (None, 0.0))


def test_tiling_of_long_repetitive_texts():
    assert judged(["a " * 30_000, "a b " * 15_000], ["a " * 3_000, "a b c d e"]) == [(0, 1.0), (None, 0.0)]
    (one,) = judged(["x " + THUE_MORSE[0] + " y z w v"], ["x " + THUE_MORSE[1] + " y z w v"])
    assert one == (None, 0.0)


def brute_tiles(a, b, width):
    marked_a, marked_b, covered = set(), set(), 0
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in marked_a and j + n not in marked_b:
                    n += 1
                if n >= width and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if not best:
            return covered
        n, i, j = -best[0], best[1], best[2]
        marked_a.update(range(i, i + n))
        marked_b.update(range(j, j + n))
        covered += n


def test_decontamination(spark, rows):
    rng = random.Random(9)
    word = lambda: f"q{rng.randrange(3000)}"
    items = [[word() for _ in range(rng.randint(3, 40))] for _ in range(12)]
    made = []
    for k in range(60):
        item = rng.choice(items)
        cut = rng.randint(0, len(item))
        body = rng.choice([item, item[cut:] + [word()] + item[:cut], item[: len(item) // 3], [w if rng.random() > 0.1 else word() for w in item], []])
        made.append((1000 + k, " ".join([word() for _ in range(rng.randint(0, 50))] + body + [word() for _ in range(rng.randint(0, 50))]), "s"))
    docs = frame(spark, rows + made)
    bench = spark.createDataFrame([(k, " ".join(t), 1) for k, t in enumerate(items)] + [(90, None, 1), (91, "", 1)], "item_id BIGINT, text STRING, tag INT")
    text = {i: t for i, t, _ in made}
    one = decontam.decontaminate(docs, bench).collect()
    assert len(one) == len(rows) + len(made)
    for r in one:
        if r.doc_id in text:
            covers = [(brute_tiles(t, words(text[r.doc_id]), 5) / len(t), -k) for k, t in enumerate(items)]
            assert r.contaminated == (max(covers)[0] >= decontam.COVERAGE)
            assert (r.item_id, r.coverage) == ((-max(covers)[1], pytest.approx(max(covers)[0])) if max(covers)[0] else (None, 0.0))
        else:
            assert (r.item_id, r.coverage, r.contaminated) == (None, 0.0, False)
    several = decontam.decontaminate(docs, bench, block_words=40).collect()
    assert collections.Counter(map(tuple, several)) == collections.Counter(map(tuple, one))
    left = decontam.clean(docs, bench, block_words=100)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id in text) == sorted(r.doc_id for r in one if not r.contaminated and r.doc_id in text)
    assert decontam.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0


def test_exact_dedup(spark, rows):
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = collections.Counter()
    for i, t, _ in rows:
        normal = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        named = [x for x in texts[normal] if x is not None]
        keep = min(named) if named else None
        want[(i, keep, len(texts[normal]), i == keep, hashlib.sha256(normal.encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, exact_dedup.exact_dedup(frame(spark, rows)).collect())) == want
    assert exact_dedup.exact_dedup(frame(spark, rows).limit(0)).count() == 0


def test_digest_index_persists(spark):
    path = f"{shared_dir(spark)}/index"
    first = exact_dedup.digests(frame(spark, [(5, "a  b", "s"), (3, "a b", "s"), (9, "c", "s")]))
    index = exact_dedup.DigestIndex(spark, path, 4)
    index.add(first, "one")
    index.add(first, "one")
    again = exact_dedup.DigestIndex(spark, path, 4)
    second = exact_dedup.digests(frame(spark, [(1, "a b", "s"), (2, "d", "s")]))
    again.add(second, "two")
    assert sorted((r.keep_id, r.group_size, r.batch) for r in again.rows().collect()) == [(2, 1, "two"), (3, 2, "one"), (9, 1, "one")]
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in again.decide(second, 2, "two").collect()) == [(1, 3, False), (2, 2, True)]


def test_pipeline(spark, rows, library):
    import corpus_pipeline as pipeline

    assert 4 <= len(pipeline.STAGES) <= 5
    rng = random.Random(4)
    root = shared_dir(spark)
    clean = [(2000 + i, " ".join(f"v{rng.randrange(5000)}" for _ in range(80)), rng.choice("ab")) for i in range(60)]
    item = " ".join(f"b{k}" for k in range(30))
    docs = rows + clean + [(3000, clean[0][1] + " x", "a"), (3001, "start " + item + " end of it", "b")]
    frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _, _ in clean], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{root}/labels.parquet")
    tables = [spark.read.parquet(f"{root}/documents.parquet")]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, tables[-1], root).write.parquet(f"{root}/{k}")
        tables.append(spark.read.parquet(f"{root}/{k}"))
        assert k == len(pipeline.STAGES) - 1 or tables[-1].columns == tables[0].columns
    civil, single, uncontaminated, mixed = ([tuple(r)[:4] for r in t.collect()] for t in tables[1:5])
    for left in (civil, single, uncontaminated):
        assert {i for i, _, _ in clean} <= {r[0] for r in left}
    # one row of each group of near copies, rows without doc_id untouched
    group, _ = groups([(r[0], r[1]) for r in civil if r[0] is not None])
    named = [r[0] for r in single if r[0] is not None]
    assert sorted(named) == sorted({i for i in group if group[i] == i}) and set(single) <= set(civil)
    assert sum(r[0] is None for r in civil) == sum(r[0] is None for r in single)
    assert 3000 not in named and 3001 in named
    covered = lambda t: brute_tiles(words(item), words(t), 5) / 30 >= decontam.COVERAGE
    want = [r for r in single if not covered(r[1])]
    assert collections.Counter(want) == collections.Counter(uncontaminated) and 3001 not in [r[0] for r in uncontaminated]
    # words taken of each source are its target, no document more than three times
    target = {r.source: r.target for r in mixing.source_targets(mixing.sizes(tables[3])).collect()}
    taken = collections.Counter()
    for i, t, _, source in mixed:
        taken[source] += len(words(t))
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    most = collections.Counter(r[0] for r in mixed)
    assert all(n <= 3 * sum(r[0] == i for r in uncontaminated) for i, n in most.items())
    # every row of the mix is in the file once, in order
    got = tables[5].orderBy("start").collect()
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t, _, _ in mixed)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert pipeline.run(spark, root).count() == len(got)


def test_pipeline_of_an_empty_table_and_of_repeated_doc_ids(spark, tmp_path):
    import corpus_pipeline as pipeline

    root = shared_dir(spark)
    kind = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, size INT, row INT"
    spark.createDataFrame([(1, "one two three four five six", 0)], "item_id BIGINT, text STRING, tag INT").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{root}/labels.parquet")
    docs = spark.createDataFrame([], kind)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, root)
        assert docs.count() == 0 and (k == 4 or docs.columns == [c.split()[0] for c in kind.split(", ")])
    rows = [(7, f"a{i} b c d e f g h", "en", "s", 1, 2, 3) for i in range(4)] * 2 + [(None, f"n{i} x y", "en", None, 1, 2, 3) for i in range(6)] + [(8, None, "en", "s", 0, 2, 3)]
    docs = spark.createDataFrame(rows, kind)
    left = pipeline.near_dedup(spark, docs, root).collect()
    first = min((r[1] for r in rows if r[0] == 7), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert collections.Counter((r.doc_id, r.text) for r in left) == collections.Counter([(7, first), (8, None), *((None, r[1]) for r in rows if r[0] is None)])
    mixed = pipeline.mix_sources(spark, docs, root).collect()
    target = {r.source: r.target for r in mixing.source_targets(mixing.sizes(docs)).collect()}
    taken = collections.Counter()
    for r in mixed:
        taken[r.source] += len(words(r.text))
        assert r.size == 2 and r.row == 3
    assert all(abs(taken[s] - target[s]) < 1 for s in target)


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.execute(oracles.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    plain = lambda rows: collections.Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


def test_shingle_sets_of_short_texts():
    n = [len(s) for s in shingle_sets(pa.array([None, "", "a", "a b c d", "a b c d e", "a b c d e f"]))]
    assert n == [0, 0, 1, 1, 1, 2]
