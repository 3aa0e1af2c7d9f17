"""The engine against DuckDB, numpy and hand-made cases."""

import gzip
import hashlib
import itertools
import math
import os
import random
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladeweave.functions import scores as sc
from cladeweave.functions import numbering
from cladeweave.operators import bootstrap, concordance, consensus, counts, encode, kernel, multiplicity, packed, quartets, refine, supertree, treeindex, trees
from cladeweave.plans import inference
from cladeweave.plans import oracles, queries
from cladeweave.sources import datasources, files, fixtures

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "lineitem", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(round(float(x), 6) if isinstance(x, (float, np.floating)) else x if x is None or isinstance(x, str) else int(x) for x in r) for r in rows)


# the totals of 487,635 quartets take SQL a minute; test_totals_of_a_universe has few samples
@pytest.mark.parametrize("name", sorted(set(oracles.ORACLES) - {"universe_totals"}))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(oracles.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda rows: sorted(map(str, rows))
    assert key(plain_unsorted(got.select(*[f"`{c}`" for c in columns]).collect())) == key(plain_unsorted(want.fetchall()))


def plain_unsorted(rows):
    return [tuple(round(float(x), 6) if isinstance(x, (float, np.floating)) else x for x in r) for r in rows]


def codes_of(spark, columns, loci=None):
    """codes from strings, one for each site, a digit or N for each sample."""
    rows = [(i, loci[s] if loci else s, s, None if b == "N" else int(b)) for s, col in enumerate(columns) for i, b in enumerate(col)]
    return spark.createDataFrame(rows, "sample_idx INT, locus BIGINT, site BIGINT, code INT")


@pytest.mark.parametrize(
    "columns, want, res",
    [
        (["0011"], (0, 0, 0), 0),
        (["0011"] * 3 + ["0101"], (1, 1, 0), 2),
        (["0011", "1100", "0022", "2200"], (0, 2**0.5, 2**0.5), 0),
    ],
)
def test_scores_by_hand(spark, columns, want, res):
    row = inference.score_blocks(codes_of(spark, columns), quartets.all_quartets(spark, 4), 4, 1).first()
    assert (row.s0, row.s1, row.s2) == pytest.approx(want, abs=1e-6)
    assert (row.res, row.nsnps) == (res, len(columns))


def test_known_scores_of_many_sites(spark, tmp_path):
    """A quartet with 12,000 line items and more: the squares lie beyond what a double keeps of a score's own square."""
    lines = spark.range(60_000).select((F.col("id") % 5).alias("l_orderkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"), F.expr("timestamp '2020-01-01' + make_interval(0, 0, 0, int(id % 31))").alias("l_shipdate"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("quartet_scores_known", "quartet_scores_capped"):
        want = con.execute(oracles.ORACLES[name])
        got = queries.QUERIES[name](spark, str(tmp_path)).select([c[0] for c in want.description])
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_no_data(spark):
    row = inference.score_blocks(codes_of(spark, ["0N11", "2222"]), quartets.all_quartets(spark, 4), 4, 1).first()
    assert (row.s0, row.s1, row.s2, row.nsnps) == (0.001, 0.001, 0.001, 0) and row.res in (0, 1, 2)


def random_columns(seed, n, sites):
    rng = random.Random(seed)
    return ["".join(rng.choice("0011223N") for _ in range(n)) for _ in range(sites)]


@pytest.mark.parametrize("unlinked", [False, True])
@pytest.mark.parametrize("cells, small", [(1 << 20, 1 << 22), (70, 9)])
@pytest.mark.parametrize("locus", [lambda k: k // 6, lambda k: k % 7, lambda k: k * k % 5])
def test_dense_equals_blocks_equals_joins(spark, monkeypatch, unlinked, cells, small, locus):
    monkeypatch.setattr(packed, "BLOCK_CELLS", cells)  # ten sites a block: loci go on in other ones, in runs or not
    monkeypatch.setattr(packed, "SMALL", small)
    monkeypatch.setattr(packed, "PART", 5)
    monkeypatch.setattr(packed, "TILE", 3)
    columns = random_columns(1, 7, 90)
    codes = codes_of(spark, columns, [locus(k) for k in range(90)])
    q = quartets.all_quartets(spark, 7)
    one = plain(inference.score_blocks(codes, packed.Ranks(7), 7, 5, unlinked).collect())
    assert one == plain(inference.score_blocks(codes, q.drop("rank"), 7, 5, unlinked).collect())
    two = plain(kernel.score_dense(codes, packed.Ranks(7), 7, 5, unlinked).select("i0", "i1", "i2", "i3", "s0", "s1", "s2", "res", "nsnps").collect())
    assert len(one) == math.comb(7, 4) and np.allclose(np.array(one)[:, [0, 1, 2, 3, 8]], np.array(two)[:, [0, 1, 2, 3, 8]])
    assert np.allclose(np.array(one)[:, 4:7], np.array(two)[:, 4:7], atol=1e-5)
    count = counts.unlinked_counts if unlinked else counts.pattern_counts
    some = q.where("rank % 3 = 0")
    asked = count(codes, some, 7).select("i0", "i1", "i2", "i3", "r", "c", "n")
    joined = count(codes).join(some.select(*quartets.NAMES), quartets.NAMES).select(asked.columns)
    assert plain(asked.collect()) == plain(joined.collect())


def test_blocks_of_replicates(spark):
    codes = codes_of(spark, random_columns(4, 6, 40)).withColumn("rep", F.col("site") % 2)
    got = counts.pattern_counts(codes, quartets.all_quartets(spark, 6), 6)
    want = counts.pattern_counts(codes)
    assert plain(got.select(sorted(got.columns)).collect()) == plain(want.select(sorted(got.columns)).collect())


def test_blocks_are_added_up_where_they_are_counted(spark, monkeypatch):
    """Quartets by parts, blocks by groups: a row a quartet and group leaves the tasks, however many blocks there are."""
    codes = codes_of(spark, random_columns(6, 7, 90), [s // 5 for s in range(90)])
    want = plain(counts.pattern_counts(codes).collect())
    for held, most in ((1 << 14, 2 * spark.sparkContext.defaultParallelism), (3, 1)):
        monkeypatch.setattr(packed, "HELD", held)
        seen = []
        added = packed._added
        monkeypatch.setattr(packed, "_added", lambda rows, keys: added(seen.append(rows) or rows, keys))
        got = packed.sparse_counts(packed.cell_counts(codes, packed.Ranks(7), 7, block_cells=14), 7)
        assert plain(got.select("i0", "i1", "i2", "i3", "r", "c", "n").collect()) == want
        assert not seen or seen[0].groupBy("rank").count().agg(F.max("count")).first()[0] <= most
        monkeypatch.setattr(packed, "_added", added)


@pytest.mark.parametrize("cells", [1 << 16, 7 * 3])
def test_random_sites_by_blocks(spark, monkeypatch, cells):
    """Random sites by packed blocks are those of the joins, with loci inside blocks and torn, of one matrix and of replicates, and of the quartets asked for."""
    monkeypatch.setattr(packed, "HASHED_CELLS", cells)
    codes = codes_of(spark, random_columns(8, 7, 60), [s % 4 if s < 30 else s // 6 for s in range(60)])
    for own in (codes, codes.withColumn("rep", F.col("site") % 2 + 3)):
        want = counts.random_site_counts(own, 11)
        got = counts.random_site_counts(own, 11, packed.Ranks(7), 7).select(want.columns)
        assert plain(got.collect()) == plain(want.collect())
    some = quartets.all_quartets(spark, 7).where("rank % 3 = 0")
    asked = counts.random_site_counts(codes, 11, some, 7)
    joined = counts.random_site_counts(codes, 11).join(some.select(*quartets.NAMES), quartets.NAMES).select(asked.columns)
    assert plain(asked.collect()) == plain(joined.collect())


@pytest.mark.parametrize("unlinked, wanted", [(False, 60), (True, 60), (False, 0)])
def test_runs_by_blocks_and_dense_and_together_agree(spark, tmp_path, monkeypatch, unlinked, wanted):
    snps = fixtures.snps(spark, SF)
    monkeypatch.setattr(packed, "BLOCK_CELLS", 12 * 900)
    monkeypatch.setattr(inference, "BLOCK_CELLS", 0)
    ways = {"a": 0, "b": 1 << 28}
    assert inference.by_multiplicities(1, 60, 0) and not inference.by_multiplicities(1, 60, 1)
    for name, cells in ways.items():
        assert inference.run(snps, 12, str(tmp_path / name), 2, wanted, 3, unlinked, cells, together=1) == [0, 1, 2]
    one, two = (plain(files.read_quartets(spark, str(tmp_path / x)).select("rep", *quartets.NAMES, "s0", "s1", "s2", "res", "nsnps").collect()) for x in ways)
    assert len(one) == 3 * (wanted or 495) and np.allclose(np.array(one), np.array(two), atol=1e-5)


def test_replicates_together_start_again_where_they_stopped(spark, tmp_path, monkeypatch):
    snps, out, kept = fixtures.snps(spark, SF), str(tmp_path / "q"), str(tmp_path / "c")
    write = inference.commit_all

    def lost(rows, path, reps):  # files of a replicate without its manifest row
        if reps == [2]:
            rows.where("i0 = 0").write.mode("append").partitionBy("rep").parquet(path)
            raise RuntimeError("lost")
        write(rows, path, reps)

    with monkeypatch.context() as m:
        m.setattr(inference, "commit_all", lost)
        with pytest.raises(RuntimeError):
            inference.run(snps, 12, out, 2, 40, 5, counts_out=kept, together=1)
    assert files.committed(spark, out) == {0, 1}
    assert inference.run(snps, 12, out, 2, 40, 5, counts_out=kept) == [2] and files.damaged(spark, out) == []
    whole = str(tmp_path / "w")
    assert inference.run(snps, 12, whole, 2, 40, 5) == [0, 1, 2]
    one, two = (plain(files.read_quartets(spark, x).select("rep", *quartets.NAMES, "s0", "s1", "s2", "nsnps").collect()) for x in (out, whole))
    assert len(one) == 120 and np.allclose(np.array(one), np.array(two), atol=1e-5)
    sums = spark.read.parquet(kept).groupBy("rep", *quartets.NAMES).agg(F.sum("n")).collect()
    assert plain(sums) == [r[:5] + r[8:] for r in two if r[8]]


def test_replicates_of_a_matrix_without_bases(spark, tmp_path):
    snps = spark.createDataFrame([(i, 0, s, 78) for i in range(5) for s in range(3)], "sample_idx INT, locus BIGINT, site BIGINT, base INT")
    for wanted, k in ((0, 5), (2, 2)):
        assert inference.run(snps, 5, str(tmp_path / str(wanted)), 2, wanted, 5) == [0, 1, 2]
        rows = files.read_quartets(spark, str(tmp_path / str(wanted))).collect()
        assert len(rows) == 3 * k and {(r.s0, r.nsnps) for r in rows} == {(kernel.NO_DATA, 0)}


def test_a_matrix_too_large_for_executors_is_refused(spark, monkeypatch):
    monkeypatch.setattr(kernel, "DENSE_CELLS", 10)
    with pytest.raises(ValueError):
        kernel.score_dense(codes_of(spark, ["0011"] * 9), quartets.all_quartets(spark, 4), 4, 1)


def test_compressed_columns_count_alike(spark):
    codes = codes_of(spark, random_columns(2, 5, 60) * 2)
    assert plain(counts.pattern_counts(codes).collect()) == plain(counts.pattern_counts(codes, compress=False).collect())


def test_singular_values_keep_the_norm_and_ignore_the_order():
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 9, (5, 256))
    m = cells.reshape(-1, 4, 4, 4, 4)
    for p in itertools.permutations(range(4)):
        moved = m.transpose(0, *[k + 1 for k in p]).reshape(-1, 256)
        assert np.allclose(np.sort(kernel.scores(cells), axis=1), np.sort(kernel.scores(moved), axis=1))
    assert np.allclose(kernel.scores(cells, 0) ** 2, (cells**2).sum(axis=1, keepdims=True))


@pytest.mark.parametrize("n", [4, 5, 8, 12])
def test_unrank_is_lexicographic(spark, n):
    rows = quartets.all_quartets(spark, n).withColumn("again", quartets.rank_of(n)).orderBy("rank").collect()
    assert [tuple(r[c] for c in quartets.NAMES) for r in rows] == list(itertools.combinations(range(n), 4)) and all(r.rank == r.again for r in rows)
    assert [tuple(q) for q in packed.unranked_rows(np.arange(math.comb(n, 4)), n).tolist()] == list(itertools.combinations(range(n), 4))


def test_unrank_at_the_limit():
    total = math.comb(568, 4)
    assert packed.unranked_rows(np.array([0, total - 1]), 568).tolist() == [[0, 1, 2, 3], [564, 565, 566, 567]]
    assert len(packed.Ranks(568)) == total and len(packed.Ranks(8, 60, 99)) == 10 and len(packed.Ranks(8, 80)) == 0


def test_rank_intervals_add_up(spark):
    codes = codes_of(spark, random_columns(5, 9, 50))
    whole = plain(counts.pattern_counts(codes, packed.Ranks(9), 9).collect())
    parts = [counts.pattern_counts(codes, packed.Ranks(9, lo, lo + 40), 9) for lo in range(0, 126, 40)]
    assert sorted(x for p in parts for x in plain(p.collect())) == whole
    assert counts.pattern_counts(codes, packed.Ranks(9, 7, 7), 9).count() == 0
    nothing = codes.where("code > 9")
    assert {r.nsnps for r in inference.score_blocks(nothing, packed.Ranks(9), 9, 1).collect()} == {0}


def test_totals_of_a_universe(spark, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK_CELLS", 100)
    codes = codes_of(spark, random_columns(6, 8, 40))
    want: dict = {}
    for r in counts.pattern_counts(codes).collect():
        own = want.setdefault((r.i0, r.r, r.c), [0, 0, 0])
        for k, x in enumerate((1, r.n, r.n * ((r.i1 * 64 + r.i2 * 8 + r.i3) % 1009))):
            own[k] += x
    got = {(r.i0, r.r, r.c): [r.quartets, r.n, r.marked] for r in packed.pattern_totals(packed.cell_counts(codes, packed.Ranks(8), 8), 8).collect()}
    assert got == want


def test_states_of_a_locus_merge_in_any_order(spark, monkeypatch):
    # a locus whose sites lie in many blocks, of which the first that counts differs from quartet to quartet
    monkeypatch.setattr(packed, "BLOCK_CELLS", 18)
    rng = random.Random(11)
    for _ in range(3):
        loci = [rng.randrange(6) for _ in range(60)]
        codes = codes_of(spark, random_columns(rng.randrange(99), 6, 60), loci)
        got = counts.unlinked_counts(codes, packed.Ranks(6), 6)
        want = counts.unlinked_counts(codes)
        assert plain(got.select(want.columns).collect()) == plain(want.collect())


@pytest.mark.parametrize("cells", [1 << 20, 200])
def test_multiplicities_count_as_resampled_sites_do(spark, monkeypatch, cells):
    monkeypatch.setattr(packed, "BLOCK_CELLS", cells)
    monkeypatch.setattr(packed, "PART", 20)
    rng = random.Random(12)
    rows = [(i, s // 5 % 4, s, rng.choice((65, 67, 71, 84, 78, 45, 82, 75, 83, 89, 87, 77, 66))) for s in range(60) for i in range(6) if rng.random() < 0.95]
    snps = spark.createDataFrame(rows, "sample_idx INT, locus BIGINT, site BIGINT, base INT")
    got = packed.sparse_counts(multiplicity.replicate_counts(snps, packed.Ranks(6), 6, 20, 4), 6)
    sites = encode.encode(bootstrap.resampled(snps, bootstrap.draws(snps, 20, 4), 4), 4)
    want = counts.pattern_counts(sites.select("rep", F.col("rlocus").alias("locus"), F.col("rsite").alias("site"), "sample_idx", "code"))
    assert plain(got.select(want.columns).collect()) == plain(want.collect())
    few = multiplicity.replicate_counts(snps, packed.rank_rows(spark, packed.Ranks(6, 3, 5), 6), 6, 2, 4)
    assert {(r.rep, r.rank) for r in few.collect()} == {(rep, q) for rep in (1, 2) for q in (3, 4)}
    # some replicates, each with quartets of its own
    own = spark.createDataFrame([(rep, q) for rep in (3, 9, 17) for q in range(rep % 4, 15, 2)], "rep BIGINT, rank BIGINT")
    part = packed.sparse_counts(multiplicity.replicate_counts(snps, own, 6, [17, 3, 9], 4), 6).select(want.columns)
    wanted = want.withColumn("rank", quartets.rank_of(6)).join(own, ["rep", "rank"]).select(want.columns)
    assert plain(part.collect()) == plain(wanted.collect())
    empty = multiplicity.replicate_counts(snps.where("sample_idx < 5"), packed.Ranks(6), 6, [2, 5], 4, empty=True).collect()
    assert sorted((r.rep, r.rank) for r in empty) == [(rep, q) for rep in (2, 5) for q in range(15)]


@pytest.mark.parametrize("n, seed", [(4, 1), (5, 2), (9, 3), (14, 4)])
def test_the_tree_index_says_what_splits_say(n, seed):
    rng = random.Random(seed)
    for k in range(12):
        root = random_tree(rng, n)
        if k % 3 == 1:  # a root on an edge
            root = trees.Node(children=[root.children[0], trees.Node(children=root.children[1:])])
        if k % 3 == 2 and len(root.children[-1].children) == 2:  # a polytomy
            root.children += root.children.pop().children
        sides = trees.edge_order(trees.splits(root))
        q = np.array(list(itertools.combinations(range(n), 4)) + [(0, 1, 2, n + 3)])
        r, span, edge = treeindex.TreeIndex(root).locate(q)
        for i, four in enumerate(q.tolist()):
            cut = [(e, frozenset(s) & set(four)) for e, s in enumerate(sides) if len(frozenset(s) & set(four)) == 2]
            if four[3] >= n:
                cut = []
            assert span[i] == len(cut)
            pairs = {frozenset((c, frozenset(four) - c)) for _, c in cut}
            assert len(pairs) <= 1 and (r[i] == -1) == (not cut)
            if cut:
                mate = next(x for x in (cut[0][1] if four[0] in cut[0][1] else set(four) - cut[0][1]) if x != four[0])
                assert r[i] == four.index(mate) - 1
            assert edge[i] == (cut[0][0] if len(cut) == 1 else -1)


def test_a_large_tree_is_mapped_without_listing_its_quartets(spark):
    root = random_tree(random.Random(9), 300)
    index = treeindex.TreeIndex(root)
    rng = np.random.default_rng(1)
    q = np.sort(np.stack([rng.choice(300, 4, replace=False) for _ in range(3000)]), axis=1)
    rows = treeindex.located(spark.createDataFrame([tuple(map(int, x)) for x in q], "i0 INT, i1 INT, i2 INT, i3 INT"), index).collect()
    sides = [np.isin(np.arange(300), s) for s in trees.edge_order(trees.splits(root))]
    inside = np.stack([s[np.array([r[:4] for r in rows])].sum(axis=1) == 2 for s in sides], axis=1)
    assert [r.span for r in rows] == inside.sum(axis=1).tolist()
    assert [r.edge_id for r in rows] == [int(x.argmax()) if x.sum() == 1 else None for x in inside]


def test_only_whole_replicates_count(spark, tmp_path, monkeypatch):
    snps, out = fixtures.snps(spark, SF), str(tmp_path / "q")
    with pytest.raises(RuntimeError):  # the driver dies after a replicate's files and before its manifest row
        with monkeypatch.context() as m:
            m.setattr(files, "_state", lambda rows: (_ for _ in ()).throw(RuntimeError("lost")))
            inference.run(snps, 12, out, 0, 60, 3)
    assert files.committed(spark, out) == set() and files.exists(spark, out)
    assert inference.run(snps, 12, out, 1, 60, 3) == [0, 1] and inference.run(snps, 12, out, 2, 60, 3) == [2]
    whole = plain(files.read_quartets(spark, out).select("rep", *quartets.NAMES, "nsnps").collect())
    assert len(whole) == 180 and files.damaged(spark, out) == []
    # files of a replicate without a manifest row aren't read, and are replaced
    files.write_quartets(files.read_quartets(spark, out).where("rep = 0").drop("rep").limit(7), out, 5)
    assert plain(files.read_quartets(spark, out).select("rep", *quartets.NAMES, "nsnps").collect()) == whole
    assert inference.run(snps, 12, out, 5, 60, 3) == [3, 4, 5] and files.read_quartets(spark, out).count() == 360
    next((tmp_path / "q" / "rep=1").glob("*.parquet")).unlink()
    assert files.damaged(spark, out) == [1]


def test_random_quartets_of_a_large_universe(spark):
    got = quartets.random_quartets(spark, 150, 500, 3).collect()
    assert len({tuple(r) for r in got}) == 500 and all(0 <= r.i0 < r.i1 < r.i2 < r.i3 < 150 for r in got)
    assert sorted(map(tuple, quartets.random_quartets(spark.newSession(), 150, 500, 3).repartition(3).collect())) == sorted(map(tuple, got))
    assert quartets.random_quartets(spark, 6, 99, 3).count() == 15


def test_random_quartets_of_a_large_universe_in_hash_order(spark, tmp_path, monkeypatch):
    """The queries take what their SQL takes beyond the universes that runs put in a hash order."""
    monkeypatch.setattr(quartets, "SORTED", 1000)
    n = 20
    ranks = sorted(range(math.comb(n, 4)), key=lambda r: (hashlib.md5(f"7:1:{r}".encode()).hexdigest(), r))[:300]
    spark.range(n).select(F.col("id").alias("item_id")).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.range(300).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    got = queries.quartets_random(spark, str(tmp_path)).collect()
    assert sorted(r.rank for r in got) == sorted(ranks)
    assert all(list(packed.unranked_rows(np.array([r.rank]), n)[0]) == [r.i0, r.i1, r.i2, r.i3] for r in got)
    placed = queries.quartets_random_sorted(spark, str(tmp_path)).orderBy("place").collect()
    assert [r.place for r in placed] == list(range(300)) and [tuple(r)[:4] for r in placed] == sorted(tuple(r)[:4] for r in placed)


def test_budget_limits():
    assert quartets.budget(568)["total"] < quartets.MOST
    with pytest.raises(ValueError):
        quartets.budget(569)
    assert quartets.budget(8, 10**6)["taken"] == 70
    assert quartets.budget(30, default="rough")["taken"] == int(30**2.8) and quartets.budget(8, default="rough")["taken"] == 70


def test_equal_splits(spark):
    got = queries.quartets_equal_splits(spark, SF).collect()
    assert len(got) == len({tuple(r)[:4] for r in got}) == 200
    per = {}
    for r in got:
        per[r.edge_id] = per.get(r.edge_id, 0) + 1
    assert all(0 < per[e] <= 23 for e in range(9))
    root = trees.parse_newick(fixtures.TREE)
    for r in got:
        if r.edge_id is not None:
            assert len(set(trees.edge_order(trees.splits(root))[r.edge_id]) & set(tuple(r)[:4])) == 2


def test_partitioning_changes_nothing(spark):
    snps = fixtures.snps(spark, SF)
    from cladeweave.operators import bootstrap

    one = bootstrap.replicate_codes(snps, 2, 5)
    two = bootstrap.replicate_codes(snps.repartition(7, "site"), 2, 5)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_other_bytes_are_missing(spark):
    snps = spark.createDataFrame([(0, 0, i, b) for i, b in enumerate((65, 67, 71, 84, 45, 78, 66, 46, 0, 95, 97, 86))], "sample_idx INT, locus BIGINT, site BIGINT, base INT")
    assert [r.code for r in encode.encode(snps, 1).orderBy("site").collect()] == [0, 1, 2, 3] + [None] * 8


def random_tree(rng, n):
    nodes = [trees.Node(name=str(i)) for i in range(n)]
    while len(nodes) > 3:
        a, b = nodes.pop(rng.randrange(len(nodes))), nodes.pop(rng.randrange(len(nodes)))
        nodes.append(trees.Node(children=[a, b]))
    return trees.Node(children=nodes)


def quartets_of_tree(root, n):
    sides = [frozenset(s) for s in trees.splits(root)]
    rows = []
    for q in itertools.combinations(range(n), 4):
        for s in sides:
            inside = [x for x in q if x in s]
            if len(inside) == 2:
                outside = [x for x in q if x not in s]
                rows.append((*inside, *outside))
                break
    return np.array(rows)


@pytest.mark.parametrize("n, seed", [(5, 1), (8, 2), (12, 3), (16, 4), (22, 5), (30, 6)])
def test_supertree_recovers_a_tree(n, seed):
    root = random_tree(random.Random(seed), n)
    q = quartets_of_tree(root, n)
    got = supertree.max_cut_splits(q, np.ones(len(q)), list(range(n)))
    assert set(got) == set(trees.splits(root))


@pytest.mark.parametrize("rows", [10**6, 300])
def test_supertrees_of_replicates(spark, rows):
    roots = [random_tree(random.Random(seed), 13) for seed in (21, 22)]
    table = [(rep, *map(int, r), 1.0) for rep, root in enumerate(roots) for r in quartets_of_tree(root, 13)]
    splits = spark.createDataFrame(table, "rep INT, a INT, b INT, c INT, d INT, weight DOUBLE")
    got = {r.rep: r.newick for r in supertree.supertrees(splits, rows).collect()}
    for rep, root in enumerate(roots):
        assert set(trees.splits(trees.parse_newick(got[rep]))) == set(trees.splits(root))


def test_supertree_with_noise():
    rng = random.Random(8)
    root = random_tree(rng, 14)
    q = quartets_of_tree(root, 14)
    for k in range(len(q)):
        if rng.random() < 0.1:
            q[k] = q[k][[0, 2, 1, 3]]
    got = set(supertree.max_cut_splits(q, np.ones(len(q)), list(range(14))))
    assert len(got & set(trees.splits(root))) >= 9


@pytest.mark.parametrize("noise", [0.0, 0.1, 0.2, 0.3, 0.4])
def test_local_search_on_noisy_quartets(spark, noise):
    """Trees of 16 tips: how far they are from the true one before and after, and the weight that they satisfy."""
    rng = random.Random(int(noise * 100))
    rows, start, truth = [], {}, {}
    for rep in range(3):
        root = random_tree(rng, 16)
        truth[rep] = set(trees.splits(root))
        q = quartets_of_tree(root, 16)
        for k in range(len(q)):
            if rng.random() < noise:
                q[k] = q[k][[0, 2, 1, 3]] if rng.random() < 0.5 else q[k][[0, 3, 1, 2]]
        start[rep] = trees.write_newick(trees.tree_of_splits(supertree.max_cut_splits(q, np.ones(len(q)), list(range(16))), range(16)))
        rows += [(rep, *trees.sort_quartet(*map(int, r)), 1.0) for r in q]
    table = spark.createDataFrame(rows, "rep BIGINT, i0 INT, i1 INT, i2 INT, i3 INT, res INT, weight DOUBLE")
    end = refine.refined(table, start)
    before, after = refine.satisfied(table, start), refine.satisfied(table, end)
    far = lambda texts: sum(len(set(trees.splits(trees.parse_newick(texts[rep]))) ^ truth[rep]) for rep in texts)
    assert all(after[rep] >= before[rep] for rep in range(3))
    assert far(end) <= far(start) and (noise > 0.2 or far(end) == 0)
    told = {rep: sum(r[0] == rep and any(set(side) & set(r[1:5]) in ({r[1], r[2 + r[5]]}, set(r[1:5]) - {r[1], r[2 + r[5]]}) for side in trees.splits(trees.parse_newick(end[rep]))) for r in rows) for rep in range(3)}
    assert told == after


def test_trades_lead_from_any_start_to_the_tree(spark):
    rng = random.Random(31)
    roots = [random_tree(rng, 12) for _ in range(4)]
    starts = {rep: trees.write_newick(random_tree(rng, 12)) for rep in range(4)}
    rows = [(rep, *trees.sort_quartet(*map(int, r)), 1.0) for rep, root in enumerate(roots) for r in quartets_of_tree(root, 12)]
    table = spark.createDataFrame(rows, "rep BIGINT, i0 INT, i1 INT, i2 INT, i3 INT, res INT, weight DOUBLE")
    end = refine.refined(table, starts)
    shared = [len(set(trees.splits(trees.parse_newick(end[rep]))) & set(trees.splits(root))) for rep, root in enumerate(roots)]
    assert sum(shared) > 27  # of 36; a local search may stop short of the tree
    polytomy = refine.refined(table.where("rep = 0"), {0: "(0,1,2,3,4,5,6,7,8,9,10,11);"})
    assert len(trees.splits(trees.parse_newick(polytomy[0]))) == 0


def test_newick_round_trip():
    text = "((a:1,'b c':2)x:0.5,(d,e),f);"
    assert trees.write_newick(trees.parse_newick(text)) == text
    with pytest.raises(ValueError):
        trees.parse_newick("((a,b);")
    with pytest.raises(KeyError):
        trees.relabel(trees.parse_newick("(a,b);"), {"a": 1})


def test_rooting():
    root = trees.parse_newick("((a,b),(c,d),e);")
    assert {frozenset(n.tips()) for n in trees.rooted(root, "~[ab]").children} == {frozenset("ab"), frozenset("cde")}
    assert {frozenset(n.tips()) for n in trees.rooted(root, "c").children} == {frozenset("c"), frozenset("abde")}
    for bad in ("z", "~[ac]"):
        with pytest.raises(ValueError):
            trees.rooted(root, bad)


def test_quadripartitions_of_a_polytomy():
    root = trees.parse_newick("((0,1,2),3,4);")
    assert len(trees.quadripartitions(root)) == 3


def test_consensus_of_conflicting_trees(spark):
    texts = ["((0,1),(2,3),4);", "((0,1),(2,3),4);", "((0,2),(1,3),4);"]
    freq = [(tuple(r.side), r.freq) for r in inference.replicate_split_frequencies(spark, texts).collect()]
    assert set(trees.splits(consensus.consensus_tree(freq, range(5)))) == set(trees.splits(trees.parse_newick(texts[0])))
    held = consensus.with_support(texts[2], inference.replicate_split_frequencies(spark, texts), spark)
    assert [n.features["support"] for n in held.nodes() if n.features] == [0.333333, 0.333333]


def test_concordance_edge_cases(spark):
    tree = treeindex.TreeIndex(trees.parse_newick("((0,1),(2,3));"))
    row = lambda *r: spark.createDataFrame([(0, 0, 1, 2, 3, *r)], "rep BIGINT, i0 INT, i1 INT, i2 INT, i3 INT, s0 DOUBLE, s1 DOUBLE, s2 DOUBLE, res INT, nsnps BIGINT")
    perfect, tips = concordance.concordance(row(0.0, 1.0, 1.0, 0, 9), tree)
    got = perfect.first()
    assert (got.nu, got.conc, got.qc, got.qd, got.qi) == (1, 0, None, 1.0, 0.0) and tips.count() == 0
    lone = row(0.001, 0.001, 0.001, 1, 0)
    assert concordance.concordance(lone, tree)[0].first().disc1 == 1
    assert concordance.concordance(lone, tree, need_data=True)[0].first().nu == 1
    assert concordance.concordance(row(1.0, 2.0, 3.0, 2, 5), tree)[0].first().qc == -1.0


def test_tallies_add_up(spark):
    rows = queries._mapped(spark, SF, 2, 2.0)
    for r in concordance.edge_tallies(rows).collect():
        assert r.conc + r.disc1 + r.disc2 + r.nu == r.nqrts


def test_weights_reject_unknown_strategy():
    with pytest.raises(ValueError):
        sc.weight(7)


def test_files_round_trip(spark, tmp_path):
    q = fixtures.scored_quartets(spark, SF).where("rep = 1")
    files.write_quartets_tsv(q, str(tmp_path / "q.tsv"))
    back = files.read_quartets_tsv(spark, str(tmp_path / "q.tsv"))
    assert plain(back.collect()) == plain(q.select(*back.columns).collect())
    (tmp_path / "imap").write_text("x a\nx  b\n\ny\tc\n")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "sample_idx INT, name STRING")
    assert files.read_population_map(spark, str(tmp_path / "imap"), names).count() == 3
    with pytest.raises(ValueError):
        files.read_population_map(spark, str(tmp_path / "imap"), names.where("name <> 'b'"))


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts0\ts1\ts2\ts3
c1\t5\t.\tA\tG\t.\t.\t.\tGT:DP\t0/0:3\t0/1:2\t1|1:1\t./.:0
c1\t120\t.\tC\tT,G\t.\t.\t.\tGT\t0/2\t2/2\t1/1\t0/0
c2\t7\t.\tT\tTA\t.\t.\t.\tGT\t0/0\t0/1\t1/1\t0
"""


def test_vcf(spark, tmp_path):
    (tmp_path / "x.vcf").write_text(VCF)
    cells, samples = files.read_vcf(spark, str(tmp_path / "x.vcf"), 100)
    rows = files.numbered_sites(cells)
    got = {(r.sample_idx, r.site): (r.locus, r.base) for r in rows.collect()}
    assert [r.name for r in samples.orderBy("sample_idx").collect()] == ["s0", "s1", "s2", "s3"]
    assert [got[i, 0] for i in range(4)] == [(0, 65), (0, 82), (0, 71), (0, 78)]
    assert [got[i, 1] for i in range(4)] == [(1, 83), (1, 71), (1, 84), (1, 67)]
    assert [got[i, 2] for i in range(4)] == [(2, 84), (2, 78), (2, 78), (2, 84)]


def test_vcf_records_at_one_position_are_sites_of_their_own(spark, tmp_path):
    head = VCF.splitlines()[:2]
    rows = ["c1\t9\t.\tA\tG\t.\t.\t.\tGT\t0/0\t1/1\t0/0\t1/1", "c1\t9\t.\tA\tT\t.\t.\t.\tGT\t0/0\t0/0\t1/1\t1/1"]
    (tmp_path / "x.vcf").write_text("\n".join([*head, *rows, rows[0], ""]))
    cells, _ = files.read_vcf(spark, str(tmp_path / "x.vcf"))
    snps = files.numbered_sites(cells)
    assert snps.count() == 12 and snps.select("site").distinct().count() == 3
    (row,) = inference.score_blocks(encode.encode(snps, 1), quartets.all_quartets(spark, 4), 4, 1).collect()
    assert row.nsnps == 3


def test_numbering_in_bins(spark):
    rows = spark.createDataFrame([(i * 37 % 1000,) for i in range(1000)], "x BIGINT")
    got = numbering.numbered(rows, "place", {"bin": F.expr("x div 64")}, "x").collect()
    assert all(r.place == r.x for r in got) and len(got) == 1000
    for k in (0, 1, 63, 64, 65, 999, 1000, 2000):
        assert sorted(r.x for r in numbering.first_rows(rows, k, F.expr("x div 64").cast("int"), "x").collect()) == list(range(min(k, 1000)))


def test_hdf5(spark, tmp_path):
    """With h5py, or a stand-in that reads the same names from .npz files."""
    import h5py

    snps, loci = np.array([[65, 67, 71], [84, 78, 82]], np.uint8), np.array([[1, 0, 5], [1, 1, 9], [2, 0, 3]])
    path = str(tmp_path / "m.hdf5")
    with h5py.File(path, "w") as f:
        f.create_dataset("snps", data=snps).attrs["names"] = ["a", "b"]
        f.create_dataset("snpsmap", data=loci)
    assert files.hdf5_names(path) == ["a", "b"]
    assert files.read_hdf5(spark, "file://" + path, columns=3).rdd.getNumPartitions() == 2  # chunks of two columns stay whole
    got = {(r.sample_idx, r.site): (r.locus, r.base) for r in files.read_hdf5(spark, path).collect()}
    assert got == {(i, k): (int(loci[k, 0]) - 1, int(snps[i, k])) for i in range(2) for k in range(3)}


def blocked(data, size):
    """Block-gzipped bytes, as bgzip writes them, with blocks of so many bytes of data."""
    out = b""
    for part in [data[k : k + size] for k in range(0, len(data), size)] + [b""]:
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, 18 + len(body) + 8 - 1)
        out += head + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.mark.parametrize("size", [7, 40, 300, 60_000])
def test_lines_of_blocks_fall_to_one_part_each(size):
    rng = random.Random(size)
    text = b"\n".join(bytes(rng.choice(b"ACGT\x1f\x8b\x08\x04") for _ in range(rng.choice([0, 3, 20, 200]))) for _ in range(120))
    for data in (text, text + b"\n", b"", b"one", b"\n\n", b"x" * 500):
        raw = blocked(data, size)
        assert gzip.decompress(raw) == data
        want = data.split(b"\n")[:-1] if data.endswith(b"\n") else data.split(b"\n") if data else []
        for step in (1, 13, 64, 1000, len(raw)) if len(raw) < 4000 else (97, 1000, len(raw)):
            file = pa.BufferReader(raw)
            got = [x for lo in range(0, len(raw), step) for x in datasources.lines_of(file, len(raw), lo, min(lo + step, len(raw)))]
            assert got == want, (size, step)


def test_block_gzipped_vcf(spark, tmp_path):
    rng = random.Random(3)
    rows = [f"c{k % 3}\t{k + 1}\t.\tA\tG,T\t.\t.\t.\tGT\t" + "\t".join(rng.choice(["0/0", "0/1", "1/1", "2/1", "./."]) for _ in range(4)) for k in range(400)]
    text = "\n".join([*VCF.splitlines()[:2], *rows]) + "\n"
    (tmp_path / "a.vcf").write_text(text)
    (tmp_path / "b.vcf.gz").write_bytes(blocked(text.encode(), 900))
    (tmp_path / "c.vcf.gz").write_bytes(gzip.compress(text.encode()))
    assert datasources.is_blocked(str(tmp_path / "b.vcf.gz")) and not datasources.is_blocked(str(tmp_path / "c.vcf.gz"))
    want = plain_unsorted(files.read_vcf(spark, str(tmp_path / "a.vcf"))[0].collect())
    for name in ("b", "c"):
        cells, samples = files.read_vcf(spark, f"file://{tmp_path}/{name}.vcf.gz", split=500)
        assert sorted(plain_unsorted(cells.collect()), key=str) == sorted(want, key=str) and samples.count() == 4
    assert files.text_lines(spark, str(tmp_path / "b.vcf.gz"), 500).rdd.getNumPartitions() > 5
    broken = bytearray((tmp_path / "b.vcf.gz").read_bytes())
    broken[200] ^= 1
    (tmp_path / "d.vcf.gz").write_bytes(bytes(broken))
    with pytest.raises(Exception):
        files.text_lines(spark, str(tmp_path / "d.vcf.gz"), 500).collect()


def test_stream_equals_batch(spark, tmp_path):
    from cladeweave.streaming.tallies import quartet_stream, streaming_tallies

    q = fixtures.scored_quartets(spark, SF).withColumn("rep", F.col("rep").cast("long"))
    for rep in range(4):
        files.commit(q.where(F.col("rep") == rep), str(tmp_path / "q"), rep)
    tree = treeindex.TreeIndex(trees.parse_newick(fixtures.TREE))
    tallies = streaming_tallies(quartet_stream(spark, str(tmp_path / "q")), tree)
    query = tallies.writeStream.outputMode("complete").format("memory").queryName("tallies").start()
    query.processAllAvailable()
    query.stop()
    want = concordance.edge_tallies(concordance.mapped(q, tree))
    assert plain(spark.table("tallies").collect()) == plain(want.collect())


def test_command_line(spark, tmp_path, capsys):
    from cladeweave.cli import main

    fixtures.snps(spark, SF).write.parquet(str(tmp_path / "m"))
    main(["init", str(tmp_path / "m"), "-n", "p", "-w", str(tmp_path), "-r", "3"])
    project = str(tmp_path / "p.json")
    main(["run", project, "-b", "1"])
    assert files.read_quartets(spark, str(tmp_path / "p.quartets")).count() == 2 * 495
    main(["run", project, "-b", "2"])
    assert "[2]" in capsys.readouterr().out
    assert (tmp_path / "p.boots.nwk").read_text().count(";") == 2 and "support" in (tmp_path / "p.cons.nwk").read_text()
    assert len(trees.parse_newick((tmp_path / "p.best.nwk").read_text()).tips()) == 12 and "support" in (tmp_path / "p.supports.nwk").read_text()
    main(["--log-level", "ERROR", "run", project, "-b", "1", "--force", "--save-counts"])
    assert "[0, 1]" in capsys.readouterr().out
    assert files.read_quartets(spark, str(tmp_path / "p.quartets")).count() == 2 * 495
    assert spark.read.parquet(str(tmp_path / "p.counts")).select("rep").distinct().count() == 2
    main(["supertree", project, "-i", "1"])
    tree = capsys.readouterr().out.strip()
    assert len(trees.parse_newick(tree).tips()) == 12
    (tmp_path / "t.nwk").write_text(tree)
    main(["consensus", project])
    main(["consensus", project, "-t", str(tmp_path / "t.nwk")])
    assert capsys.readouterr().out.count("support") > 0
    main(["concordance", project, "-t", str(tmp_path / "t.nwk")])
    assert "qc=" in capsys.readouterr().out
    main(["info", project, "-s"])
    assert "samples" in capsys.readouterr().out


def test_nothing_imports_the_text_operators():
    import pathlib

    root = pathlib.Path(queries.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
