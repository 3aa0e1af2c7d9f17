"""MinHash near-dedup by bottom-k sketches from one hash function.

A document is the set of the hashes of its five-word shingles; its sketch is the k
smallest. Documents with equal sets (by a 128-bit digest) form a class with a number of
its own (rep), which one row's text represents. The inverted lists of retained values propose pairs of classes, an
estimate on the sketch of the union filters them, and the exact Jaccard similarity of
full sets decides: it is counted on whole texts, word against word, where two hashes are
the same. Components of the links are the groups.

Which pairs are proposed. Only connectivity is asked for, so no list emits all its pairs.
First every list links its members to one leader, the member whose values occur most
often: in a group of copies the one that the others come from. Lists whose members are
then in one component are done. The documents of the others go through an exact prefix
join of their full sets: with shingles ordered rarest first, two sets of the similarity
share one among the first n - 3n/4 + 1 of each, and their first common one stands early
enough in both for the rest to hold the overlap that the similarity takes. A document
that differs too much from a group has only shingles of its own there and meets nobody;
a pair is also left out when one of the two shares fewer shingles with all others
together than the similarity takes. Those lists link to leaders again. Then each member of
a list meets one random block of it, of 16 and then of 128 members, and what links is one
component from then on; at last every pair across components that is left is checked, so
no link between components is missed. A member that has a link into a large component
mostly finds one early and needs none of the others. Two sets of similarity 0.75 share none of 64 retained values with a probability of 1e-38.

The rounds pair by size as well: a place in a list says how large a partner may be at
most, the similarity how small, and lists are met by (value, class of sizes). A place that
no size fits, as a common line that is most of a short text leaves, is dropped; so texts
that share a passage and aren't alike meet nobody, however many they are. Long lists are
dealt in blocks on both sides.

Hot values. A value of a passage that many documents share stands in a long list of
documents that aren't alike. Sketches of similarity 0.75 share at least LEAST of 64
values (fewer have a probability under 1e-7; a smaller set shares three in four). So each
sketch keeps only a prefix, its values rarest first without the last LEAST - 1: two
sketches that share LEAST values share one of their prefixes. Frequent values fall away
with no cap on any list, unless a document hardly has others.

Defined results: null or empty text and text without words: n_shingles 0, linked with
nothing. Under five words: one shingle, the whole sequence. Whole texts count, however
long. Rows that repeat a doc_id count as one document and are linked, whatever their
texts; each different set among them is a class of its own with one text, so no step sees
more than one row of it. A null doc_id is linked with nothing, has a null component_id and
is kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, finished, join_split, shared_dir, short_plans, slices, small_batches, written
from .words import gram_hashes, key_hashes, shingle_sets, word_keys

WIDTH, SIMILARITY, K = 5, (75, 100), 64
LEAST = 28
#: Standard errors by which a sketch's estimate may stay below the threshold.
SLACK = 6
#: Members of a list that meet in one block; in the rounds of random blocks, and in the last.
ROUNDS, MEMBERS = (16, 128), 1024

SETS = "doc_id BIGINT, tag BIGINT, n_shingles BIGINT, fp BINARY, sketch ARRAY<BIGINT>"
_TOP = np.uint64(1 << 63)


def fingerprint(hashes: np.ndarray) -> bytes:
    """128 bits of a set of hashes in order."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sketched(docs: DataFrame, k: int, width: int) -> DataFrame:
    """doc_id, tag (a hash of the text), n_shingles, fp, sketch of each row."""

    def run(batches):
        for piece in slices(batches):
            n, fps, sketches = [], [], []
            for s in shingle_sets(piece.column("text"), width):
                n.append(len(s))
                fps.append(fingerprint(s) if len(s) else None)
                sketches.append((s[:k] ^ _TOP).view(np.int64))
            lengths = np.cumsum([0, *map(len, sketches)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(sketches)))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("tag"), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), lists], ["doc_id", "tag", "n_shingles", "fp", "sketch"]
            )

    return _tagged(docs).mapInArrow(run, SETS)


def _tagged(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def classified(some: DataFrame) -> DataFrame:
    """fp, rep (the class' number), first_id (its smallest doc_id), tag (of this row's text), copies, n_shingles, sketch of the rows with sets. To be written once, as numbers may differ from run to run."""
    first = F.min(F.struct("doc_id", "tag")).alias("first")
    classes = some.groupBy("fp").agg(first, F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    return classes.select("fp", F.monotonically_increasing_id().alias("rep"), F.col("first.doc_id").alias("first_id"), F.col("first.tag").alias("tag"), "copies", "n_shingles", "sketch")


def retained(classes: DataFrame, root: str) -> DataFrame:
    """The inverted lists of the sketches' prefixes: v, doc, n, pop (how often the document's values occur). Values of one class only count for the prefix and are left out."""
    posts = classes.select(F.col("rep").alias("doc"), F.col("n_shingles").alias("n"), F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    sizes = written(posts.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1), root, "values")
    rows = classes.agg(F.sum(F.size("sketch"))).first()[0] or 0
    shared = join_split(posts, sizes, "v", "c", rows)
    mine = Window.partitionBy("doc", "n", "k")
    rank = F.row_number().over(mine.orderBy("c", "v")) + F.col("k") - F.count(F.lit(1)).over(mine)
    least = F.least(F.lit(LEAST), F.ceil(F.col("k") * SIMILARITY[0] / SIMILARITY[1]))
    ranked = shared.withColumn("rank", rank).withColumn("pop", F.sum("c").over(mine))
    return ranked.where(F.col("rank") <= F.col("k") - least + 1).select("v", "doc", "n", "pop", F.col("n").alias("m"))


def gathered(docs: DataFrame, classes: DataFrame, lists: DataFrame, sets: DataFrame, root: str) -> DataFrame:
    """rep, fp, sketch, text, one row each, of the classes that stand in a list: all that later steps read of the documents.

    A row that repeats another one by doc_id and text adds nothing. Rows that are repeated
    HOT_SHARE of all rows or more, at most 1 / HOT_SHARE of them, find their class by a
    broadcast and leave a task once; the others go by a shuffled join.
    """
    nodes = classes.select("first_id", "tag", "rep", "fp", "sketch").join(lists.select(F.col("doc").alias("rep")).distinct(), "rep", "left_semi")
    rows = _tagged(docs).withColumnRenamed("doc_id", "first_id")
    most = max(2, int(sets.count() * HOT_SHARE))
    repeated = sets.groupBy(F.col("doc_id").alias("first_id"), "tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).select("first_id", "tag")
    hot = written(nodes.join(repeated, ["first_id", "tag"]), root, "hot_nodes")
    own = ["rep", "fp", "sketch", "text"]
    if hot.isEmpty():
        return written(_once(rows.join(nodes, ["first_id", "tag"]), "first_id", "tag").select(*own), root, "texts")
    marked = rows.join(F.broadcast(hot), ["first_id", "tag"], "left")
    some = marked.where("rep IS NOT NULL").groupBy("rep", "fp").agg(F.first("sketch").alias("sketch"), F.first("text").alias("text"))
    rest = marked.where("rep IS NULL").select("first_id", "tag", "text").join(nodes.join(hot, "rep", "left_anti"), ["first_id", "tag"])
    return written(some.select(*own).unionByName(_once(rest, "first_id", "tag").select(*own)), root, "texts")


def _once(rows: DataFrame, *keys: str) -> DataFrame:
    """One row of each key, of rows that a join by the keys has dealt and sorted already."""
    return rows.dropDuplicates(list(keys))


def prefixes(texts: DataFrame, torn: DataFrame, width: int) -> DataFrame:
    """Lists of full sets' prefixes among the documents of torn: v, doc, n, pop, m (values that others have too), at (v's place in the document's order)."""

    def run(batches):
        for piece in slices(batches):
            ids, fps = piece.column("rep").to_pylist(), piece.column("fp").to_pylist()
            docs, values = [], []
            for i, s in enumerate(shingle_sets(piece.column("text"), width)):
                if len(s) and fingerprint(s) == fps[i]:
                    docs.append(np.full(len(s), ids[i], np.int64))
                    values.append((s ^ _TOP).view(np.int64))
            none = np.zeros(0, np.int64)
            columns = [np.concatenate([none, *docs]), np.concatenate([none, *values]), np.concatenate([none, *(np.full(len(d), len(d)) for d in docs)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "v", "n"])

    own = texts.select("rep", "fp", "text").join(torn.select(F.col("doc").alias("rep")).distinct(), "rep", "left_semi")
    posts = own.mapInArrow(run, "doc BIGINT, v BIGINT, n BIGINT")
    sizes = posts.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    mine = Window.partitionBy("doc", "n")
    rank = F.row_number().over(mine.orderBy("c", "v")) + F.col("n") - F.count(F.lit(1)).over(mine)
    ranked = posts.join(sizes, "v").withColumn("rank", rank).withColumn("pop", F.sum("c").over(mine)).withColumn("m", F.count(F.lit(1)).over(mine))
    least, most = partner_sizes("n", "m", "rank")
    return ranked.where(least <= most).select("v", "doc", "n", "pop", "m", F.col("rank").alias("at"))


def partner_sizes(n: str, m: str, at: str) -> tuple[Column, Column]:
    """The smallest and largest set that one of n values, m of them shared, can be alike with when the first value in common is its at-th."""
    low, high = SIMILARITY
    rest = F.least(F.col(m), F.col(n) - F.col(at) + 1)
    most = F.least(F.floor(rest * (low + high) / low) - F.col(n), F.floor(F.col(n) * high / low))
    return F.ceil(F.col(n) * low / high), most


def size_class(n: str) -> Column:
    """Eight classes to each doubling, in order of size; whole numbers only."""
    return F.expr(f"cast(8 * length(bin({n})) + shiftright({n} * 8, length(bin({n})) - 1) as int)")


def _fits(n1: str, n2: str, m1: str, m2: str):
    """Whether two set sizes allow the similarity, and the values that the sets share with any others the overlap it takes."""
    overlap = (F.col(n1) + F.col(n2)) * SIMILARITY[0] <= F.least(m1, m2) * (SIMILARITY[0] + SIMILARITY[1])
    return (F.least(n1, n2) * SIMILARITY[1] >= F.greatest(n1, n2) * SIMILARITY[0]) & overlap


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """lists with comp, a member's component so far, and only those that hold more than one."""
    here = lists.join(labels.withColumnRenamed("comp", "found"), "doc", "left").withColumn("comp", F.coalesce("found", "doc")).drop("found")
    torn = here.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("v")
    return here.join(torn, "v", "left_semi")


def _leaders(lists: DataFrame) -> DataFrame:
    """v, x: the member whose values occur most, which others are likeliest to be copies of."""
    return lists.groupBy("v").agg(F.max(F.struct("pop", F.xxhash64("doc").alias("h"), "doc", "n", "m", "comp")).alias("x"))


def _to_leaders(lists: DataFrame, second: bool = False) -> DataFrame:
    """Pairs a < b of each list's members with its leader, in different components. second: with the leader of those outside the first one's component."""
    leader = _leaders(lists)
    if second:
        leader = _leaders(lists.join(leader, "v").where(F.col("comp") != F.col("x.comp")).drop("x"))
    met = lists.join(leader, "v").where((F.col("comp") != F.col("x.comp")) & _fits("n", "x.n", "m", "x.m"))
    return met.select(F.least("doc", "x.doc").alias("a"), F.greatest("doc", "x.doc").alias("b")).distinct()


def _blocks(rows: DataFrame, other: DataFrame, mine: str, theirs: str) -> DataFrame:
    """rows with their block among `mine` blocks of their list, once for each of the other side's `theirs` blocks."""
    many = lambda df, name: df.groupBy("v", "class").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias(name)).where(F.col(name) > 1)
    held = rows.join(many(rows, "_mine"), ["v", "class"], "left").join(many(other, "_theirs"), ["v", "class"], "left")
    own = F.pmod(F.xxhash64("doc"), F.coalesce("_mine", F.lit(1))).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("_theirs", F.lit(1)) - 1))
    return held.withColumn(mine, own).withColumn(theirs, each).drop("_mine", "_theirs")


def _one_block(small: DataFrame, large: DataFrame, members: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a block i, j: the larger side's lists fall into blocks of about so many members, and each row of the smaller side names one."""
    size = F.ceil(F.count(F.lit(1)) / members).cast("int")
    many = large.groupBy("v", "class").agg(size.alias("_size")).where("_size > 1")
    many = many.select("v", "class", F.expr("shiftleft(1, length(bin(_size - 1)))").alias("_blocks"))
    dealt = lambda df, *keys: df.join(many, ["v", "class"], "left").withColumn("i", F.pmod(F.xxhash64("doc", *keys), F.coalesce("_blocks", F.lit(1)))).withColumn("j", F.lit(0)).drop("_blocks")
    return dealt(small, F.lit(members)), dealt(large)


def _across(lists: DataFrame, members: int = 0) -> DataFrame:
    """Pairs a < b of a list in different components whose sizes and places allow the similarity: the first value that two sets share leaves both long enough a rest for the overlap it takes. members: each meets one block of about so many only."""
    least, most = partner_sizes("n", "m", "at")
    places = lists.withColumn("least", least).withColumn("most", most).where("least <= most").select("v", "doc", "n", "least", "most", "comp")
    small = places.where("most >= n").withColumn("class", F.explode(F.sequence(size_class("n"), size_class("most"))))
    large = places.where("least <= n").withColumn("class", size_class("n"))
    if members:
        ones, others = _one_block(small, large, members)
    else:
        ones, others = _blocks(small, large, "i", "j"), _blocks(large, small, "j", "i")
    others = others.select("v", "class", "i", "j", *[F.col(c).alias(f"{c}2") for c in ("doc", "n", "least", "most", "comp")])
    fit = "comp <> comp2 AND (n < n2 OR n = n2 AND doc < doc2) AND n2 <= most AND n >= least2 AND n <= most2"
    met = ones.join(others, ["v", "class", "i", "j"]).where(fit)
    return met.select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()


def _alike(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Pairs whose union sketch doesn't rule the similarity out."""
    of = lambda x: texts.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = both.withColumn("union", union).withColumn("common", F.size(F.array_intersect("union", F.array_intersect("sa", "sb"))))
    t = SIMILARITY[0] / SIMILARITY[1]
    m = F.size("union")
    return both.where(F.col("common") >= m * t - SLACK * F.sqrt(m * t * (1 - t))).select("a", "b").distinct()


class Words:
    """A text's words, by their keys, and the hashes of its shingles."""

    def __init__(self, a: np.ndarray, b: np.ndarray, width: int):
        self.a, self.b = a, b
        n = min(width, len(a))
        self.grams = gram_hashes(key_hashes(a, b), n) if n else np.zeros(0, np.uint64)

    @classmethod
    def of(cls, column: pa.Array, width: int):
        a, b, at = word_keys(column)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            yield cls(a[lo:hi], b[lo:hi], width)


def set_sizes(x: Words, y: Words, width: int) -> tuple[int, int, int]:
    """Distinct shingles of x, of y and of both together. Equal hashes count as one where the words are the same, word by word."""
    if min(len(x.a), len(y.a)) < width:  # a whole sequence equals nothing but another one
        n, m = (len(np.unique(t.grams)) for t in (x, y))
        return n, m, n + m - (len(x.a) == len(y.a) > 0 and bool((x.a == y.a).all() and (x.b == y.b).all()))
    grams = np.concatenate([x.grams, y.grams])
    start = np.concatenate([np.arange(len(x.grams)), len(x.a) + np.arange(len(y.grams))])
    order = np.argsort(grams, kind="stable")
    alike = grams[order[1:]] == grams[order[:-1]]
    one, two = start[order[1:][alike]], start[order[:-1][alike]]
    a, b = np.concatenate([x.a, y.a]), np.concatenate([x.b, y.b])
    if not all((a[one + d] == a[two + d]).all() and (b[one + d] == b[two + d]).all() for d in range(width)):
        plain = [{tuple(zip(t.a[k : k + width].tolist(), t.b[k : k + width].tolist())) for k in range(len(t.grams))} for t in (x, y)]
        return len(plain[0]), len(plain[1]), len(plain[0] | plain[1])
    mine = order < len(x.grams)
    # equal shingles stand together, x's before y's
    new = np.append(True, ~alike)
    both = int((alike & mine[:-1] & ~mine[1:]).sum())
    total = int(new.sum())
    first_y = int((~mine & (new | np.append(False, mine[:-1]))).sum())
    return total - first_y + both, first_y, total


VERIFIED = "a BIGINT, b BIGINT"


def verified(pairs: DataFrame, texts: DataFrame, root: str, name: str, width: int) -> DataFrame:
    """The pairs whose full sets have the similarity."""
    pairs = written(pairs, root, f"{name}_alike")
    of = lambda x: texts.select(F.col("rep").alias(x), F.col("fp").alias(f"fp{x}"), F.col("text").alias(f"text{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "fpa", "fpb", "texta", "textb")

    def run(batches):
        last_key, last = None, None
        for piece in slices(batches, "textb", 1 << 20):
            a, b = piece.column("a").to_pylist(), piece.column("b").to_pylist()
            fpa, fpb = piece.column("fpa").to_pylist(), piece.column("fpb").to_pylist()
            good = []
            for i, y in enumerate(Words.of(piece.column("textb"), width)):
                if (a[i], fpa[i]) != last_key:
                    last_key, x = (a[i], fpa[i]), next(Words.of(piece.column("texta").slice(i, 1), width))
                    last = x if fingerprint(np.unique(x.grams)) == fpa[i] else None
                if last is None or fingerprint(np.unique(y.grams)) != fpb[i]:  # a doc_id's other text
                    continue
                n, m, union = set_sizes(last, y, width)
                if (n + m - union) * SIMILARITY[1] >= union * SIMILARITY[0]:
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], ["a", "b"])

    return written(both.mapInArrow(run, VERIFIED).distinct(), root, f"{name}_links")


def components(edges: DataFrame, root: str, name: str) -> DataFrame:
    """doc, comp for each node of edges (a, b): comp is the smallest node reachable.

    Alternating large-star and small-star steps until nothing moves; each pair of them ends in a written table.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    state = None
    for step in itertools.count():
        edges = written(_stars(edges) if step else edges, root, f"{name}_{step}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("comp"))


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (u > v) after a large-star and a small-star step."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def links(classes: DataFrame, docs: DataFrame, sets: DataFrame, root: str, k: int, width: int) -> DataFrame:
    """doc, comp of the classes that are linked with others, by their numbers."""
    lists = written(retained(classes, root), root, "lists")
    texts = gathered(docs, classes, lists, sets, root)
    check = lambda pairs, name: verified(_alike(pairs, texts, k), texts, root, name, width)
    seen = written(_to_leaders(lists.withColumn("comp", F.col("doc"))), root, "pairs")
    labels = components(check(seen, "leaders"), root, "comp")
    left = written(_labelled(lists, labels).select("doc").distinct(), root, "left")
    if left.isEmpty():
        return labels
    places = written(prefixes(texts, left, width), root, "prefixes")
    proposals = [lambda x: _to_leaders(x, True), *[lambda x, n=n: _across(x, n) for n in ROUNDS], _across]
    for k, propose in enumerate(proposals):
        torn = written(_labelled(places, labels), root, f"torn_{k}")
        if torn.isEmpty():
            break
        pairs = written(propose(torn).join(seen, ["a", "b"], "left_anti"), root, f"pairs_{k}")
        seen = seen.unionByName(pairs)
        found = check(pairs, f"round_{k}")
        if not found.isEmpty():
            labels = components(found.unionByName(labels.select(F.col("doc").alias("a"), F.col("comp").alias("b"))), root, f"comp_{k}")
    return labels


def near_dedup(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    small_batches(docs.sparkSession)
    short_plans(docs.sparkSession)
    root = shared_dir(docs.sparkSession)
    sets = written(sketched(docs, k, width), root, "sets")
    some = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(classified(some), root, "classes")
    labels = links(classes, docs, sets, root, k, width)
    # a component is named by the smallest doc_id of its classes
    joined = classes.select("fp", "rep", "first_id", "copies").join(labels.withColumnRenamed("doc", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    names = joined.where("comp <> rep OR comp IS NULL").select("comp").distinct()
    least = joined.join(names, "comp", "left_semi").groupBy("comp").agg(F.min("first_id").alias("least"))
    of_class = written(joined.join(least, "comp", "left").select("fp", F.coalesce("least", "first_id").alias("component_id"), "copies"), root, "of_class")
    # a doc_id that stands for several sets links them
    held = some.select("doc_id", "fp").distinct()
    twice = held.join(held.groupBy("doc_id").count().where("count > 1").select("doc_id"), "doc_id", "left_semi")
    bridges = twice.join(of_class, "fp").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).distinct()
    bridges = written(bridges, root, "bridges")
    if not bridges.isEmpty():
        over = components(bridges, root, "comp_ids").withColumnRenamed("doc", "component_id")
        of_class = of_class.join(over, "component_id", "left").select("fp", F.coalesce("comp", "component_id").alias("component_id"), "copies")
    linked = join_split(some.select("doc_id", "n_shingles", "fp"), of_class, "fp", "copies", sets.count())
    alone = sets.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return finished(rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), root)
