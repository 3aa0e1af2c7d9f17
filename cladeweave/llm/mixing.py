"""Mixing sources to target weights.

Each document gets a hash-random key of its doc_id and text. Within a source documents
are sorted by key range after range: equal ranges of the key space are the partitions,
prefix sums of the ranges' token counts join prefix sums inside each range, and a source
is cut at its exact budget, after as many whole epochs as the budget holds.

Tokens are words here. A document whose words end within the last epoch's budget is taken
once more; the one on the cut is taken up to the cut. So the words taken of a source are
its target, rounded down.

Rows that agree in doc_id, source, size and text are one group with a count: they have
one key, and only the group on a source's cut, if any, deals its share to its rows one
after the other. So no range or task gathers rows that repeat.

Defined results: a null text has size 0; size-0 documents are never taken; a source of
size 0 gets target 0. Null is a source of its own, after all others. Rows that repeat a
doc_id are documents of their own, and so are rows without one. Whole texts count,
however long. Extra columns stay out of the way: only doc_id, text and source are read.
An empty table gives an empty result.

The table of sources has one row a source; the weights and the level up to which small
sources fill are found on it by windows over that table alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, finished, join_split, shared_dir, written

WEIGHTS, MOST_EPOCHS, SEED, RANGE_ROWS = (5, 2, 1), 3, "mix-1", 10_000


def mix_key(seed: str) -> Column:
    """60 bits of the MD5 of seed, doc_id and the text's MD5."""
    named = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, key of each row."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size().alias("size"), mix_key(seed).alias("key"))


def group_of(doc_id: Column, source: Column, size_: Column, key: Column) -> Column:
    """A value that rows of one group share; null parts are told apart."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    return F.struct(key.alias("key"), text(doc_id).alias("doc"), text(source).alias("src"), size_.alias("size"))


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, n_docs, source_size, target.

    The level is where min(most * size, level * weight) adds up to all sizes: what a
    source at its cap can't take goes to the others by weight, until none is above.
    """
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(order, F.lit(len(weights))).cast("int") + 1)
    totals = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    totals = totals.withColumn("ratio", F.col("cap") / F.col("weight"))
    totals = totals.withColumn("full", F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    totals = totals.withColumn("open", F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
    totals = totals.withColumn("all", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    totals = totals.withColumn("at", (F.col("all") - F.col("full")) / F.col("open"))
    level = F.max(F.when(F.col("at") <= F.col("ratio"), F.col("at"))).over(Window.partitionBy())
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return totals.select("source", "n_docs", "source_size", target.alias("target"))


def grouped(sized: DataFrame, root: str, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Groups of equal rows: group, n, source, source_size, target, epochs (whole copies of each row), part (words of one more copy, of all rows together)."""
    targets = written(source_targets(sized, weights, most), root, "targets")
    groups = sized.withColumn("group", group_of(*map(F.col, ("doc_id", "source", "size", "key")))).groupBy("group", "source").agg(F.count(F.lit(1)).alias("n"))
    groups = written(groups, root, "groups")
    rows = groups.count()
    ranges = max(1, -(-rows // RANGE_ROWS))
    # null sources join too: as text, which "group" has
    bucket = F.floor(F.col("group.key") * F.lit(float(ranges)) / F.lit(float(1 << 60))).cast("long")
    ranged = groups.withColumn("src", F.col("group.src")).withColumn("bucket", bucket).withColumn("words", F.col("n") * F.col("group.size"))
    width = ranged.groupBy("src", "bucket").agg(F.sum("words").alias("words"))
    before = F.sum("words").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = width.select("src", "bucket", F.coalesce(before, F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("src", "bucket").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    # each range of a source is small, so this window never gathers a source
    run = ranged.repartitionByRange("src", "bucket").withColumn("before", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    run = run.join(starts, ["src", "bucket"]).drop("source")
    named = targets.withColumn("src", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    run = join_split(run, named.select("src", "source", "n_docs", "source_size", "target"), "src", "n_docs", rows)
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("words"), rest - F.col("bucket_start") - F.col("before")))
    return run.withColumn("epochs", whole).withColumn("part", part).select("group", "n", "source", "source_size", "target", "epochs", "part")


def dealt(rows: DataFrame, groups: DataFrame, total: int, root: str) -> DataFrame:
    """rows (with a column group) and their groups' columns, part being the row's own.

    In a source's one group that is taken in part the rows come one after the other:
    numbered inside the partitions of a written table, from prefix sums over these.
    """
    joined = join_split(rows, groups, "group", "n", total)
    some = (F.col("n") > 1) & (F.col("part") > 0) & (F.col("part") < F.col("n") * F.col("group.size"))
    clear = joined.where(~some).withColumn("part", F.expr("part div n").cast("long"))
    torn = written(joined.where(some).withColumn("_id", F.monotonically_increasing_id()), root, "torn")
    torn = torn.withColumn("_file", F.shiftright("_id", 33))
    files = torn.groupBy("group", "_file").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("group").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("group", "_file", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("group", "_file").orderBy("_id")) - 1
    torn = torn.withColumn("_place", place).join(files, ["group", "_file"])
    own = F.greatest(F.lit(0), F.least(F.col("group.size"), F.col("part") - (F.col("_before") + F.col("_place")) * F.col("group.size")))
    return clear.unionByName(torn.withColumn("part", own.cast("long")).select(clear.columns))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), epochs (whole copies), part (words of one more copy)."""
    root = shared_dir(docs.sparkSession)
    sized = written(sizes(docs, seed), root, "sized")
    groups = written(grouped(sized, root, weights, most), root, "plan")
    rows = sized.select("doc_id", group_of(*map(F.col, ("doc_id", "source", "size", "key"))).alias("group"))
    rows = dealt(rows, groups, sized.count(), root).withColumn("size", F.col("group.size"))
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return finished(rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "epochs", "part"), root)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of docs with all their columns, once for each epoch; a part ends after the words taken."""
    root = shared_dir(docs.sparkSession)
    sized = written(sizes(docs, seed), root, "sized")
    groups = grouped(sized, root, weights, most).where("group.size > 0 AND (epochs > 0 OR part > 0)")
    rows = docs.select(F.struct(*docs.columns).alias("row"), group_of(F.col("doc_id"), F.col("source").cast("string"), size(), mix_key(seed)).alias("group"))
    rows = dealt(rows, written(groups, root, "plan"), sized.count(), root)
    words = F.col("group.size")
    whole = F.array_repeat(words, F.col("epochs").cast("int"))
    copies = F.when(F.col("part") > 0, F.concat(whole, F.array(F.col("part")))).otherwise(whole)
    rows = rows.select("row", words.alias("words"), F.explode(copies).alias("taken"))
    cut = F.when(F.col("taken") < F.col("words"), first_words(F.col("row.text"), F.col("taken"))).otherwise(F.col("row.text"))
    return rows.select(F.col("row").withField("text", cut).alias("row")).select("row.*")
