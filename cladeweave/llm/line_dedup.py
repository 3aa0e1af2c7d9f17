"""Line dedup: lines that many documents share stay in one of them only.

Line keys become 128-bit hashes, which are range-partitioned and sorted by hash,
document and position; a pass over each sorted run finds the first occurrence and drops
the later ones. Per document a run-length keep bitmap results, not text. DataFrame code
only.

A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at
least `min_chars` code points found in at least `min_docs` documents lose all their
lines except in the document with the largest doc_id. Whole texts are split, however
long. A null or empty text is one empty line. Rows that repeat a doc_id are one document here, and each of them is returned; a
null doc_id is a document smaller than any other. Extra columns are ignored. An empty
table gives an empty result.

A key's rows spread over `salts` sorted runs, and those of a key that fills more than
`run_rows` rows of each over as many as its count asks for. A run decides all rows but
those of its first `min_docs` documents: behind so many larger documents a row is a
repeat for sure. Only these first ones meet in the second pass, at most min_docs
documents for each of a key's runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, finished, lower_ascii, shared_dir, text_or_empty, written

LINE_END = "\n"
#: Rows of a key in a run from which on it gets more runs.
RUN_ROWS = 1 << 20


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def tag(text: Column) -> Column:
    """Tells rows apart that repeat a doc_id with another text."""
    return F.xxhash64(text)


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, tag, n_lines, hash and pos of each line whose key is long enough."""
    text = text_or_empty()
    keys = F.transform(split_lines(lower_ascii(text)), lambda x: F.btrim(x, F.lit(BLANKS)))
    numbered = F.transform(keys, lambda x, i: F.struct(F.when(F.char_length(x) >= min_chars, F.unhex(F.md5(x))).alias("hash"), i.alias("pos")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag(text).alias("tag"), numbered.alias("lines"))
    rows = rows.select("doc_id", "tag", F.size("lines").alias("n_lines"), F.explode(F.filter("lines", lambda x: x["hash"].isNotNull())).alias("line"))
    return rows.select("doc_id", "tag", "n_lines", F.col("line.hash").alias("hash"), F.col("line.pos").alias("pos"))


def _ranked(sorted_rows: DataFrame, *keys: str) -> DataFrame:
    """rank: how many documents of its run, from the largest on, a row's document is. One pass over rows sorted by document and position."""
    run = Window.partitionBy(*keys).orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    same = (F.row_number().over(run) > 1) & F.lag("doc_id").over(run).eqNullSafe(F.col("doc_id"))
    rows = sorted_rows.withColumn("first", F.when(same, 0).otherwise(1))
    return rows.withColumn("rank", F.sum("first").over(run)).drop("first")


def dropped_lines(lines: DataFrame, min_docs: int = 3, salts: int = 16, run_rows: int = RUN_ROWS) -> DataFrame:
    """Of line_rows() those to drop: doc_id, tag, n_lines, pos."""
    kept = ["doc_id", "tag", "n_lines", "pos"]
    runs = F.lit(salts).cast("long")
    if lines.count() > salts * run_rows:  # else no key can fill its runs
        many = lines.groupBy("hash").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > salts * run_rows)
        lines = lines.join(many, "hash", "left")
        runs = F.coalesce(F.ceil(F.col("_rows") / run_rows), runs)
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), runs)).select(*kept, "hash", "salt")
    first = _ranked(salted.repartitionByRange("hash", "salt"), "hash", "salt")
    sure = first.where(F.col("rank") > min_docs).select(*kept)
    rest = first.where(F.col("rank") <= min_docs).select(*kept, "hash")
    rest = _ranked(rest.repartitionByRange("hash"), "hash").withColumn("ranks", F.max("rank").over(Window.partitionBy("hash")))
    return sure.unionByName(rest.where((F.col("ranks") >= min_docs) & (F.col("rank") > 1)).select(*kept))


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """doc_id, tag and keep_runs, for rows that lose lines.

    keep_runs holds the lengths of the bitmap's runs, a run of kept lines first (0 where
    the first line goes). Rows without a bitmap keep all lines.
    """
    at = dropped.groupBy("doc_id", "tag", "n_lines").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    steps = F.arrays_zip(F.col("at").alias("at"), F.slice(F.array_insert("at", 1, F.lit(-1)), 1, F.size("at")).alias("before"))
    bits = F.transform(steps, lambda s: F.concat(F.repeat(F.lit("1"), s["at"] - s["before"] - 1), F.lit("0")))
    tail = F.repeat(F.lit("1"), F.col("n_lines") - F.element_at("at", -1) - 1)
    at = at.withColumn("bits", F.concat(F.array_join(bits, ""), tail))
    runs = F.transform(F.regexp_extract_all("bits", F.lit("(1+|0+)"), F.lit(1)), lambda r: F.char_length(r))
    none = F.when(F.col("bits").startswith("0"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return at.select("doc_id", "tag", F.concat(none, runs).alias("keep_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, for every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("tag", tag(F.col("text")))
    marks = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), "keep_runs")
    # bitmaps grow with the documents: one plan at every size
    joined = rows.join(marks.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left")
    flags = F.flatten(F.transform("keep_runs", lambda k, i: F.array_repeat(i % 2 == 0, k)))
    lines = F.arrays_zip(split_lines(F.col("text")).alias("line"), flags.alias("keep"))
    left = F.array_join(F.transform(F.filter(lines, lambda z: z["keep"]), lambda z: z["line"]), LINE_END)
    gone = F.aggregate(F.transform("keep_runs", lambda k, i: F.when(i % 2 == 1, k).otherwise(0)), F.lit(0), lambda a, b: a + b)
    ends = F.char_length("text") - F.char_length(F.translate("text", LINE_END, "")) + 1
    return joined.select(
        "doc_id",
        ends.cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep_runs").isNull(), F.col("text")).otherwise(left).alias("text"),
    )


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, salts: int = 16, run_rows: int = RUN_ROWS) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: doc_id, tag, keep_runs."""
    root = shared_dir(docs.sparkSession)
    lines = written(line_rows(docs, min_chars), root, "lines")
    return finished(keep_bitmaps(dropped_lines(lines, min_docs, salts, run_rows)), root)
