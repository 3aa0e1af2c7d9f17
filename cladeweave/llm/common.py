"""Shared helpers: working folders, cut lineage, hot keys, bounded batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here, as the characters themselves.
BLANKS = " \t\n\x0b\x0c\r"
#: A run of it, and a word, as Java patterns.
BLANK_RUN, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key counts as hot from this share of the rows on, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 1000
#: Texts in an Arrow batch.
BATCH_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir.

    Where that is unset a temporary folder is set for it, on a local master (tests) only:
    elsewhere executors would write what nobody else can read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="llm_shared_")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, root: str, name: str) -> DataFrame:
    """Write df below root and read it back: its lineage ends in files that outlive executors."""
    path = f"{root}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(df: DataFrame, root: str) -> DataFrame:
    """The result df in a folder of its own; what led to it, below root, is deleted."""
    result = written(df, shared_dir(df.sparkSession), "result")
    release(df.sparkSession, root)
    return result


def release(spark: SparkSession, path: str) -> None:
    """Delete a folder written by `written` that nothing reads any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def join_split(left: DataFrame, right: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """left joined with right, whose `key` is unique and whose `n` counts left's rows of that key.

    Keys with HOT_SHARE of the rows or more, at most 1 / HOT_SHARE of them, go by a
    broadcast of just these keys, so a hot key never gathers in one task; all others
    go by a shuffled join. No row is lost: the two parts are complements.
    """
    most = max(2, int(rows * HOT_SHARE))
    hot = right.where(F.col(n) >= most)
    cold = right.where(F.col(n) < most)
    flagged = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    extra = [c for c in right.columns if c != key]
    on_hot = flagged.where(F.col("_hot")).select(*left.columns, *extra)
    on_cold = flagged.where(F.col("_hot").isNull()).select(*left.columns).join(cold, key).select(*left.columns, *extra)
    return on_hot.unionByName(on_cold)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches hold few texts: JVM and worker each hold whole batches, of both sides, for every running task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, rows)


def short_plans(spark: SparkSession, length: int = 4096) -> None:
    """Cut the text that Spark keeps of each plan on the driver, anew with every stage of it: many small queries add up."""
    spark.conf.set("spark.sql.maxPlanStringLength", length)


def slices(batches, column: str = "text", nbytes: int = 1 << 20):
    """Arrow batches cut into pieces of about nbytes of text; a longer text is a piece of its own.

    Behind the last one the worker hands memory that it freed back to the system.
    """
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        lo = size = 0
        for i, k in enumerate(lengths):
            if i > lo and size + k > nbytes:
                yield batch.slice(lo, i - lo)
                lo, size = i, 0
            size += int(k)
        if lo < batch.num_rows:
            yield batch.slice(lo)
    hand_back()


def hand_back() -> None:
    """Freed memory of this process to the system: workers live on, next to others and the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
