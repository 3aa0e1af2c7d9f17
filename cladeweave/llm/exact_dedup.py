"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

New data is digested, reduced to one row a digest, joined against the index by a
sort-merge anti-join, and what is new is appended. All of it is DataFrame code.

Two texts are equal when they are identical after each run of white space became one
space; a null text counts as empty, and all empty texts are equal. Within a batch the
row with the smallest doc_id stays; a digest that an earlier batch brought keeps that
batch's row, and all rows of later batches are dropped. A null doc_id is larger than any
other; where all ids of a group are null keep_id is null and each row of the batch that
brought it counts as kept. Rows that repeat a doc_id and text
are all kept or all dropped together. Whole texts are digested, however long. Extra columns are ignored by `digests`. An empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_RUN, finished, join_split, shared_dir, text_or_empty, written

INDEX_SCHEMA = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text."""
    normal = F.regexp_replace(text_or_empty(), BLANK_RUN, " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest"))


class DigestIndex:
    """A table of digests in `buckets` files by hash, each sorted by digest.

    path: the index's folder, shared by all executors. Attaching to a folder that
    holds an index goes on with it. Rows: digest, keep_id, group_size (rows of the
    batch that brought it), batch.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def close(self) -> None:
        """Take the table's name out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE {self.table}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, digested: DataFrame, batch: str) -> None:
        """Append digests that the index lacks. Adding a batch again appends nothing."""
        groups = digested.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        known = self.rows().select("digest")
        new = groups.repartition(self.buckets, "digest").join(known.hint("merge"), "digest", "left_anti")
        new = new.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def decide(self, digested: DataFrame, rows: int, batch: str) -> DataFrame:
        """For each row of one batch: doc_id, keep_id, group_size, kept, digest. rows: their number.

        group_size counts this batch's rows of the digest, which also says which digests are
        hot in it. A row of a digest that another batch brought is never kept.
        """
        own = digested.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        found = own.join(self.rows().select("digest", "keep_id", F.col("batch").alias("_batch")), "digest")
        joined = join_split(digested, found, "digest", "group_size", rows)
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_batch") == batch)
        return joined.withColumn("kept", kept).drop("_batch")


def exact_dedup(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """All documents against a fresh index: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    root = shared_dir(spark)
    digested = written(digests(docs), root, "digests")
    index = DigestIndex(spark, f"{root}/index", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    index.add(digested, "first")
    decided = finished(index.decide(digested, digested.count(), "first"), root)
    index.close()
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
