"""Token-id output: texts as ids, coded by the range coder into a file of blocks.

Format. A file is a Parquet folder whose rows are chunks, in order of shard and chunk. A
chunk holds whole documents in ascending doc_id order: `doc_ids`, `lengths` (ids of each,
the end id included), `prior` (what every block starts from) and its checksum, `payload`
(the coded blocks one after the other), `block_bytes` and `block_crc32` (of each block's
ids as little-endian unsigned 32-bit integers). Every block is decoded on its own, from
the prior. Reading checks each checksum and raises on a mismatch.

Documents are range-partitioned by doc_id; a partition is a shard, its chunks are of
about CHUNK_IDS ids. Starts are prefix sums over shards, over a shard's chunks and over
a chunk's documents.

Defined results: a null or empty text is the end id alone. A text of any length is one
document of one chunk; pieces of about a megabyte hold several texts or one longer one.
Rows that repeat a doc_id follow each other, ordered by a hash of the text; equal rows
are as many documents. A null doc_id comes first. Extra columns are ignored. An empty
table gives an empty file and an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hand_back, slices, small_batches
from .rangecoder import BLOCK, decode, encode
from .transducer import tokenizer

END_ID, CHUNK_IDS = 0, 1 << 21
FILE = "shard INT, chunk INT, n_ids BIGINT, block INT, doc_ids ARRAY<BIGINT>, lengths ARRAY<BIGINT>, block_bytes ARRAY<INT>, block_crc32 ARRAY<BIGINT>, prior BINARY, prior_crc32 BIGINT, payload BINARY"
READ = "shard INT, chunk INT, place BIGINT, doc_id BIGINT, inside BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _chunk(shard: int, number: int, docs: list, lengths: np.ndarray, ids: np.ndarray, block: int) -> dict:
    prior, payloads = encode(ids, block)
    return {
        "shard": shard, "chunk": number, "n_ids": len(ids), "block": block, "doc_ids": docs, "lengths": lengths, "block_bytes": list(map(len, payloads)),
        "block_crc32": [_crc(ids[i : i + block]) for i in range(0, len(ids), block)], "prior": prior, "prior_crc32": zlib.crc32(prior), "payload": b"".join(payloads),
    }


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = END_ID, chunk_ids: int = CHUNK_IDS, block: int = BLOCK) -> None:
    """Encode every text of docs with the tokenizers file at path and write the ids to the folder out."""
    def run(batches):
        kind = pa.schema([
            ("shard", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int64()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int64())), ("block_bytes", pa.list_(pa.int32())), ("block_crc32", pa.list_(pa.int64())), ("prior", pa.binary()), ("prior_crc32", pa.int64()), ("payload", pa.binary()),
        ])
        tok = tokenizer(path)
        shard, number = TaskContext.get().partitionId(), 0
        held_docs, held_lengths, held_ids, size = [], [], [], 0

        def flush():
            row = _chunk(shard, number, held_docs, np.concatenate(held_lengths), np.concatenate(held_ids), block)
            held_ids.clear()
            hand_back()
            return pa.RecordBatch.from_pylist([row], schema=kind)

        for piece in slices(batches):
            counts, flat = tok.ids(piece.column("text"))
            ids = np.insert(flat, np.cumsum(counts), end_id)
            held_docs += piece.column("doc_id").to_pylist()
            held_lengths.append(counts + 1)
            held_ids.append(ids)
            size += len(ids)
            if size >= chunk_ids:
                yield flush()
                number += 1
                held_docs, held_lengths, held_ids, size = [], [], [], 0
        if held_docs:
            yield flush()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ranged.mapInArrow(run, FILE).write.mode("overwrite").option("compression", "uncompressed").parquet(out)


def read_file(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(FILE).parquet(out)


def read_tokens(row: dict) -> np.ndarray:
    """All ids of one chunk, checked."""
    cuts = np.concatenate([[0], np.cumsum(row["block_bytes"])]).astype(int)
    if zlib.crc32(row["prior"]) != row["prior_crc32"]:
        raise ValueError(f"shard {row['shard']}, chunk {row['chunk']}: the prior's checksum doesn't fit")
    ids = decode(row["prior"], [row["payload"][a:b] for a, b in zip(cuts[:-1], cuts[1:])], row["n_ids"], row["block"])
    for i, crc in enumerate(row["block_crc32"]):
        if _crc(ids[i * row["block"] : (i + 1) * row["block"]]) != crc:
            raise ValueError(f"shard {row['shard']}, chunk {row['chunk']}, block {i}: the checksum doesn't fit")
    return ids


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """Decode a file: doc_id, start, n_tokens, ids_crc32 of every document in it."""
    file = read_file(spark, out)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = read_tokens(row).astype("<u4")
                hand_back()
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                n = len(lengths)
                crcs = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends.tolist(), lengths.tolist())]
                columns = [np.full(n, row["shard"], np.int32), np.full(n, row["chunk"], np.int32), np.arange(n), row["doc_ids"], ends - lengths, lengths, crcs]
                kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "chunk", "place", "doc_id", "inside", "n_tokens", "ids_crc32"])

    read = file.mapInArrow(run, READ)
    chunks = file.select("shard", "chunk", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))  # one row a shard
    shards = shards.select("shard", before(Window.orderBy("shard")).alias("shard_start"))
    chunks = chunks.select("shard", "chunk", before(Window.partitionBy("shard").orderBy("chunk")).alias("chunk_start"))
    placed = read.join(chunks.join(shards, "shard"), ["shard", "chunk"])
    return placed.select("doc_id", (F.col("shard_start") + F.col("chunk_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
