"""Token counts by a compiled finite-state tokenizer; see transducer.

Exactly the tokenizers library's counts, with its default for special strings inside
texts, without added tokens, truncation or padding.

Defined results: null and empty texts have 0 bytes and 0 tokens. Whole texts are read,
however long. Rows that repeat are counted alike. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .transducer import tokenizer
from .words import buffers

LIMIT = 512


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. path: a tokenizers file that every executor has."""

    def run(batches):
        for piece in slices(batches):
            text = piece.column("text")
            n_bytes = np.diff(buffers(text)[1])
            counts = tokenizer(path).counts(text)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id BIGINT, n_bytes BIGINT, n_tokens BIGINT")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
