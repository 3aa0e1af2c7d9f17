"""The corpus pipeline: documents through five stages, each stage's rows being the next one's documents.

Reject toxic documents, keep one document of each near-duplicate group, drop documents
that hold benchmark items, mix the sources to their target weights, write token ids.
All stages but the last return the columns of documents.

In every stage an empty table gives an empty result, texts of any length are read whole,
a null text counts as empty, and columns beside doc_id, text and source pass through
unread, whatever their names (they can't be maps in the second stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeweave.llm import decontam, mixing, neardup, token_files, toxicity
from cladeweave.llm.common import release, shared_dir, written
from cladeweave.llm.queries import table, vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the model learns from the labelled rows among docs.

    Rows that repeat are scored alike. Without labels every score is 0 and all rows stay.
    Null and empty texts get the score of the bias.
    """
    return toxicity.civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Of rows that repeat this doc_id the one with the smallest SHA-256 of its text stays,
    then the one with the smallest hash of all columns. Rows without doc_id all stay, and
    so do texts without words, which are alike with nothing.
    """
    kept = neardup.near_dedup(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    first = F.min_by(F.struct(*docs.columns), F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.xxhash64(*docs.columns))).alias("row")
    return named.groupBy("doc_id").agg(first).select("row.*").unionByName(docs.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates.

    Rows that repeat are judged alike. Empty and short texts stay; an empty benchmark
    drops nothing.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last copy on a source's cut ends after the words taken.

    Texts without words are never taken. A null source is a source of its own. Rows that
    repeat a doc_id are documents of their own; equal rows on a cut take turns.
    """
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all rows in one file; what is read back of it: doc_id, start, n_tokens, ids_crc32.

    Rows that repeat a doc_id follow each other by a hash of the text; a null doc_id comes
    first. An empty text is the end id alone.
    """
    out = f"{shared_dir(spark)}/tokens"
    token_files.write_tokens(docs, vocabulary(), out)
    return token_files.read_documents(spark, out)


STAGES = [
    ("toxicity", reject_toxic),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token files", write_tokens),
]

#: The toxicity model, shingle sets and tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = table(spark, sf_dir, "documents"), shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), root, f"stage_{i}")
        if i:
            release(spark, f"{root}/stage_{i - 1}")
    return docs
