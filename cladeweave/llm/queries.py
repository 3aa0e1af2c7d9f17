"""The queries of this subpackage, by name: each applies one operator to its whole table.

Those without a number show the part of an operator's result that SQL can check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact_dedup, line_dedup, mixing, neardup, quality, search, spelling, token_counts, token_files, toxicity, urls
from .common import shared_dir, small_batches, written


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/tokens"
    token_files.write_tokens(table(spark, sf_dir, "documents"), vocabulary(), out)
    return token_files.read_documents(spark, out)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    output = written(chat.format_chats(chat.events_of_turns(turns.unionByName(extra))), shared_dir(spark), "chats")
    read = chat.parse(output)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_dedup(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *quality.BASE, "base_failed", *[F.round(c, 6).alias(c) for c in ("chars_apart", "words_apart")], "kept")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of op2."""
    return op2_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of op7's sets."""
    small_batches(spark)
    return neardup.sketched(table(spark, sf_dir, "documents"), neardup.K, neardup.WIDTH).select("doc_id", "n_shingles")


def byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of op8's texts."""
    return op8_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


QUERIES = {
    "url_rules": url_rules,
    "shingle_counts": shingle_counts,
    "byte_counts": byte_counts,
    "op1_mixing": op1_mixing,
    "op2_url_filters": op2_url_filters,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_files": op4_token_files,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_toxicity": op6_toxicity,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_quality_rules": op13_quality_rules,
}
