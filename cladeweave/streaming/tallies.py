"""Concordance tallies over replicates that arrive as files: the same operators on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.concordance import edge_tallies, mapped
from ..operators.treeindex import TreeIndex
from ..sources.files import QUARTETS


def quartet_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """Scored quartets of the replicate folders below path, as they appear."""
    reader = spark.readStream.schema(QUARTETS + ", rep BIGINT").option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(path)


def streaming_tallies(quartets: DataFrame, tree: TreeIndex, min_snps: int = 0, min_ratio: float = 1.0) -> DataFrame:
    """edge_tallies of a stream; write it in complete mode."""
    return edge_tallies(mapped(quartets, tree, min_snps, min_ratio))
