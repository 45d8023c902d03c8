"""Graph and chunk tables kept up to date from streams.

A micro-batch is written once, to a folder of its own number, so a batch that
is run again replaces itself; nothing else is rewritten. Readers take the
newest row of each key, and compact() folds what has been written so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph


def _stream(stream: DataFrame, path: str, checkpoint: str, make):
    def merge(batch: DataFrame, n: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_chunks(stream: DataFrame, path: str, checkpoint: str):
    """A query that takes in a stream of chunks (source_file, chunk_id, text); chunks_at() reads them."""
    return _stream(stream, path, checkpoint, graph.fresh_chunks)


def chunks_at(spark: SparkSession, path: str) -> DataFrame:
    """source_file, chunk_id, text, chunk_key: the newest text of each chunk."""
    rows = spark.read.parquet(path)
    return rows.groupBy("chunk_key").agg(F.max_by(F.struct("source_file", "chunk_id", "text"), F.struct("batch", "text")).alias("r")).select("r.*", "chunk_key")


def upsert_edges(stream: DataFrame, path: str, checkpoint: str):
    """The same for triples (subject, relation, object); edges_at() reads the set of edges."""
    return _stream(stream, path, checkpoint, graph.edges)


def edges_at(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("src", "rel", "dst").distinct()


def compact(rows: DataFrame, path: str) -> None:
    """Write chunks_at() or edges_at() as one table at another path, whose numbers begin before any batch."""
    rows.write.mode("overwrite").parquet(f"{path}/batch=-1")
