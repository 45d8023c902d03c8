"""Helpers shared by the operators: reading tables, cutting lineage, slicing Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, written

#: Bytes of text that a Python worker holds as numpy arrays at a time; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20


#: Rows in an Arrow batch on the way to a Python worker, unless the session says otherwise. Spark's default of 10,000 whole texts fills a worker before it can be sliced.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch from Spark's default; another setting is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


materialise = written


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that each piece holds about `limit` bytes of `column` (a longer value stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(n)
        yield batch.slice(begin)


def file_backed(docs: DataFrame) -> bool:
    """Whether docs is Parquet files as read, so that the place of a row in its file is known."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema
    except AnalysisException:  # no file metadata behind this plan
        return False
    return "_metadata" not in docs.columns and bool(docs.inputFiles())


#: What tells a row from all others: its file, as a hash of the path, and its place there. No other column names are reserved.
PLACE = ["_tessera_file", "_tessera_row"]


def placed(docs: DataFrame) -> DataFrame:
    """docs with PLACE. Unless they are Parquet files as read, less rows or columns at most, they are written to the shared folder first: a join or generator can repeat a row with its place."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or not file_backed(docs):
        docs = materialise(docs)
    return docs.select("*", F.xxhash64("_metadata.file_path").alias("_tessera_file"), F.col("_metadata.row_index").alias("_tessera_row"))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """placed() rows but those whose PLACE is in gone, without PLACE."""
    return rows.join(gone.select(PLACE), PLACE, "left_anti").drop(*PLACE)


#: Rows of a file that make a block, and bytes of a text that makes a block of its own: a block holds at most their product.
BLOCK_ROWS, LONG_BYTES = 1024, 1 << 15


def in_blocks(docs: DataFrame, *also: str | Column, long_bytes: int = LONG_BYTES) -> DataFrame:
    """doc_id, text, block, further columns: rows of one file that lie together have one block, the same at every reading; a long text has its own."""
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))
    where = F.when(long, F.xxhash64(file, F.lit("row"), row)).otherwise(F.xxhash64(file, F.floor(row / BLOCK_ROWS)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), where.alias("block"), *also)
