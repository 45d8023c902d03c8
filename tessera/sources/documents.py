"""Reading documents and processed JSON, the content-addressed cache, and sinks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed
from ..functions.text import safe_stem, strip
from .shared import written

TRIPLE = "struct<subject:string,relation:string,object:string>"
CHUNK = f"struct<chunk_id:int,text:string,status:string,triples:array<{TRIPLE}>,error:string>"
PROCESSED = f"cache_version int, source_file string, file_hash string, total_characters long, chunk_size int, overlap int, total_chunks int, successful_chunks int, failed_chunks int, total_triples int, chunks array<{CHUNK}>, triples array<{TRIPLE}>, _corrupt_record string"


def pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], keep_empty: bool = False) -> DataFrame:
    """source_file, file_hash, page (from 1), text of binary files, a row for each page; `parse` gives the texts of a file's pages. Blank pages are left out, or kept as empty texts; numbers count them either way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in enumerate(b.column(2)):
                texts = [(n, p or "") for n, p in enumerate(parse(raw.as_py()), 1)]
                texts = [(n, p if p.strip() else "") for n, p in texts if keep_empty or p.strip()]
                one = b.slice(i, 1).take(pa.array([0] * len(texts), pa.int64()))
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array([n for n, _ in texts], pa.int32()), pa.array([t for _, t in texts], pa.string())], names=["source_file", "file_hash", "page", "text"])

    return _binary(spark, path).mapInArrow(run, "source_file string, file_hash string, page int, text string")


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.sha2("content", 256).alias("file_hash"), "content")


def files(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], keep_empty: bool = False) -> DataFrame:
    """source_file, file_hash, text of binary files: the pages that `parse` gives, joined by newlines; blank pages are left out unless kept. A file without text is an error row (error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for raw in b.column(2):
                found = [p or "" for p in parse(raw.as_py())]
                texts.append("\n".join(p for p in found if keep_empty or p.strip()))
            errors = [None if t.strip() else "no text" for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["source_file", "file_hash", "text", "error"])

    return _binary(spark, path).mapInArrow(run, "source_file string, file_hash string, text string, error string")


def accepted_uploads(uploads: DataFrame) -> DataFrame:
    """uploads (name, size) with status (400, 413 or 200) and the stored name."""
    status = F.when(~F.lower("name").endswith(".pdf"), 400).when(F.col("size") > fixed.MAX_UPLOAD, 413).otherwise(200)
    return uploads.withColumn("status", status).withColumn("stored", F.concat(safe_stem(F.col("name")), F.lit(".pdf")))


def file_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Processed documents (JSON, one object a file); broken files are left out."""
    rows = spark.read.schema(PROCESSED).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("source_path", F.col("_metadata.file_path"))
    # the reader's mark of a broken file can't be filtered on as it reads
    return written(rows).filter("_corrupt_record is null").drop("_corrupt_record")


def triples_of(processed: DataFrame) -> DataFrame:
    """source_file, chunk_id, pos, subject, relation, object in document order; a document without triples in its chunks gives its flat list."""
    nested = processed.select("source_file", "chunks", "triples", F.aggregate(F.coalesce("chunks", F.array()), F.lit(0), lambda s, c: s + F.size(F.coalesce(c["triples"], F.array()))).alias("n"))
    by_chunk = nested.filter("n > 0").select("source_file", F.posexplode("chunks").alias("c", "chunk")).select("source_file", "c", F.col("chunk.chunk_id").alias("chunk_id"), F.posexplode("chunk.triples").alias("t", "x"))
    flat = nested.filter("n = 0").select("source_file", F.lit(0).alias("c"), F.lit(None).cast("int").alias("chunk_id"), F.posexplode("triples").alias("t", "x"))
    rows = by_chunk.unionByName(flat)
    return rows.select("source_file", "chunk_id", (F.col("c").cast("long") * (1 << 32) + F.col("t")).alias("pos"), "x.subject", "x.relation", "x.object")


def texts_of(processed: DataFrame) -> DataFrame:
    """source_file, chunk_id, text of non-blank chunks."""
    return processed.select("source_file", F.explode("chunks").alias("c")).select("source_file", "c.chunk_id", "c.text").filter(strip(F.coalesce("text", F.lit(""))) != "")


def compatible(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cached documents that fit: version, hash, chunk size, overlap and number of chunks all equal; the name doesn't count."""
    return cache.filter(F.col("cache_version") == fixed.CACHE_VERSION).join(wanted.select("file_hash", "chunk_size", "overlap", "total_chunks"), ["file_hash", "chunk_size", "overlap", "total_chunks"], "left_semi")


def marked(chunks: DataFrame, cached: DataFrame, key: str = "doc_id") -> DataFrame:
    """chunks with reused and triples: whether the cached text of the chunk is the same and was a success, and what was found then. One join, by key, number and the text's hash; the cache holds a chunk once."""
    done = cached.filter("status = 'success'").select(F.col(key).alias("_key"), F.col("chunk_id").alias("_id"), F.sha2("text", 256).alias("_hash"), "triples")
    same = (F.col(key) == F.col("_key")) & (F.col("chunk_id") == F.col("_id")) & (F.sha2("text", 256) == F.col("_hash"))
    return chunks.join(done, same, "left").withColumn("reused", F.col("_key").isNotNull()).drop("_key", "_id", "_hash")


def reuse(chunks: DataFrame, cached: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(reused, to do): a chunk is reused if its cached text is the same and was a success. Successes that are not visited yet stay in the cache."""
    both = marked(chunks, cached, key)
    return both.filter("reused").drop("reused"), both.filter("not reused").drop("reused", "triples")


CACHED = f"cache_version int, file_hash string, chunk_size int, overlap int, total_chunks int, chunk_id int, text string, status string, error string, triples array<{TRIPLE}>, saved long"


def save_chunks(chunks: DataFrame, home: str, saved: int) -> None:
    """Add chunk results (columns of CACHED but cache_version and saved) to the cache below home. A commit makes all of them seen at once; what an interrupted run had added stays."""
    rows = chunks.withColumn("cache_version", F.lit(fixed.CACHE_VERSION)).withColumn("saved", F.lit(saved).cast("long"))
    rows.select(*[F.col(c.name).cast(c.dataType) for c in StructType.fromDDL(CACHED)]).write.mode("append").partitionBy("chunk_size", "overlap").parquet(f"{home}/chunks")


def cached_chunks(spark: SparkSession, home: str, wanted: DataFrame) -> DataFrame:
    """The newest result of each cached chunk of the wanted documents (file_hash, chunk_size, overlap, total_chunks) that fits them; empty without a cache."""
    if not exists(spark, f"{home}/chunks"):
        return spark.createDataFrame([], CACHED)
    rows = spark.read.schema(CACHED).parquet(f"{home}/chunks")
    newest = F.struct("saved", F.col("status") == "success", "text")
    keys = ["file_hash", "chunk_size", "overlap", "total_chunks", "chunk_id"]
    return compatible(rows, wanted).groupBy(*keys).agg(F.max_by(F.struct("text", "status", "error", "triples"), newest).alias("r")).select(*keys, "r.*")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_state(spark: SparkSession, home: str, state: dict) -> None:
    """Add a state (a dict that JSON can hold) to those below home; the one saved last counts."""
    spark.createDataFrame([(time.time_ns(), json.dumps(state))], "saved long, state string").coalesce(1).write.mode("append").json(f"{home}/state")


def load_state(spark: SparkSession, home: str) -> dict | None:
    """The state saved last, or None."""
    if not exists(spark, f"{home}/state"):
        return None
    last = spark.read.schema("saved long, state string").json(f"{home}/state").filter("state is not null").orderBy(F.desc("saved")).first()
    return json.loads(last["state"]) if last else None


def cache_stats(chunks: DataFrame) -> DataFrame:
    """One row: successful, failed, triples."""
    return chunks.agg(F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum(F.size(F.coalesce("triples", F.array()))), F.lit(0)).alias("triples"))


def is_complete(processed: DataFrame) -> DataFrame:
    """source_file, complete: as many chunks as stated, each a success with text and a list of triples. The version doesn't count."""
    fine = F.forall("chunks", lambda c: (c["status"] == "success") & (strip(F.coalesce(c["text"], F.lit(""))) != "") & c["triples"].isNotNull())
    return processed.select("source_file", "file_hash", F.coalesce((F.size("chunks") == F.col("total_chunks")) & fine, F.lit(False)).alias("complete"))


def normalised(decisions: DataFrame, chunks: DataFrame, documents: DataFrame, model: str) -> DataFrame:
    """One row for each document as it is saved: its fields, counts before and after, chunks in order with their normalised triples, and how they were normalised.

    decisions: source_file, chunk_id, pos, subject, relation, object of kept
    triples; chunks: source_file, chunk_id, text, status, error, triples (as
    extracted); documents: source_file, total_characters, chunk_size, overlap.
    A chunk without triples has empty lists; a document without chunks too.
    """
    own = ["subject", "relation", "object"]
    plain = lambda c: F.transform(F.coalesce(c, F.array()), lambda t: F.struct(*[t[x].alias(x) for x in own]))
    found = decisions.groupBy("source_file", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", *own))).alias("found"))
    rows = chunks.select("source_file", "chunk_id", "text", "status", "error", F.size(F.coalesce("triples", F.array())).alias("raw_triple_count")).join(found, ["source_file", "chunk_id"], "left")
    rows = rows.withColumn("triples", plain(F.col("found"))).withColumn("normalized_triple_count", F.size("triples"))
    one = F.struct("chunk_id", "text", "status", "raw_triple_count", "normalized_triple_count", "triples", "error")
    by_document = rows.groupBy("source_file").agg(
        F.count("*").alias("total_chunks"),
        F.count_if(F.col("status") == "success").alias("successful_chunks"),
        F.count_if(F.col("status") == "failed").alias("failed_chunks"),
        F.sum("raw_triple_count").alias("raw_total_triples"),
        F.sum("normalized_triple_count").alias("normalized_total_triples"),
        F.array_sort(F.collect_list(one)).alias("chunks"),
    )
    how = F.struct(F.lit("exact_mapping_then_semantic").alias("method"), F.lit(model).alias("embedding_model"), F.lit(fixed.RELATION_MATCH).alias("match_threshold"), F.lit(len(set(fixed.RELATION_MAP.values()))).alias("initial_canonical_relation_count"))
    out = documents.join(by_document, "source_file", "left").withColumn("normalization", how)
    counts = ["total_chunks", "successful_chunks", "failed_chunks", "raw_total_triples", "normalized_total_triples"]
    return out.select(*documents.columns, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("chunks", F.array()).alias("chunks"), "normalization")


def save_normalised(decisions: DataFrame, chunks: DataFrame, documents: DataFrame, model: str, path: str) -> None:
    """normalised() as JSON, one document a line; a replaced folder appears whole."""
    normalised(decisions, chunks, documents, model).write.mode("overwrite").json(path)


def totals(triples_in: DataFrame, triples_out: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each source file: total_chunks, input_triples and resolved_unique_triples."""
    before = triples_in.groupBy("source_file").agg(F.count("*").alias("input_triples"))
    after = triples_out.groupBy("source_file").agg(F.count("*").alias("resolved_unique_triples"))
    none = F.lit(0).cast("long")
    return documents.select("source_file", "total_chunks").join(before, "source_file", "left").join(after, "source_file", "left").select("source_file", "total_chunks", F.coalesce("input_triples", none).alias("input_triples"), F.coalesce("resolved_unique_triples", none).alias("resolved_unique_triples"))


def clusters(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (name, canonical): entities (canonical_name, aliases) and entity_clusters (canonical, members); members are all names, aliases those that differ from the canonical one."""
    by_name = names.groupBy("canonical").agg(F.sort_array(F.collect_set("name")).alias("members"))
    entities = by_name.select(F.col("canonical").alias("canonical_name"), F.filter("members", lambda m: m != F.col("canonical")).alias("aliases"))
    return entities, by_name.filter(F.size("members") > 1)


def save_resolved(triples: DataFrame, names: DataFrame, decisions: DataFrame, summary: DataFrame, path: str) -> None:
    """triples, entities, entity_clusters, resolution_decisions and totals (of totals()) as JSON below path; a replaced folder appears whole."""
    entities, members = clusters(names)
    said = decisions.select(F.col("x.name").alias("entity"), F.col("y.name").alias("candidate"), "method", "reason", F.round("semantic", 4).alias("semantic"), F.round("lexical", 2).alias("lexical"), F.round("token", 4).alias("token"), F.round("context", 4).alias("context"), F.round("combined", 4).alias("combined"), F.round("cross_encoder", 4).alias("cross_encoder"), "merge")
    for name, rows in (("triples", triples), ("entities", entities), ("entity_clusters", members), ("resolution_decisions", said), ("totals", summary)):
        rows.write.mode("overwrite").json(f"{path}/{name}")
