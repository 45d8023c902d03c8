"""Pluggable models with deterministic local defaults: embedder, extractor, generator."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import fixed
from ..functions.text import query_tokens

DIMENSIONS = 64


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Counts of query tokens by md5 bucket, to unit length; zeros without tokens. Similarity thresholds made for trained models mean little here."""
    buckets = F.transform(query_tokens(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dimensions)))
    # whatever is used more than once is bound by a lambda: an expression would be computed anew at each place
    counts = F.aggregate(buckets, F.array_repeat(F.lit(0.0), dimensions), lambda seen, b: F.transform(seen, lambda x, i: F.when(i == b, x + 1).otherwise(x)))
    sized = F.transform(F.array(counts), lambda c: F.struct(c.alias("c"), F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)).alias("norm")))
    return F.get(F.transform(sized, lambda v: F.when(v["norm"] > 0, F.transform(v["c"], lambda x: x / v["norm"])).otherwise(v["c"])), F.lit(0))


def embed(rows: DataFrame, text: str = "representation") -> DataFrame:
    return rows.withColumn("embedding", hashed_embedding(F.col(text)))


def embed_string(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """The same embedding of one string, in Python."""
    import hashlib

    from ..functions.fixed import STOPWORDS

    tokens = dict.fromkeys(t for t in re.findall(r"[a-z0-9]+(?:\.[a-z0-9]+)?", text.lower()) if len(t) > 1 and t not in STOPWORDS)
    v = [0.0] * dimensions
    for t in tokens:
        v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dimensions] += 1
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v


_FACT = re.compile(r"([A-Z][\w-]*(?: [A-Z][\w-]*)*) (uses|is|has|contains|provides|supports|produces|extends|stores) (?:an? |the )?([\w-]+(?: [A-Z][\w-]*)*)")


def rule_extractor(text: str) -> list[dict]:
    """Subject, verb, object of plain sentences; each triple once."""
    found = dict.fromkeys((m.group(1), m.group(2), m.group(3)) for m in _FACT.finditer(text or ""))
    return [{"subject": s, "relation": r, "object": o} for s, r, o in found]


def with_retries(call: Callable, argument, attempts: int = 3, first_wait: float = 4.0, sleep: Callable = time.sleep):
    """(result, None), or (None, error) after the last attempt; waits double in between."""
    for n in range(attempts):
        try:
            return call(argument), None
        except Exception as e:  # whatever a remote model raises is one failed attempt
            error = str(e)
            if n + 1 < attempts:
                sleep(first_wait * 2**n)
    return None, error


def extract(chunks: DataFrame, extractor: Callable[[str], list[dict]] = rule_extractor, per_minute: float | None = None, attempts: int = 3, first_wait: float = 4.0) -> DataFrame:
    """chunks (doc_id, chunk_id, text) with status, error and triples (array). Blank texts succeed with none.

    With `per_minute`, calls are spaced in one partition, since the limit is one for all.
    """
    triple = pa.struct([("subject", pa.string()), ("relation", pa.string()), ("object", pa.string())])
    doc_type = chunks.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0.0
        for b in batches:
            status, errors, triples = [], [], []
            for text in b.column(2).to_pylist():
                if per_minute:
                    time.sleep(max(0.0, last + 60 / per_minute - time.monotonic()))
                    last = time.monotonic()
                found, error = with_retries(extractor, text, attempts, first_wait) if text and text.strip() else ([], None)
                status.append("failed" if found is None else "success")
                errors.append(error)
                triples.append(found or [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(status), pa.array(errors, pa.string()), pa.array(triples, pa.list_(triple))], names=["doc_id", "chunk_id", "text", "status", "error", "triples"])

    rows = chunks.select("doc_id", F.col("chunk_id").cast("int").alias("chunk_id"), "text")
    rows = rows.coalesce(1) if per_minute else rows
    return rows.mapInArrow(run, f"doc_id {doc_type}, chunk_id int, text string, status string, error string, triples array<struct<subject:string,relation:string,object:string>>")


def response_text(response) -> str:
    """The plain text of a model's reply: a string, an object with `content`, or a list of blocks, of which those with text count."""
    content = getattr(response, "content", response)
    if isinstance(content, list):
        said = [b if isinstance(b, str) else str(b.get("text") or "") for b in content if isinstance(b, str) or isinstance(b, dict) and b.get("type", "text") == "text"]
        content = "\n".join(t for t in said if t)
    return str(content).strip()


_MODELS: dict[str, object] = {}


def once(name: str, make: Callable[[], object]):
    """The model of this name, made when first asked for: one for each Python worker, whatever the number of batches."""
    if name not in _MODELS:
        _MODELS[name] = make()
    return _MODELS[name]


def embed_with(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], name: str, text: str = "representation", batch: int = fixed.EMBED_BATCH) -> DataFrame:
    """rows with embedding from a model that `make` loads once in each worker; it is called with `batch` texts at a time. Null texts are embedded as empty ones."""
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(DoubleType()))])
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(name, make)
        for b in batches:
            for first in range(0, b.num_rows, batch):
                part = b.slice(first, batch)
                vectors = model([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*part.schema.names, "embedding"])

    return rows.mapInArrow(run, schema)


def extractive_answer(question: str, evidence: list[str]) -> str:
    """The sentence of the evidence with most words of the question; a plain refusal without any."""
    words = set(re.findall(r"[a-z0-9]+", question.lower()))
    best = max((s for e in evidence for s in re.split(r"(?<=[.!?])\s+|\n", e)), key=lambda s: len(words & set(re.findall(r"[a-z0-9]+", s.lower()))), default="")
    return best.strip() if words & set(re.findall(r"[a-z0-9]+", best.lower())) else "Insufficient evidence."
