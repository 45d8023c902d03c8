"""Texts to chunks: fixed windows in SQL, and a recursive splitter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import strip


def check(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and overlap from 0 to below size")


def fixed_windows(docs: DataFrame, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, key: str = "doc_id") -> DataFrame:
    """key, chunk_id (from 1, without gaps), start (from 0), text: windows of `size` characters every size - overlap; blank ones are left out."""
    check(size, overlap)
    starts = F.filter(
        F.transform(F.sequence(F.lit(0), F.length("text") - 1, F.lit(size - overlap)), lambda s: F.struct(s.alias("start"), F.substring(F.col("text"), s + 1, F.lit(size)).alias("text"))),
        lambda c: strip(c["text"]) != "",
    )
    rows = docs.filter(F.length("text") > 0).select(key, F.posexplode(starts).alias("i", "c"))
    return rows.select(key, (F.col("i") + 1).alias("chunk_id"), F.col("c.start").alias("start"), F.col("c.text").alias("text"))


def split_recursively(text: str, size: int, overlap: int, separators: list[str] | None = None) -> list[str]:
    """Pieces of at most `size` characters where a separator allows it, the coarsest separator first; overlap in whole pieces."""
    separators = fixed.SEPARATORS if separators is None else separators
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        first, *rest = text.split(separator)
        parts = [p for p in (first, *(separator + r for r in rest)) if p]
    else:
        parts = list(text)
    out: list[str] = []
    short: list[str] = []
    for p in parts:
        if len(p) < size:
            short.append(p)
            continue
        out += _packed(short, size, overlap)
        short = []
        out += split_recursively(p, size, overlap, finer) if finer else [p]
    return out + _packed(short, size, overlap)


def _packed(parts: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring parts joined up to `size`; each next piece begins with the last parts of the one before, up to `overlap`."""
    out, window, held = [], [], 0

    def emit() -> None:
        if piece := "".join(window).strip():
            out.append(piece)

    for p in parts:
        if window and held + len(p) > size:
            emit()
            while held > overlap or (held and held + len(p) > size):
                held -= len(window.pop(0))
        window.append(p)
        held += len(p)
    emit()
    return out


def recursive(docs: DataFrame, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, key: str = "doc_id") -> DataFrame:
    """key, chunk_id (from 1), text by split_recursively; blank texts have no chunks."""
    check(size, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                t = b.column(1)[row].as_py()
                texts = split_recursively(t, size, overlap) if t and t.strip() else []
                if texts:
                    own = b.column(0).take(pa.array([row] * len(texts)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(range(1, len(texts) + 1), pa.int32()), pa.array(texts, pa.string())], names=[key, "chunk_id", "text"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk_id int, text string")
