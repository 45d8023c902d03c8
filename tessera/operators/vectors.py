"""Exact similarity search and similarity join over array columns; dot products in double precision, rounded to 6 places before ranking, ties to the smaller key."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

#: Rows of a block; rows up to which one block is enough; rows of one block multiplied with another at a time.
BLOCK, FEW, ROWS = 16384, 1000, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def index_score(cosine: Column) -> Column:
    """A cosine on the 0 to 1 scale that cosine indexes report."""
    return (1 + cosine) / 2


def top_k(rows: DataFrame, query: list[float], k: int = fixed.TOP_CHUNKS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of largest dot product with one query vector, with `score`. k <= 0 is an error; rows with a null vector take no part."""
    if k <= 0:
        raise ValueError("k must be positive")
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.filter(F.col(vector).isNotNull()).withColumn("score", F.round(dot(F.col(vector), q), 6)).orderBy(F.desc("score"), key).limit(k)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: rows with a key whose vector is not null and holds finite numbers only."""
    v = F.col("v")
    fine = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(fine)


def similar_pairs(rows: DataFrame, k: int = fixed.CANDIDATES, threshold: float = fixed.CANDIDATE_SIMILARITY, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Candidates of every row: its k most similar rows, itself among them and then dropped, from `threshold` on: a, b, similarity.

    Exact. Rows lie in blocks by a hash of their key, and two blocks meet in
    one task, which keeps the k best of each row from the threshold on: no
    row passes the driver, and a task holds two blocks. Vectors that are null,
    hold null or non-finite numbers, or have another length than most take no
    part, nor do rows with a null key. Ties go to the smaller key.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    plain = usable(rows, key, vector)
    most = plain.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if most is None or not most["size"]:
        return spark.createDataFrame([], f"a {kind}, b {kind}, similarity double")
    blocks = -(-most["count"] // BLOCK)
    if most["count"] > FEW:
        # as many pairs of blocks as there are cores at least
        blocks = max(blocks, math.isqrt(2 * spark.sparkContext.defaultParallelism))
    own = plain.filter(F.size("v") == most["size"]).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cells = own.withColumn("other", other).select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "v")
    best = cells.groupBy("low", "high").applyInArrow(_cell(k, threshold), f"a {kind}, b {kind}, similarity double")
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.filter("a <> b").select("a", "b", "similarity")


def _cell(k: int, threshold: float):
    """Of two blocks, or one: the k best of each row among the rows of the other, from the threshold on."""

    def half(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = []
        for at in range(0, len(q), ROWS):
            s = np.round(q[at : at + ROWS] @ x.T, 6)
            i, j = np.nonzero(s >= threshold)
            found = s[i, j]
            # the columns are in the order of their keys
            order = np.lexsort((j, -found, i))
            i, j, found = i[order], j[order], found[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((i[first] + at, j[first], found[first]))
        return tuple(np.concatenate([o[c] for o in out]) for c in range(3))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        block = group.column("block").to_numpy()
        ids = group.column("id").combine_chunks()
        flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1)
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        sides = [np.flatnonzero(block == b) for b in (low, high)]
        found = []
        for one, two in [sides] if low == high else [sides, sides[::-1]]:
            if len(one) and len(two):
                i, j, s = half(flat[one], flat[two])
                found.append((one[i], two[j], s))
        a, b, s = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, int) for c in range(3))
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "similarity": pa.array(s, pa.float64())})

    return run


def unordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, as first found from its smaller key: a < b, similarity."""
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))


def expand_neighbours(hits: DataFrame, chunks: DataFrame, top: int = fixed.NEIGHBOUR_HITS, radius: int = fixed.NEIGHBOUR_RADIUS) -> DataFrame:
    """Hits (source_file, chunk_id, text, score) and the chunks within `radius` of the first `top` of them, by (source_file, chunk_id); new rows score 0 and are marked is_neighbor.

    The hits are the few of one question: they are fetched once, and their
    neighbours are looked up by key.
    """
    if radius < 0:
        raise ValueError("radius must not be negative")
    columns = ["source_file", "chunk_id", "text", "score"]
    spark = hits.sparkSession
    kept = hits.select(*columns).collect()
    own = spark.createDataFrame([tuple(r) for r in kept], hits.select(*columns).schema).withColumn("is_neighbor", F.lit(False))
    first = sorted(kept, key=lambda r: (-r["score"], r["source_file"], r["chunk_id"]))[: max(0, top)]
    known = {(r["source_file"], r["chunk_id"]) for r in kept}
    wanted = {(r["source_file"], c) for r in first for c in range(r["chunk_id"] - radius, r["chunk_id"] + radius + 1) if c > 0} - known
    if not wanted:
        return own.orderBy("source_file", "chunk_id")
    keys = spark.createDataFrame(sorted(wanted), hits.select("source_file", "chunk_id").schema)
    new = chunks.filter(F.col("source_file").isin(sorted({f for f, _ in wanted}))).join(F.broadcast(keys), ["source_file", "chunk_id"])
    return own.unionByName(new.select("source_file", "chunk_id", "text", F.lit(0.0).alias("score"), F.lit(True).alias("is_neighbor"))).orderBy("source_file", "chunk_id")
