"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

The shares of the sources are a water level: every source gets level x weight
unless that is above `max_epochs` x its size, where it stops; the level is the
one at which the shares add up to `epochs` x all sizes. With sources ranked by
cap / weight that level follows from prefix sums.

A source's target over its size is a number of repetitions: the whole part
goes to each of its documents, the rest to documents in a seeded random order
until it is used up; the last of them gives only its first words. So each
source is met to the word. The order is that of a hash, in buckets by its
first digits, so that only bucket sums are ordered within a source and a
source with most of the rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a hash that name a bucket of a source; a source of n rows is sorted in pieces of n / 16 ** BUCKET_DIGITS.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, epochs: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, weigh `weights` in turn. A source of
    size 0 gets target 0. Where all caps together are below the wanted total,
    every source gets its cap. One row for each source goes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", F.col("source_size").cast("long").alias("source_size"), w.cast("long").alias("w"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = (
        ranked.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("wanted", F.lit(float(epochs)) * F.sum("source_size").over(every))
        .withColumn("level", (F.col("wanted") - F.col("cap_before")) / F.col("w_left"))
        # the first source in this order that stays below its cap sets the level
        .withColumn("rank", F.row_number().over(by_ratio))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(every)["level"])
    )
    target = F.when(F.col("level").isNull() | (F.col("level") * F.col("w") > F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w"))
    return filled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, epochs: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = (3, 1, 2), seed: int = 8) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, whole (full repetitions), part (words of a further one).

    docs needs doc_id, text and source; other columns are ignored, whatever
    their names. Null or empty texts have size 0 and take 0; a null source is
    a source of its own; rows that repeat a doc_id count each for itself; of
    repeated equal rows the order is any, as they are alike; rows without an
    id go by their texts. An empty table gives an empty result.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    sized = docs.select(
        F.col("doc_id"),
        F.col("source"),
        n_words(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), name).cast("binary")).alias("lot"),
    ).withColumn("bucket", F.conv(F.substring("lot", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    by_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    shares = targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), epochs, max_epochs, weights)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        by_bucket.withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
        .join(shares.withColumnRenamed("source", "share_source"), F.col("source").eqNullSafe(F.col("share_source")))
        .select(F.col("source").alias("plan_source"), F.col("bucket").alias("plan_bucket"), "bucket_before", "source_size", "target")
    )
    order = Window.partitionBy("source", "bucket").orderBy("lot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("in_bucket", F.coalesce(F.sum("size").over(order), F.lit(0))).join(
        plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("bucket") == F.col("plan_bucket"))
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    spare = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long") - F.col("bucket_before") - F.col("in_bucket")
    return (
        placed.withColumn("whole", whole)
        .withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), spare)))
        .withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
        .select("doc_id", "size", "source_size", "target", "taken", "whole", "part")
    )
