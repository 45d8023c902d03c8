"""Connected components of a table of links by alternating large and small stars; nothing is collected.

The links of a hub lie under one key. Least neighbours are found by partial
aggregation. The join that hands them out gets them under a computed key
(anew), so that it has a plain exchange on both sides, which the adaptive
plan splits where a key is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, written


def anew(key: str) -> Column:
    """The same value, but not known to the planner as the key that the rows were dealt by."""
    return F.greatest(key, key)


def _spread(e: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(anew("a").alias("n"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _gather(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of these."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(anew("a").alias("n"), "m")
    moved = down.join(least, F.col("a") == F.col("n")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (node, root): the least node reachable. Nodes without links are left out; each round is written to the shared folder, and so is the result."""
    e = written(links.filter("a <> b").select("a", "b").distinct())
    before = None
    while True:
        after = written(_gather(_spread(e)).filter("a <> b").distinct())
        discard(e)
        e = after
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    root = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = written(root.unionByName(root.select(F.col("root").alias("node"), "root").distinct()))
    discard(e)
    return out
