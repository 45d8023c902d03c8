"""The property graph as tables: nodes, edges, upserts, paths and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .relations import first_by


def _usable(triples: DataFrame) -> DataFrame:
    s, o = T.strip(F.col("subject")), T.strip(F.col("object"))
    return triples.withColumn("subject", s).withColumn("object", o).filter("subject <> '' and object <> ''")


def edges(triples: DataFrame) -> DataFrame:
    """src, rel, dst: set of typed edges; triples with a blank end are left out."""
    return _usable(triples).select(F.col("subject").alias("src"), T.edge_type(F.col("relation")).alias("rel"), F.col("object").alias("dst")).distinct()


def nodes(triples: DataFrame, order: list[str] = ["pos"]) -> DataFrame:
    """name, source_file: the first file that named it, by the columns of `order`."""
    t = _usable(triples)
    both = t.select(F.explode(F.array(F.struct(F.col("subject").alias("name"), F.struct(*order, F.lit(0).alias("side")).alias("at"), "source_file"), F.struct(F.col("object").alias("name"), F.struct(*order, F.lit(1).alias("side")).alias("at"), "source_file"))).alias("n")).select("n.*")
    return both.groupBy("name").agg(F.min_by("source_file", F.struct("at", "source_file")).alias("source_file"))


def add_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """First writer wins."""
    return old.unionByName(new.join(old.select("name"), "name", "left_anti"))


def add_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).distinct()


def fresh_chunks(new: DataFrame) -> DataFrame:
    """source_file, chunk_id, text, chunk_key of chunks: null ids and blank texts are left out, texts stripped, a key once."""
    fresh = new.filter(F.col("chunk_id").isNotNull() & (T.strip(F.coalesce("text", F.lit(""))) != "")).withColumn("text", T.strip(F.col("text")))
    fresh = fresh.withColumn("chunk_key", F.concat_ws("::", "source_file", F.col("chunk_id").cast("string"))).select("source_file", "chunk_id", "text", "chunk_key")
    return first_by(fresh, ["chunk_key"], [F.desc("text")])


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the fresh chunks of new; the new text wins."""
    fresh = fresh_chunks(new)
    return old.select(*fresh.columns).join(fresh.select("chunk_key"), "chunk_key", "left_anti").select(*fresh.columns).unionByName(fresh)


def counts(n: DataFrame, c: DataFrame, e: DataFrame) -> DataFrame:
    """One row: entities, chunks, relationships, embedded chunks, embedded entities."""
    size = lambda df, name: df.agg(F.count("*").alias(name), (F.count("embedding") if "embedding" in df.columns else F.lit(0)).alias(f"embedded_{name}"))
    return size(n, "entities").crossJoin(size(c, "chunks")).crossJoin(e.agg(F.count("*").alias("relationships")))


def violations(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(key).count().filter("count > 1")


def wrong_dimension(rows: DataFrame, dimensions: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there but has another length."""
    return rows.filter(F.col(vector).isNotNull() & (F.size(vector) != dimensions))


def paths(e: DataFrame, seeds: DataFrame, hops: int = fixed.MAX_HOPS, limit: int | None = fixed.MAX_PATHS) -> DataFrame:
    """entities, relationships: directed simple paths of 1 to `hops` edges that begin or end at a seed (column name).

    They grow from the seeds, forwards and backwards, so paths that touch no
    seed are never made. With a limit, the first by hops, entities and
    relationships; longer paths are not made once shorter ones fill it.
    """
    s = seeds.select(F.col("name").alias("seed")).distinct()
    e = e.select("src", "rel", "dst").filter("src <> dst")
    ahead = e.join(s, F.col("src") == F.col("seed"), "left_semi").select(F.array("src", "dst").alias("entities"), F.array("rel").alias("relationships"))
    back = e.join(s, F.col("dst") == F.col("seed"), "left_semi").select(F.array("src", "dst").alias("entities"), F.array("rel").alias("relationships"))
    found = ahead.unionByName(back).distinct()
    for _ in range(hops - 1):
        if limit and found.limit(limit).count() >= limit:
            break
        last, first = F.element_at("entities", -1), F.element_at("entities", 1)
        ahead = ahead.join(e, (last == F.col("src")) & ~F.array_contains("entities", F.col("dst"))).select(F.concat("entities", F.array("dst")).alias("entities"), F.concat("relationships", F.array("rel")).alias("relationships"))
        back = back.join(e, (first == F.col("dst")) & ~F.array_contains("entities", F.col("src"))).select(F.concat(F.array("src"), "entities").alias("entities"), F.concat(F.array("rel"), "relationships").alias("relationships"))
        found = found.unionByName(ahead.unionByName(back).distinct())
    return found.orderBy(F.size("relationships"), "entities", "relationships").limit(limit) if limit else found


def path_text(entities: Column, relationships: Column) -> Column:
    """a REL b ; b REL c"""
    step = lambda i: F.concat_ws(" ", F.get(entities, i), F.get(relationships, i), F.get(entities, i + 1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(relationships) - 1), step), " ; ")


def _count(values: Column, test) -> Column:
    """How many values of a path pass a test. Places of paths up to MAX_HOPS are looked at one by one, in compiled code; a lambda would be interpreted."""
    places = fixed.MAX_HOPS + 1
    near = [F.when(F.size(values) > i, test(F.get(values, F.lit(i))).cast("int")).otherwise(0) for i in range(places)]
    far = F.when(F.size(values) > places, F.size(F.filter(F.slice(values, places + 1, 1 << 20), test))).otherwise(0)
    return sum(near, far).cast("double")


def value_relevance(entities: Column) -> Column:
    return F.least(F.lit(0.04) * _count(entities, T.is_value_name), F.lit(0.08).cast("double"))


def specificity(relationships: Column) -> Column:
    generic = _count(relationships, lambda r: r.isin(fixed.GENERIC_RELATIONS))
    telling = F.size(relationships) - generic
    return F.least(F.lit(0.03) * telling, F.lit(0.06).cast("double")) - F.least(F.lit(0.035) * generic, F.lit(0.07).cast("double"))


def metadata_penalty(entities: Column, relationships: Column) -> Column:
    return F.least(F.lit(0.20) * _count(relationships, lambda r: r.isin(fixed.METADATA_RELATIONS)), F.lit(0.40).cast("double")) + F.least(F.lit(0.10) * _count(entities, T.is_metadata_name), F.lit(0.20).cast("double"))


def path_score(semantic: Column, entities: Column, relationships: Column, seed_hits: Column, overlap: Column) -> Column:
    """Similarity, seeds met, few hops, question words met, values and telling relations; less for metadata."""
    hop = F.when(F.size(relationships) == 1, 0.08).when(F.size(relationships) == 2, 0.03).otherwise(0.0)
    return semantic + F.least(F.lit(0.06) * seed_hits, F.lit(0.12).cast("double")) + hop + F.least(F.lit(0.10) * overlap, F.lit(0.10).cast("double")) + value_relevance(entities) + specificity(relationships) - metadata_penalty(entities, relationships)
