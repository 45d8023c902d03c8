"""Relation normalisation: exact mapping, semantic match against a registry that grows in triple order, fallbacks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import clean_relation, is_valid_relation, strip


def mapping(spark) -> DataFrame:
    """(cleaned, mapped): the fixed table of relations."""
    return spark.createDataFrame(sorted(fixed.RELATION_MAP.items()), "cleaned string, mapped string")


def exactly(rows: DataFrame, relation: str = "relation") -> DataFrame:
    """rows with cleaned, mapped (null if the table doesn't have it) and valid. The table has a fixed size, so it is broadcast."""
    cleaned = rows.withColumn("cleaned", clean_relation(F.col(relation)))
    return cleaned.join(F.broadcast(mapping(rows.sparkSession)), "cleaned", "left").withColumn("valid", is_valid_relation(F.col("cleaned")))


def grow_registry(relations: list[str], embed: Callable[[str], list[float]], threshold: float = fixed.RELATION_MATCH) -> dict[str, tuple[str, str, float | None]]:
    """For new relations in the order they were first seen: relation -> (canonical, method, similarity). The registry begins with the fixed canonical names in alphabetical order; a relation without a match becomes part of it. Similarity is the cosine, 0 for a zero vector; ties go to the earlier name."""

    def unit(relation: str) -> np.ndarray:
        v = np.array(embed(relation.replace("_", " ")), float)
        size = np.sqrt(v @ v)
        return v / size if size else v

    names = sorted(set(fixed.RELATION_MAP.values()))
    table = np.stack([unit(r) for r in names])
    out: dict[str, tuple[str, str, float | None]] = {}
    for r in relations:
        v = unit(r)
        scores = table @ v
        best = int(np.argmax(scores))
        similarity = float(scores[best])
        if similarity >= threshold:
            out[r] = (names[best], "semantic_match", similarity)
        else:
            names.append(r)
            table = np.concatenate([table, v[None]])
            out[r] = (r, "new_canonical", similarity)
    return out


def normalise(triples: DataFrame, embed: Callable[[str], list[float]], threshold: float = fixed.RELATION_MATCH) -> DataFrame:
    """doc_id, pos, subject, relation, object with canonical relation, method and similarity; subject and object stripped.

    The registry belongs to one document. Only its distinct relations that the
    table doesn't know go through the sequential step, document by document.
    """
    known = exactly(triples)
    open_ = known.filter("mapped is null and cleaned <> '' and valid").groupBy("doc_id", "cleaned").agg(F.min("pos").alias("first_pos"))
    schema = f"doc_id {triples.schema['doc_id'].dataType.simpleString()}, cleaned string, canonical string, how string, similarity double, first_pos long"

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("first_pos")
        found = grow_registry(pdf["cleaned"].tolist(), embed, threshold)
        return pd.DataFrame([(d, c, *found[c], p) for d, c, p in zip(pdf["doc_id"], pdf["cleaned"], pdf["first_pos"])], columns=["doc_id", "cleaned", "canonical", "how", "similarity", "first_pos"])

    grown = open_.groupBy("doc_id").applyInPandas(run, schema).select(F.col("doc_id").alias("g_doc"), F.col("cleaned").alias("g_cleaned"), "canonical", "how", F.col("similarity").alias("g_similarity"), "first_pos")
    out = known.join(grown, (F.col("doc_id") == F.col("g_doc")) & (F.col("cleaned") == F.col("g_cleaned")), "left")
    again = (F.col("how") == "new_canonical") & (F.col("pos") > F.col("first_pos"))
    method = F.when(F.col("cleaned") == "", "fallback_empty").when(F.col("mapped").isNotNull(), "exact_mapping").when(~F.col("valid"), "fallback_invalid").when(again, "semantic_match").otherwise(F.col("how"))
    canonical = F.coalesce("mapped", "canonical", F.lit("related_to"))
    similarity = F.when(F.col("mapped").isNotNull(), F.lit(1.0)).when(again, F.lit(1.0)).otherwise(F.col("g_similarity"))
    return out.select("doc_id", "pos", strip(F.col("subject")).alias("subject"), canonical.alias("relation"), strip(F.col("object")).alias("object"), F.col("relation").alias("raw_relation"), F.col("cleaned").alias("cleaned_relation"), method.alias("method"), similarity.alias("similarity"))


def method_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("method").agg(F.count("*").alias("n"))


def first_by(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
