"""Hybrid retrieval: seeds by similarity and by words, path ranking, greedy selection, one search over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .graph import path_score, path_text, paths
from .plugins import embed_string, hashed_embedding
from .vectors import dot, expand_neighbours, top_k


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def question_tokens(question: str) -> list[str]:
    import re

    return list(dict.fromkeys(t for t in re.findall(r"[a-z0-9]+(?:\.[a-z0-9]+)?", question.lower()) if len(t) > 1 and t not in fixed.STOPWORDS))


def lexical_entities(nodes: DataFrame, tokens: list[str], limit: int = fixed.LEXICAL_ENTITIES) -> DataFrame:
    """Nodes whose lower-case name holds a token anywhere; the first `limit` by name."""
    return nodes.filter(F.exists(_words(tokens), lambda t: F.contains(F.lower("name"), t))).select("name", "source_file").distinct().orderBy("name", "source_file").limit(limit)


def semantic_seeds(hits: DataFrame, k: int = fixed.SEEDS_EACH) -> DataFrame:
    """Of entity hits (name, source_file, score): no blank or metadata names, the k best."""
    return hits.filter((T.strip(F.coalesce("name", F.lit(""))) != "") & ~T.is_metadata_name(F.col("name"))).orderBy(F.desc("score"), "name").limit(k)


def lexical_seeds(entities: DataFrame, semantic: DataFrame, tokens: list[str], k: int = fixed.SEEDS_EACH) -> DataFrame:
    """Of entities not among the semantic seeds: share of the question's words, 0.05 more for values; the k best."""
    rest = entities.join(semantic.select("name"), "name", "left_anti").filter(~T.is_metadata_name(F.col("name")))
    share = T.share_of(tokens, F.col("name"))
    scored = rest.withColumn("lexical_score", share).filter("lexical_score > 0").withColumn("score", F.col("lexical_score") + F.when(T.is_value_name(F.col("name")), 0.05).otherwise(0.0))
    return scored.orderBy(F.desc("score"), "name").limit(k)


def hybrid_seeds(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """Semantic seeds, then lexical ones; a name once."""
    a = semantic.select("name", "source_file", "score", F.col("score").alias("semantic_score"), F.lit(0.0).alias("lexical_score"), F.lit(True).alias("from_vector"), F.lit(False).alias("from_lexical"))
    b = lexical.select("name", "source_file", "score", F.lit(0.0).alias("semantic_score"), "lexical_score", F.lit(False).alias("from_vector"), F.lit(True).alias("from_lexical"))
    w = Window.partitionBy("name").orderBy(F.desc("from_vector"), F.desc("score"), "source_file")
    return a.unionByName(b).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def rank_paths(found: DataFrame, seeds: DataFrame, question: str, k: int, places: int = 6) -> DataFrame:
    """Paths with text, similarity and score (to `places` places), coverage of the question, direct_fact: the best max(8 k, 40), ties to the smaller text. The seeds are at most twelve rows."""
    names = [r["name"] for r in seeds.select("name").distinct().orderBy("name").collect()]
    tokens, q = question_tokens(question), F.array(*[F.lit(x) for x in embed_string(question)])
    rows = found.withColumn("text", path_text(F.col("entities"), F.col("relationships"))).filter(T.strip(F.col("text")) != "")
    rows = rows.withColumn("semantic_score", F.round(dot(hashed_embedding(F.col("text")), q), places)).withColumn("tokens", T.query_tokens(F.col("text")))
    rows = rows.withColumn("query_coverage", T.overlap(_words(tokens), F.col("tokens")))
    hits = F.size(F.array_intersect("entities", _words(names)))
    rows = rows.withColumn("score", F.round(path_score(F.col("semantic_score"), F.col("entities"), F.col("relationships"), hits, F.col("query_coverage")), places))
    return rows.withColumn("direct_fact", F.size("relationships") == 1).orderBy(F.desc("score"), "text").limit(max(fixed.RERANK_FACTOR * k, fixed.RERANK_LEAST))


SELECTED = "question string, rank int, entities array<string>, relationships array<string>, text string, score double, semantic_score double, query_coverage double, direct_fact boolean, selection_score double, new_query_tokens array<string>"


def select_greedily(ranked: DataFrame, question: str, k: int) -> DataFrame:
    """k paths one after another: score, 0.06 for each new question word up to 0.18, 0.08 for a value if the question asks for one, less 0.07 where four fifths of the entities were chosen already. The ranked rows are at most max(8 k, 40)."""
    tokens = set(question_tokens(question))
    measures = bool(tokens & set(fixed.MEASUREMENT_TERMS))
    rows = ranked.withColumn("question", F.lit(question)).withColumn("has_value", F.exists("entities", T.is_value_name)).select("question", "entities", "relationships", "text", "tokens", "score", "semantic_score", "query_coverage", "direct_fact", "has_value")

    def run(pdf):
        import pandas as pd

        left = sorted(pdf.to_dict("records"), key=lambda r: (-r["score"], r["text"]))
        covered: set[str] = set()
        chosen: list[dict] = []
        while left and len(chosen) < k:
            best, best_score = None, float("-inf")
            for r in left:
                new = (set(r["tokens"]) & tokens) - covered
                own = set(r["entities"])
                again = any(len(own & set(c["entities"])) / len(own | set(c["entities"])) >= 0.80 for c in chosen)
                s = r["score"] + min(0.06 * len(new), 0.18) + 0.08 * (measures and r["has_value"]) - 0.07 * again
                # a difference in the last digits of a sum is a tie
                if s > best_score + 1e-9:
                    best, best_score, best_new = r, s, new
            left.pop(next(i for i, r in enumerate(left) if r is best))
            covered |= set(best["tokens"]) & tokens
            chosen.append(best | {"rank": len(chosen) + 1, "selection_score": best_score, "new_query_tokens": sorted(best_new)})
        columns = [c.split(" ")[0] for c in SELECTED.split(", ")]
        return pd.DataFrame([{c: r[c] for c in columns} for r in chosen], columns=columns)

    return rows.groupBy("question").applyInPandas(run, SELECTED)


def graph_search(nodes: DataFrame, edges: DataFrame, question: str, k: int = 8, entity_k: int = fixed.VECTOR_ENTITIES) -> dict[str, DataFrame]:
    """seeds, ranked and graph_paths of a question; nodes need name, source_file, embedding. Without seeds the paths are empty."""
    tokens = question_tokens(question)
    hits = top_k(nodes, embed_string(question), entity_k, key="name")
    semantic = semantic_seeds(hits)
    lexical = lexical_seeds(lexical_entities(nodes, tokens), semantic, tokens)
    seeds = hybrid_seeds(semantic, lexical)
    ranked = rank_paths(paths(edges, seeds), seeds, question, k)
    return {"entities": seeds, "ranked": ranked, "graph_paths": select_greedily(ranked, question, k)}


def retrieve(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, question: str, top: int = fixed.TOP_CHUNKS, k: int = 8) -> dict[str, DataFrame]:
    """Chunk hits, their neighbours, and the graph's paths; chunks need source_file, chunk_id, text, embedding, chunk_key. A blank question is an error."""
    if not question or not question.strip():
        raise ValueError("question must not be blank")
    hits = top_k(chunks, embed_string(question), top, key="chunk_key").select("source_file", "chunk_id", "text", "score")
    return {"vector_results": hits, "expanded": expand_neighbours(hits, chunks)} | graph_search(nodes, edges, question, k)
