"""Evidence blocks, the answer's state machine and the graph payload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


#: What a generator, a validator and a corrector are asked; formatted with question, context and draft.
PROMPTS = {
    "generate": "Answer the question from the evidence alone. If the evidence doesn't answer it, say that there is insufficient evidence.\n\nEvidence:\n{context}\n\nQuestion: {question}\nAnswer:",
    "validate": "Does the evidence bear out the answer? Reply SUPPORTED, UNSUPPORTED or NEEDS_CORRECTION.\n\nEvidence:\n{context}\n\nQuestion: {question}\nAnswer: {draft}\nVerdict:",
    "correct": "Write the answer anew so that the evidence bears it out.\n\nEvidence:\n{context}\n\nQuestion: {question}\nAnswer: {draft}\nNew answer:",
}


def prompt(kind: str, question: str, context: str, draft: str = "") -> str:
    """The text to send to a model, for kind generate, validate or correct."""
    return PROMPTS[kind].format(question=question, context=context, draft=draft)


def vector_context(hits: DataFrame, expanded: bool = True) -> DataFrame:
    """(index, block) of chunk evidence, numbered by (source_file, chunk_id); neighbours get less room. The plain variant cuts hard, drops blank texts and keeps their numbers."""
    rows = hits.withColumn("index", F.row_number().over(Window.orderBy("source_file", "chunk_id")))
    if not expanded:
        rows = rows.filter(T.strip(F.coalesce("text", F.lit(""))) != "")
        text: Column = F.substring(T.strip(F.col("text")), 1, fixed.PLAIN_CONTEXT_LIMIT)
        neighbour: Column = F.lit(False)
    else:
        neighbour = F.col("is_neighbor")
        text = F.when(neighbour, T.trimmed(F.col("text"), fixed.NEIGHBOUR_LIMIT)).otherwise(T.trimmed(F.col("text"), fixed.CONTEXT_LIMIT))
    block = F.concat_ws("\n",
        F.concat(F.lit("VECTOR EVIDENCE "), F.col("index")),
        F.concat(F.lit("chunk_id: "), F.col("chunk_id")),
        F.concat(F.lit("source_file: "), F.col("source_file")),
        F.concat(F.lit("score: "), F.format_string("%.4f", F.col("score").cast("double"))),
        F.concat(F.lit("is_neighbor: "), F.initcap(neighbour.cast("string"))),
        F.lit("text:"),
        text,
    )
    return rows.select("index", block.alias("block"))


def graph_context(paths: DataFrame) -> DataFrame:
    """(index, block) of path evidence; paths need rank, score, semantic_score and text."""
    block = F.concat_ws("\n", F.concat(F.lit("GRAPH PATH "), F.col("rank")), F.concat(F.lit("score: "), F.format_string("%.4f", "score")), F.concat(F.lit("semantic_score: "), F.format_string("%.4f", "semantic_score")), F.concat(F.lit("path: "), T.trimmed(F.col("text"), fixed.GRAPH_LIMIT)))
    return paths.select(F.col("rank").alias("index"), block.alias("block"))


def joined(blocks: DataFrame, none: str) -> DataFrame:
    """One row, context: the blocks with a blank line between them. Only for the few blocks of one question."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "block")))
    text = F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n")
    return blocks.agg(F.when(F.count("*") > 0, text).otherwise(none).alias("context"))


def evidence(hits: DataFrame) -> DataFrame:
    """Evidence rows of an answer: trimmed text, without is_neighbor."""
    return hits.select("source_file", "chunk_id", "score", T.trimmed(F.col("text"), fixed.EVIDENCE_LIMIT).alias("text"))


def payload(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id) and links (source, target, relation, score) of ranked paths (rank, entities, relationships, score): blank entities go first, a link keeps its first path's score."""
    clean = paths.withColumn("entities", F.filter("entities", lambda e: e.isNotNull() & (T.strip(e) != "")))
    names = clean.select(F.explode("entities").alias("id")).distinct()
    n = F.least(F.size("entities") - 1, F.size("relationships"))
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.get("entities", i).alias("source"), F.get("entities", i + 1).alias("target"), F.get("relationships", i).alias("relation")))
    rows = clean.filter(n > 0).select("rank", "score", F.explode(steps).alias("s")).select("rank", "score", "s.*")
    links = rows.groupBy("source", "target", "relation").agg(F.min_by("score", F.struct("rank", "i")).alias("score"))
    return names, links


def answer(question: str, context: str, generate: Callable[[str, str], str], validate: Callable[[str, str, str], str], correct: Callable[[str, str, str], str], keep_draft: bool = True) -> dict:
    """Draft; if it says that nothing was found, a verdict on it; a correction unless the verdict is SUPPORTED. A blank correction leaves the draft where keep_draft is set."""
    draft = generate(question, context)
    low = (draft or "").lower()
    if not any(p in low for p in (fixed.SUSPICIOUS_PHRASES if keep_draft else fixed.SUSPICIOUS_PHRASES[:-1])):
        return {"question": question, "answer": draft, "draft_answer": draft, "validation_status": "NOT_RUN"}
    reply = (validate(question, context, draft) or "").upper()
    status = next((s for s in ("NEEDS_CORRECTION", "UNSUPPORTED", "SUPPORTED") if s in reply), "NEEDS_CORRECTION")
    final = draft
    if status != "SUPPORTED":
        new = correct(question, context, draft)
        final = new if (new or "").strip() or not keep_draft else draft
    return {"question": question, "answer": final, "draft_answer": draft, "validation_status": status}
