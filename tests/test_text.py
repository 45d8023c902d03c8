"""Scalar functions on rows chosen for their edges."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions import text as T


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_fixed_values():
    assert len(fixed.RELATION_MAP) == 111 and len(set(fixed.RELATION_MAP.values())) == 33
    assert len(fixed.GENERIC_TERMS) == 22 and len(fixed.MEASUREMENT_TERMS) == 25 and len(fixed.SUSPICIOUS_PHRASES) == 15


@pytest.mark.parametrize("raw, want", [('  "Axon4j," ', "Axon4j"), ("a .", "a "), (None, ""), ("  x  y ", "x y"), ("''", "")])
def test_entity_name(spark, raw, want):
    assert one(spark, T.entity_name, raw) == want


@pytest.mark.parametrize("a, b, want", [("kitten", "sitting", 800 / 13), ("", "", 100.0), ("x", "", 0.0), ("Axon4j", "axon4j", 100.0), ("ab", "ba", 50.0)])
def test_lexical_ratio(spark, a, b, want):
    assert one(spark, T.lexical_ratio, a, b) == pytest.approx(want)


@pytest.mark.parametrize("a, b, want", [("Retrieval-Augmented Generation", "RAG", True), ("rag", "Retrieval Augmented Generation", True), ("Word", "w", False), ("", "", False)])
def test_acronyms(spark, a, b, want):
    assert one(spark, T.acronym_match, a, b) is want


@pytest.mark.parametrize("raw, want", [("Is-A", "is_a"), ("  uses  many things! ", "uses_many_things"), ("", ""), ("__x__", "x")])
def test_clean_relation(spark, raw, want):
    assert one(spark, T.clean_relation, raw) == want


@pytest.mark.parametrize("raw, want", [("uses", True), ("", False), ("the_system_that_was_used", False), ("a_b_c_d_e_f", False), ("x" * 51, False), ("42", False)])
def test_valid_relation(spark, raw, want):
    assert one(spark, T.is_valid_relation, raw) is want


@pytest.mark.parametrize("raw, want", [("", "RELATED_TO"), ("part of", "PART_OF"), (" -x- ", "X"), (None, "RELATED_TO")])
def test_edge_type(spark, raw, want):
    assert one(spark, T.edge_type, raw) == want


def test_tokens_and_overlap(spark):
    assert sorted(one(spark, T.query_tokens, "What is the 5.9 nM limit of X in mode2, mode2?")) == ["5.9", "limit", "mode2", "nm"]
    assert one(spark, lambda a, b: T.overlap(T.query_tokens(a), T.query_tokens(b)), "alpha beta", "beta gamma") == 0.5
    assert one(spark, lambda a, b: T.token_jaccard(a, b), "Graph Store", "graph db") == pytest.approx(1 / 3)
    assert one(spark, lambda a, b: T.token_jaccard(a, b), "", "x") == 0


def test_trimmed_and_stem(spark):
    assert one(spark, lambda c: T.trimmed(c, 5), " abcd efgh ") == "abcd..."
    assert one(spark, lambda c: T.trimmed(c, 5), "abc") == "abc"
    assert one(spark, T.safe_stem, "..my file (1).pdf") == "my_file_1"


def test_aliases(spark):
    got = one(spark, T.alias_pairs, "Natural Language Processing, commonly abbreviated as NLP. Graph Database (GD)")
    assert {(p["long"], p["short"]) for p in got} >= {("natural language processing", "nlp")}
    assert one(spark, T.alias_pairs, "We use Retrieval Augmented Generation (RAG)") == []
