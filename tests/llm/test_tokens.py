"""Prefix counts against the tokenizers library."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import catalog, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "<|endoftext|>a <|startoftext|> B", "<|endoftext", "<|ENDOFTEXT|>", "ΑΣ ΣΑΣ İstanbul ǅ", "it's I'LL DON'T 123 ½ ²", "ͅ é  x", "日本語のテキスト 🎉🎉", "!!!!!!???...***%%%", "a" * 300, "\x1c\x85 z", "ﬁ Ǆ", "Â\U0003d000", "a\x00b\x7f"]


@pytest.fixture(scope="module")
def counter():
    return tokens.counter(PATH)


def library(counter, texts):
    return [len(e.ids) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(counter, text):
    assert counter.total(text) == library(counter, [text])[0]


def test_every_prefix_of_words(counter):
    for w in ["thnterti", "antidisestablishmentarianism", "aaaaaaaaa", "....!!!..", "reationsthat"]:
        assert counter.word(w) == library(counter, [w[:i] for i in range(1, len(w) + 1)])


def test_budget_is_answered_from_the_prefixes(spark, counter):
    text = "Unbelievable antidisestablishmentarianism of the " * 40
    out = tokens.count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, 50, prefixes=True).first()
    chunks = text.split()
    assert list(out.prefix_counts) == [counter.total(" ".join(chunks[: i + 1])) for i in range(len(chunks))]
    assert out.chunks_within == sum(n <= 50 for n in out.prefix_counts) and out.over_limit


def test_documents_and_odd_rows(spark, sf, counter):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in catalog.op3_token_counts(spark, sf).collect()}
    assert [got[d.doc_id].n_tokens for d in docs] == library(counter, [d.text for d in docs])
    assert [got[d.doc_id].n_bytes for d in docs] == [len(d.text.encode()) for d in docs]
    rows = [(i, t, 7) for i, t in enumerate(ODD)] + [(None, None, 7), (0, "", 7)]
    out = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    assert sorted(r.n_tokens for r in out) == sorted(library(counter, [t or "" for _, t, _ in rows]))
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
