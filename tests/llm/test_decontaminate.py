"""Tiling against a plain version that compares every pair of words in rounds."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import catalog, decontaminate as d

from .colliding import colliding


def words(text):
    return [w.encode() for w in re.findall(r"[^\s!-/:-@\[-`{-~]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""), re.ASCII)]


def plain(item, text, least):
    """Longest common run of unmarked words, again and again."""
    least = min(least, len(item))
    ma, mb, total = set(), set(), 0
    while least:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and a + n not in ma and b + n not in mb:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            break
        ma |= set(range(a, a + n))
        mb |= set(range(b, b + n))
        total += n
    return total / len(item) if item else 0.0


text = st.lists(st.sampled_from("abc"), max_size=24).map(" ".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(text, min_size=1, max_size=4), st.lists(text, min_size=1, max_size=3))
def test_tiles(spark, docs, items):
    got = {
        (r.doc_id, r.item_id): r.coverage
        for r in d.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), min_match=3, threshold=0.4).collect()
    }
    want = {(i, j): c for i, t in enumerate(docs) for j, x in enumerate(items) if (c := plain(words(x), words(t), 3)) >= 0.4}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_reordered_passages_and_odd_rows(spark):
    item = "One two three four five six. Seven eight nine ten eleven twelve."
    rows = [(1, "x y seven EIGHT nine, ten eleven twelve z one two three four five six q", "a"), (2, "one two three four", "b"), (3, None, "c"), (None, item, "d"), (4, "", ""), (5, item * 3000, ""), (5, item * 3000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, coverage string")
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1), (None, "one two", 1)], "item_id long, text string, doc_id long")
    out = d.leaks(df, bench)
    assert {(r.doc_id, r.item_id, round(r.coverage, 2)) for r in out.collect()} == {(1, 7, 1.0), (None, 7, 1.0), (5, 7, 1.0), (1, None, 1.0), (2, None, 1.0), (None, None, 1.0), (5, None, 1.0)}
    assert sorted(str(r.doc_id) for r in d.clean(df, bench).collect()) == ["3", "4", "None"]
    assert d.clean(df, bench).columns == df.columns
    assert d.leaks(df.limit(0), bench).count() == 0 and d.leaks(df, bench.limit(0)).count() == 0
    small = d.leaks(df, bench, block_bytes=10)
    assert sorted(map(str, small.collect())) == sorted(map(str, out.collect()))


def test_each_row_goes_by_its_own_text(spark):
    item = "one two three four five six"
    df = spark.createDataFrame([(1, item), (1, "clean words"), (2, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.text) for r in d.clean(df, bench).collect()] == [(1, "clean words")]


def test_query_against_every_pair(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in catalog.op1_benchmark_leaks(spark, sf).collect()}
    want = set()
    for x in items:
        w = words(x.text)
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for t in docs:
            v = words(t.text)
            if grams & {tuple(v[i : i + 5]) for i in range(len(v) - 4)} and plain(w, v, 5) >= 0.5:
                want.add((t.doc_id, x.item_id))
    assert got == want and got


def test_equal_hashes_are_not_equal_words(spark):
    one, two = colliding()
    bench = spark.createDataFrame([(1, f"{one} b c d e"), (2, f"{two} b c d e")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {one} b c d e y")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()] == [(1, 1)]


def test_seeds_of_equal_hashes_are_dropped():
    import pyarrow as pa

    from tessera.llm.bytesops import MARKS, Texts

    items = d.Items([(1, "a b c d e f")], 5)
    texts = Texts(pa.array(["a b c d e f"]), MARKS)
    words = texts.word_hashes()
    pairs = items.covering(words, texts, 0.5)
    assert items.confirmed(words, texts, pairs) == {(0, 0): [(0, 0, 5), (1, 1, 5)]}
    texts.two[0] += np.uint64(1)
    assert items.confirmed(words, texts, pairs) == {(0, 0): [(1, 1, 5)]}


def test_many_hits_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(d, "HITS", 7)
    import pyarrow as pa

    from tessera.llm.bytesops import MARKS, Texts

    rows = ["a b c d e " * 9, "q " * 40, "a b c d e f g"]
    items = d.Items([(1, "a b c d e a b c d e"), (2, "q q q q q q q"), (3, "f g")], 5)
    texts = Texts(pa.array(rows), MARKS)
    got = items.confirmed(texts.word_hashes(), texts, set(range(9)))
    want = {}
    for i, t in enumerate(rows):
        for j, item in enumerate(["a b c d e a b c d e", "q q q q q q q", "f g"]):
            w, v = words(item), words(t)
            k = min(5, len(w))
            found = [(a, b, k) for a in range(len(w) - k + 1) for b in range(len(v) - k + 1) if w[a : a + k] == v[b : b + k]]
            if found:
                want[i, j] = sorted(found)
    assert {k: sorted(v) for k, v in got.items()} == want
