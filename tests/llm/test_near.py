"""Groups against all pairs on full sets, with small and large groups; signatures; components."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import catalog, near, superminhash
from tessera.operators.components import components

from .colliding import colliding


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((-1 if d is None else d, len(sets[i]), least.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in df.collect())


def family(seed, n):
    """Variants of a few texts, some of them variants of variants."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(1, 60))) for _ in range(4)]
    while len(texts) < n:
        w = rng.choice(texts).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("group_rows", [1000, 7])
def test_groups_equal_all_pairs(spark, group_rows):
    rows = [*family(3, 120), (None, "only null here"), (500, None), (501, ""), (502, " "), (503, "x"), (503, "x"), (503, "other words"), (504, "x")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, band string")
    assert got(near.groups(df, k=2, group_rows=group_rows)) == plain(rows, 2)
    assert near.groups(df.limit(0)).count() == 0
    kept = near.keep_one(df, k=2)
    assert kept.columns == df.columns and kept.filter("doc_id = 504").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_a_single_text_of_few_words(spark, n):
    rows = [(7, " ".join("abcde"[:n]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(near.groups(df, k=5)) == plain(rows, 5)
    assert near.keep_one(df, k=5).collect() == df.collect()


def test_each_row_goes_by_its_own_text(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (None, b), (None, a)], "doc_id long, text string")
    assert sorted(map(str, near.keep_one(df).collect())) == sorted(map(str, df.filter("doc_id is null or doc_id = 3 or text like 'seven%'").collect()))


@pytest.mark.parametrize("repeated", [False, True])
def test_repeats_of_an_id(spark, repeated):
    a = "one two three four five six"
    stay = [(None, "null id seven eight"), (None, "null id seven eight"), (None, None), (None, None), (4, None), (4, None), (4, " "), (6, "nine ten")]
    rows = [*stay, *([(5, a), (5, a), (5, a.replace(" ", "  ")), (5, a.upper())] if repeated else [])]
    kept = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept if r.doc_id != 5) == sorted(map(str, stay))
    assert sum(r.doc_id == 5 for r in kept) == repeated


def test_equal_hashes_are_not_equal_words(spark):
    one, two = colliding()
    rows = [(1, one), (2, two), (3, f"{one} a b c"), (4, f"{two} a b c"), (5, "a\0"), (6, "a"), (7, "nineteen-bytes-long"), (8, "nineteen-bytes-lonG"), (9, "sixteen-bytes-do")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near.groups(docs, k=2)) == plain(rows, 2)
    assert got(near.groups(docs, k=5)) == plain(rows, 5)


def test_pairs_of_hashes_are_told_apart():
    x, y = np.array([5, 7, 9]), np.array([1, 2, 3])
    assert near.Linker([(x, y), (x, y[::-1].copy())], 80).linked(0).tolist() == [0]
    assert near.Linker([(x, y), (x, y)], 80).linked(0).tolist() == [0, 1]


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = catalog.op9_near_duplicates(spark, sf)
    assert got(out) == plain(rows, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_signatures_estimate_and_stop():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    s = superminhash.signatures(np.concatenate([a, b, a[:1], a[::-1]]), np.array([0, 400, 800, 801, 801, 1201]))
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12
    assert (s[0] == s[4]).all() and len(set(s[2].tolist())) == superminhash.REGISTERS
    assert (s[3] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=15))
def test_components(spark, links):
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert out == label
