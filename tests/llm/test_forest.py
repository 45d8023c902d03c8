"""Recall and order against brute force; odd vectors."""

import numpy as np
import pytest

from tessera.llm import catalog, forest


def brute(ids, x, q, own, k=10):
    d = np.sqrt(((x - q) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != own]
    return [(int(ids[i]), float(d[i])) for i in order[:k]]


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall(spark, size):
    sf = f"/root/testdata/{size}"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in sorted(catalog.op2_nearest(spark, sf).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    hit = 0
    for own, found in got.items():
        want = brute(ids, x, x[ids == own][0], own)
        assert [r.rank for r in found] == list(range(1, 11)) and [r.score for r in found] == sorted(r.score for r in found)
        for r in found:
            assert r.score == pytest.approx(float(np.linalg.norm(x[ids == r.vec_id][0] - x[ids == own][0])), abs=1e-12)
        hit += len({i for i, _ in want} & {r.vec_id for r in found})
    assert hit >= 0.9 * 10 * len(got)


def test_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(300, None), (301, [0.0, 0.0]), (302, [None, 1.0]), (303, [float("nan"), 1.0]), (304, [float("inf"), 1.0]), (305, [1.0]), (None, [1.0, 1.0]), (400, [0.0, 2.0]), (400, [0.0, 2.0])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    out = forest.nearest(df, df.filter("vec_id % 100 = 0 or vec_id in (301, 305)"), share=1.0).collect()
    by = {q: [(r.rank, r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in out}}
    assert set(by) == {0, 100, 200, 400}
    assert [v for _, v, _ in by[100]] == list(range(10)) and [v for _, v, _ in by[0]] == list(range(1, 11))
    assert {s for _, _, s in by[400]} == {5**0.5}
    assert forest.nearest(df.limit(0), df).count() == 0 and forest.nearest(df, df.limit(0)).count() == 0
    few = forest.nearest(df.filter("vec_id in (1, 2, 400)"), df.filter("vec_id = 1"), share=1.0).collect()
    assert [(r.rank, r.vec_id) for r in few] == [(1, 2), (2, 400), (3, 400)]


def test_repeated_ids_with_other_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 3.0]), (2, [1.0, 0.5]), (3, [0.0, 3.5]), (4, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = forest.nearest(df, df.filter("vec_id = 1"), k=1, share=1.0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out) == [(1, 1, 2, 0.5), (1, 1, 3, 0.5)]


def test_parts_and_blocks_and_work(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(1500, 8)), np.ones((500, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(forest, "QUERY_ROWS", 7)
    monkeypatch.setattr(forest.Forest.deal, "__defaults__", (100,))
    out = forest.nearest(df, df.filter("vec_id % 50 = 0"), share=1.0).collect()
    for own in range(0, 2000, 50):
        assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank) if r.query_id == own] == brute(np.arange(2000), x, x[own], own)
    f = forest.Forest(x[:1500], 1500, leaf_rows=16)
    f.sizes = np.stack([np.bincount(leaf, minlength=f.sizes.shape[1]) for leaf in f.leaves(x[:1500])])
    work = [sum(int(f.sizes[t, leaf]) for t, leaf in f.probes(x[7], share)) for share in (0.05, 0.2, 0.8)]
    assert work[0] < 0.1 * 1500 and work[0] < work[1] < work[2]
