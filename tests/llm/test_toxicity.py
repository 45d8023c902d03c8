"""Held-out accuracy, the table form of the filters against plain convolutions, gradients, odd rows."""

import numpy as np
import pyarrow as pa

from tessera.llm import catalog, toxicity as t
from tessera.llm.bytesops import MARKS, Texts


def plain(m, a, p):
    X = m.E[a] + m.E[p]
    out = []
    for W, b in zip(m.W, m.b):
        r = [sum(X[i + j] @ W[j] for j in range(len(W)) if i + j < len(X)) for i in range(len(X))]
        out.append(np.maximum(np.max(r, axis=0) + b, 0) if r else np.zeros(t.FILTERS))
    return 1 / (1 + np.exp(-(np.concatenate(out) @ m.out + m.bias + m.prior)))


def test_tables_equal_plain_convolutions():
    m = t.Model(1)
    m.b = [np.linspace(-0.1, 0.2, t.FILTERS, dtype=np.float32) for _ in m.b]
    m.compile()
    texts = ["one", "", "two words", "a b c d e", " ", "x " * 50, "last"]
    d = Texts(pa.array(texts), MARKS)
    a, p = t.hashed(d)
    got = m.scores(d)
    for i in range(len(texts)):
        s = slice(d.first[i], d.first[i + 1])
        assert abs(got[i] - plain(m, a[s], p[s])) < 1e-5


def test_learns_and_repeats():
    texts = [f"some words {i} here and {'vile' if i % 4 == 0 else 'fine'} things" for i in range(200)]
    y = np.array([i % 4 == 0 for i in range(200)]).astype(int)
    models = [t.Model(), t.Model()]
    for m in models:
        m.fit(texts, y, 0.25)
    s = [m.scores(Texts(pa.array(["a vile one", "a fine one"]), MARKS)) for m in models]
    assert s[0][0] > 0.5 > s[0][1] and (s[0] == s[1]).all()


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in catalog.op4_toxicity(spark, sf).collect()]
    assert all(r.held_out == t.held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    tp = sum(p and y for p, y in held)
    assert tp / sum(y for _, y in held) > 0.8 and tp / sum(p for p, _ in held) > 0.9


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 1), (9, 0)], "doc_id long, toxic int")
    rows = [(1, "bad", "en", 1.0), (2, None, None, 1.0), (None, "x", "xx", 1.0), (4, "", "en", 1.0), (4, "word " * 50000, "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    assert t.score(docs, *t.train(docs, labels)).count() == 5
    assert t.score(docs.drop("lang"), *t.train(docs.drop("lang"), labels.limit(0))).count() == 5
    assert t.score(docs.limit(0), *t.train(docs.limit(0), labels)).count() == 0


def test_steps_follow_the_gradient_of_the_loss():
    """AdaGrad's first step moves a parameter by rate x g / sqrt(start + g^2), which gives g; it must be the slope of the loss of the plain net."""
    rng = np.random.default_rng(3)
    m = t.Model(5)
    m.E = rng.normal(0, 0.5, m.E.shape).astype(np.float32)
    m.b = [rng.normal(0.2, 0.1, t.FILTERS).astype(np.float32) for _ in m.b]
    texts, y = ["one two three", "four five", "six one seven eight"], np.array([1.0, 0.0, 1.0], np.float32)
    d = Texts(pa.array(texts), MARKS)
    a, p = t.hashed(d)
    spans = [slice(d.first[i], d.first[i + 1]) for i in range(3)]

    def loss(net):
        q = np.array([plain(net, a[s], p[s]) for s in spans], float)
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    before = {"out": m.out.copy(), "b1": m.b[1].copy(), "W2": m.W[2].copy()}

    def copy_of(net):
        out = t.Model(5)
        out.E, out.W, out.b, out.out = net.E.copy(), [w.copy() for w in net.W], [b.copy() for b in net.b], net.out.copy()
        return out

    fresh = copy_of(m)
    embedding = m.E[a[0]].copy()
    m.step(a, p, d.first, y, {}, 0.1)

    def slope(change):
        high, low = copy_of(fresh), copy_of(fresh)
        change(high, 1e-3)
        change(low, -1e-3)
        return (loss(high) - loss(low)) / 2e-3

    def implied(old, new):
        move = np.clip((np.asarray(old, float) - new) / 0.1, -0.999999, 0.999999)
        return 0.01 * move / np.sqrt(1 - move**2)

    for k in (0, 5, 13):
        assert abs(implied(before["out"][k], m.out[k]) - slope(lambda n, e: n.out.__setitem__(k, n.out[k] + e))) < 0.02
    for k in (1, 6):
        assert abs(implied(before["b1"][k], m.b[1][k]) - slope(lambda n, e: n.b[1].__setitem__(k, n.b[1][k] + e))) < 0.02
    for at in ((0, 3, 2), (2, 7, 5)):
        assert abs(implied(before["W2"][at], m.W[2][at]) - slope(lambda n, e: n.W[2].__setitem__(at, n.W[2][at] + e))) < 0.02
    # the row of an embedding shares one scale: its moves point along the gradient
    g = np.array([slope(lambda n, e, c=c: n.E.__setitem__((a[0], c), n.E[a[0], c] + e)) for c in range(t.SIZE)])
    moved = embedding.astype(float) - m.E[a[0]]
    assert np.dot(g, moved) / (np.linalg.norm(g) * np.linalg.norm(moved) + 1e-12) > 0.98


def test_sample_is_bounded_and_consistent(spark, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(7, 0), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "w" * 100) for i in range(40)] + [(6, "a"), (6, "z")], "doc_id long, text string")
    rows, _ = t.sample(docs, labels, "toxic")
    assert [r.label_id for r in rows] == [i for i in range(40) if not t.held_out(i) and i != 7]
    assert {r.label_id: r.text for r in rows}.get(6, "a") == "a"
    monkeypatch.setattr(t, "MAX_BYTES", 1000)
    few, _ = t.sample(docs, labels, "toxic")
    assert 8 <= len(few) <= 11 and {r.text for r in few} <= {"w" * 100, "a"}
