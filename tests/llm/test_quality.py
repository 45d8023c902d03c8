"""The sharded model against a plain one in dictionaries; odd rows."""

import binascii
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import catalog, quality
from tessera.llm.common import materialise


class Plain:
    """Interpolated modified Kneser-Ney over bytes, by its definition."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {}
        top = Counter()
        for t in texts:
            b = b"\0" * (order - 1) + t.encode()
            top.update(b[i : i + order] for i in range(len(b) - order + 1))
        self.counts[order] = top
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.total, self.left = {}, defaultdict(float), defaultdict(float)
        for k, c in self.counts.items():
            n = Counter(c.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
            self.d[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i * 0.5, 0.1 * i), 0.95 * i) for i in (1, 2, 3)]
            for g, v in c.items():
                self.total[g[:-1]] += v
                self.left[g[:-1]] += self.d[k][min(v, 3) - 1]

    def p(self, g):
        if not g:
            return 1 / 256
        low, h = self.p(g[1:]), g[:-1]
        if h not in self.total:
            return low
        v = self.counts[len(g)][g]
        return (max(v - self.d[len(g)][min(v, 3) - 1], 0) * (v > 0) + self.left[h] * low) / self.total[h]

    def perplexity(self, text):
        b = b"\0" * (self.order - 1) + text.encode()
        n = len(text.encode())
        return math.exp(-sum(math.log(self.p(b[i : i + self.order])) for i in range(n)) / n)


def aside(doc_id):
    return binascii.crc32(f"aside|{doc_id}".encode()) % quality.FOLDS == 0


def lines(rows, ppl, trusted):
    """The threshold of each language: the quantile of the fold kept aside, or of all trusted texts if that is larger."""
    at = lambda v: v[min(len(v) - 1, int(-(-quality.QUANTILE * len(v) // 1)) - 1)]
    out = {}
    for lang in {r.lang for r in rows}:
        own = [r.doc_id for r in rows if r.lang == lang and r.doc_id in trusted and r.text]
        sets = [sorted(ppl[i] for i in own if aside(i)), sorted(ppl[i] for i in own)]
        if own:
            out[lang] = quality.MARGIN * max(at(v) for v in sets if v)
    return out


def test_perplexities_equal_the_plain_model(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}
    plain = Plain([r.text for i, r in rows.items() if i in trusted and not aside(i)], quality.ORDER)
    out = catalog.op6_perplexity(spark, sf).collect()
    assert len(out) == len(rows)
    ppl = {i: plain.perplexity(r.text) for i, r in rows.items() if r.text}
    line = lines(rows.values(), ppl, trusted)
    for r in out:
        assert r.perplexity == pytest.approx(ppl[r.doc_id], rel=1e-9)
        assert r.kept == (r.perplexity <= r.threshold) and r.threshold == pytest.approx(line.get(r.lang, max(line.values())), rel=1e-9)
    got = {r.doc_id: r.kept for r in out}
    bad = {r.doc_id for r in labels.collect() if r.quality == 0}
    assert sum(got[i] for i in trusted) >= 0.99 * len(trusted) and sum(got[i] for i in bad) <= 0.4 * len(bad)
    p = plain.counts[quality.ORDER]
    for h in list({g[:-1] for g in p})[:20]:
        assert sum(plain.p(h + bytes([i])) for i in range(256)) == pytest.approx(1)


def test_odd_rows(spark):
    rows = [(1, "good text here " * 20, "en"), (2, None, "en"), (3, "", None), (None, "good text", "xx"), (4, "€@@##" * 9000, "en"), (4, "€@@##" * 9000, "en"), (5, "good text here", None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, perplexity double")
    labels = spark.createDataFrame([(1, 1), (None, 1), (9, 1), (4, 0), (5, None)], "doc_id long, quality int")
    out = quality.judge(docs, labels)
    assert sorted((r.doc_id or 0, r.kept) for r in out.collect()) == [(0, False), (1, True), (2, True), (3, True), (4, False), (4, False), (5, False)]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3}
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).filter(~F.col("kept")).count() == 0


def test_each_row_goes_by_its_own_text(spark):
    good, bad = "good text here " * 20, "€@@##" * 9000
    rows = [(1, good, "en"), (None, good, "en"), (None, bad, "en"), (None, None, "en"), (2, good, "en"), (2, bad, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.filter(docs["text"].isNull() | (docs["text"] == good)).collect()))
    # a generator repeats a row with its place
    ids = materialise(spark.createDataFrame([(1,), (2,)], "doc_id long"))
    both = ids.select("doc_id", F.explode(F.when(F.col("doc_id") == 1, F.array(F.lit(good))).otherwise(F.array(F.lit(good), F.lit(bad)))).alias("text"), F.lit("en").alias("lang"))
    assert sorted((r.doc_id, r.text) for r in quality.keep_good(both, labels).collect()) == [(1, good), (2, good)]


def test_rows_of_one_id_and_length_in_two_languages(spark):
    rows = [(1, "good text here " * 20, "en"), (2, "ab", "en"), (2, "cd", "de"), (None, "ef", "fr"), (None, "gh", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality.judge(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert sorted(str((r.doc_id, r.lang, r.n_bytes)) for r in out.collect()) == sorted(str((i, g, len(t))) for i, t, g in rows)
