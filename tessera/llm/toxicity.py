"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of two hashed embeddings, one of the whole word and one of
its first bytes. Filters of several widths slide over the words, each keeps
its largest response anywhere in the text, and a logistic layer turns those
into a score. Texts of any length are read whole: the pooling does not care.

The model is fitted on the driver from a bounded sample of labelled rows
(`MAX_POSITIVE`, `MAX_NEGATIVE`, by hash of the id); a part of them is kept
aside to set a threshold for each language.
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import MARKS, U, Texts
from .common import materialise, slices

#: Bounds of the sample the model is fitted on: rows of each label, and bytes of their texts together.
MAX_POSITIVE, MAX_NEGATIVE = 4000, 6000
MAX_BYTES = 64 << 20
BUCKETS = 1 << 15
WIDTHS = (1, 2, 3)
FILTERS = 8
SIZE = 16
#: Words are also known by this many first bytes.
PREFIX = 5
EPOCHS = 6
MAX_REPEATS = 10
BATCH = 32


def hashed(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Two buckets for each word: of the word, below BUCKETS, and of its prefix, from BUCKETS on."""
    words = texts.word_hashes()
    mask = U(BUCKETS - 1)
    return (words & mask).astype(np.int32), (texts.prefix_hashes(PREFIX) & mask).astype(np.int32) + BUCKETS


def pieces(texts: list[str]) -> Iterator[Texts]:
    """The texts in order, as many at a time as SLICE_BYTES hold."""
    column = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for part in slices(iter([column])):
        yield Texts(part.column(0), MARKS)


class Model:
    """Parameters, training and scoring."""

    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.E = rng.normal(0, 0.1, (2 * BUCKETS, SIZE)).astype(np.float32)
        self.W = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(0)
        self.prior = 0.0

    def compile(self) -> None:
        """Each word's contribution at each place of each filter, so that scoring only looks up and adds."""
        self.tables = [[self.E @ W[j] for j in range(len(W))] for W in self.W]

    def pooled(self, a: np.ndarray, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Largest response of every filter in each text; 0 for texts without words."""
        n = len(bounds) - 1
        out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        filled = np.flatnonzero(np.diff(bounds) > 0)
        if not len(filled):
            return out
        ends = bounds[1:][filled]
        for k, (w, tables) in enumerate(zip(WIDTHS, self.tables)):
            r = tables[0][a] + tables[0][p]
            for j in range(1, w):
                part = tables[j][a] + tables[j][p]
                # a window that would reach into the next text ends where its text ends
                for e in range(j):
                    at = ends - 1 + j - e
                    part[at[at < len(a)]] = 0
                r[: len(a) - j] += part[j:]
            out[filled, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(r, bounds[:-1][filled], axis=0) + self.b[k]
        return np.maximum(out, 0)

    def logits(self, texts: Texts) -> np.ndarray:
        a, p = hashed(texts)
        return (self.pooled(a, p, texts.first) @ self.out + self.bias + self.prior).astype(np.float64)

    def scores(self, texts: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(texts)))

    def step(self, a: np.ndarray, p: np.ndarray, bounds: np.ndarray, y: np.ndarray, state: dict, rate: float) -> float:
        """One AdaGrad step on texts with words; only the windows that won the pooling carry gradients."""
        n, words = len(y), len(a)
        X = self.E[a] + self.E[p]
        owner = np.repeat(np.arange(n), np.diff(bounds))
        kept = []
        features = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for k, w in enumerate(WIDTHS):
            r = X @ self.W[k][0]
            for j in range(1, w):
                part = X[j:] @ self.W[k][j]
                part[owner[j:] != owner[:-j]] = 0
                r[:-j] += part
            top = np.maximum.reduceat(r, bounds[:-1], axis=0)
            at, f = np.nonzero(r == top[owner])
            _, first = np.unique(owner[at].astype(np.int64) * FILTERS + f, return_index=True)
            kept.append((at[first], owner[at[first]], f[first]))
            features[:, k * FILTERS : (k + 1) * FILTERS] = top + self.b[k]
        active = features > 0
        features *= active
        z = features @ self.out + self.bias
        q = 1 / (1 + np.exp(-z))
        d = (q - y) / n
        back = (d[:, None] * self.out) * active
        grads = {"out": features.T @ d, "bias": d.sum()}
        gX: dict[int, list] = {}
        rows, values = [], []
        for k, w in enumerate(WIDTHS):
            at, doc, f = kept[k]
            g = back[doc, k * FILTERS + f]
            grads[f"b{k}"] = np.bincount(f, g, FILTERS).astype(np.float32)
            gW = np.zeros_like(self.W[k])
            for j in range(w):
                inside = at + j < words
                inside[inside] &= owner[at[inside] + j] == doc[inside]
                i, fi, gi = at[inside] + j, f[inside], g[inside]
                np.add.at(gW[j].T, fi, gi[:, None] * X[i])
                rows.append(i)
                values.append(gi[:, None] * self.W[k][j].T[fi])
            grads[f"W{k}"] = gW
        i, v = np.concatenate(rows), np.concatenate(values)
        both = np.concatenate([a[i], p[i]])
        ids, inverse = np.unique(both, return_inverse=True)
        gE = np.zeros((len(ids), SIZE), np.float32)
        np.add.at(gE, inverse, np.concatenate([v, v]))
        seen = state.setdefault("E", np.full(len(self.E), 1e-4, np.float32))
        seen[ids] += (gE**2).mean(1)
        self.E[ids] -= rate * gE / np.sqrt(seen[ids])[:, None]
        for name, g in grads.items():
            s = state[name] = state.get(name, 1e-4) + g * g
            move = rate * g / np.sqrt(s)
            if name == "out":
                self.out -= move.astype(np.float32)
            elif name == "bias":
                self.bias -= np.float32(move)
            elif name[0] == "b":
                self.b[int(name[1:])] -= move
            else:
                self.W[int(name[1:])] -= move
        return float(-np.mean(y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9)))

    def fit(self, texts: list[str], labels: np.ndarray, share: float, seed: int = 4) -> None:
        """Train on the texts; `share` is the share of label 1 among all labelled rows, to which the score is shifted."""
        rng = np.random.default_rng(seed)
        done = [(*hashed(d), d.counts) for d in pieces(texts)]
        a, p, counts = (np.concatenate([x[i] for x in done] or [np.zeros(0, np.int32)]) for i in range(3))
        first = np.concatenate([[0], np.cumsum(counts)]).tolist()
        spans = list(zip(first[:-1], first[1:]))
        usable = np.array([i for i, (x, y) in enumerate(spans) if y > x], np.int64)
        rare = usable[labels[usable] == 1]
        # the rarer label 1 is shown as often as the other, up to MAX_REPEATS times an epoch
        repeats = min(MAX_REPEATS, (len(usable) - len(rare)) // len(rare)) if len(rare) else 1
        usable = np.concatenate([usable, *[rare] * (repeats - 1)])
        state: dict = {}
        for epoch in range(EPOCHS):
            for at in range(0, len(usable), BATCH):
                if not at:
                    order = rng.permutation(usable)
                batch = order[at : at + BATCH]
                cut = [slice(*spans[i]) for i in batch]
                bounds = np.cumsum([0, *(s.stop - s.start for s in cut)])
                self.step(np.concatenate([a[s] for s in cut]), np.concatenate([p[s] for s in cut]), bounds, labels[batch].astype(np.float32), state, 0.1 / (1 + epoch))
        had = float(np.mean(labels[usable])) if len(usable) else 0.5
        clip = lambda x: min(max(x, 1e-3), 1 - 1e-3)
        logit = lambda x: np.log(clip(x) / (1 - clip(x)))
        self.prior = float(logit(share) - logit(had))
        self.compile()


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and binascii.crc32(str(doc_id).encode()) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str) -> tuple[list, float]:
    """A bounded sample of (text, label, lang, fold) of the rows that are not held out, and the share of label 1 among them all.

    Ids with both labels are left out. Of rows that share a labelled id the
    one of least text stands for it. Ids are taken by hash, up to MAX_POSITIVE
    and MAX_NEGATIVE, and of these, whole, as long as their texts together
    stay below MAX_BYTES.
    """
    # a key with no language column of its own still works
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    marked = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and label_id is not null").groupBy("label_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter((F.col("y") == F.col("top")) & (fold(F.col("label_id")) != 0))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    lot = F.xxhash64("label_id").alias("lot")
    chosen = None
    for y, most in ((0, MAX_NEGATIVE), (1, MAX_POSITIVE)):
        part = marked.filter(F.col("y") == y).select("label_id", "y", lot).orderBy("lot", "label_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), lang.alias("lang"))
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).groupBy("label_id", "y", "lot").agg(F.min(F.struct("text", "lang")).alias("r"))
    found = materialise(found.select("label_id", "y", "lot", "r.*"))
    sizes = found.select("label_id", "lot", F.octet_length("text").alias("n")).orderBy("lot", "label_id").collect()
    inside = np.cumsum([r["n"] for r in sizes]) <= MAX_BYTES
    if not inside.all():
        found = found.join(F.broadcast(found.sparkSession.createDataFrame([(r["label_id"],) for r, ok in zip(sizes, inside) if ok], found.select("label_id").schema)), "label_id", "left_semi")
    rows = found.select("label_id", "text", "y", "lang", fold(F.col("label_id")).alias("fold")).orderBy("label_id").collect()
    return rows, counts.get(1, 0) / max(1, sum(counts.values()))


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold of the best F1; among equals the middle between the scores next to it. 0.5 without both labels."""
    if len(set(labels.tolist())) < 2:
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    tp = np.cumsum(y)
    f1 = 2 * tp / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[Model, dict[str | None, float]]:
    """The model, and a threshold for each language from a fold that it was not fitted on; that fold also sets what score 0.5 means. Without labelled rows all scores are alike."""
    rows, share = sample(docs, labels, label)
    fit = [r for r in rows if r["fold"] != 1] or rows
    model = Model()
    model.fit([r["text"] for r in fit], np.array([r["y"] for r in fit], np.int64), share)
    aside = [r for r in rows if r["fold"] == 1]
    thresholds: dict[str | None, float] = {}
    if len({r["y"] for r in aside}) == 2:
        texts = [r["text"] for r in aside]
        s = np.concatenate([model.scores(d) for d in pieces(texts)])
        y = np.array([r["y"] for r in aside])
        # the scores are shifted so that 0.5 is the best line for all languages together
        line = min(max(best_threshold(s, y), 1e-6), 1 - 1e-6)
        model.prior -= float(np.log(line / (1 - line)))
        s = np.concatenate([model.scores(d) for d in pieces(texts)])
        for lang in {r["lang"] for r in aside}:
            of = np.array([r["lang"] == lang for r in aside])
            thresholds[lang] = best_threshold(s[of], y[of])
    return model, thresholds


def score(docs: DataFrame, model: Model, thresholds: dict[str | None, float]) -> DataFrame:
    """doc_id, score, flagged (score at or above the threshold of the row's language; 0.5 for others).

    Other columns are ignored. Null and empty texts have the score of a text
    without words; every row is scored by itself, whatever its id.
    """
    has_lang = "lang" in docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            s = m.scores(Texts(b.column(1), MARKS))
            line = np.array([thresholds.get(x, 0.5) for x in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(s >= line)], names=["doc_id", "score", "flagged"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), (F.col("lang") if has_lang else F.lit(None)).cast("string").alias("lang"))
    return rows.mapInArrow(run, "doc_id long, score double, flagged boolean")
