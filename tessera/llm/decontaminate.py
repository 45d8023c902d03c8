"""Benchmark decontamination by greedy string tiling.

Texts are words: runs of bytes other than white space and ASCII marks, A-Z
lower-cased. Documents and benchmark items that share a seed (a run of
`min_match` words, found by its Karp-Rabin hash) are tiled: of all common runs
of unmarked words the longest is marked first in both texts, then the next,
until none of `min_match` words is left. Hashes only find seeds; the words of
both texts are compared before a seed counts. An item whose marked share reaches
`threshold` is leaked into the document, whatever the order of its passages.

An item of fewer words than `min_match` is looked for whole.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import MARKS, U, Texts, mix
from .common import PLACE, placed, slices, without

MIN_MATCH = 5
THRESHOLD = 0.5
#: Items are held by every task while their text is below this; more are taken in blocks of this size, one pass over the documents each.
BLOCK_BYTES = 16 << 20
#: Shared seeds in hand at a time.
HITS = 1 << 20
SCHEMA = "doc_id long, item_id long, coverage double, item_words int, tiles array<struct<item_word:int,doc_word:int,words:int>>"
_W = 0xD1342543DE82EF95


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of k consecutive words, for every start that has k words after it in the array."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.zeros(n, U)
    for j in range(k):
        h += words[j : j + n] * U(pow(_W, j + 1, 1 << 64))
    return mix(h)


class Items:
    """Benchmark items and their seeds in hash order, as arrays."""

    def __init__(self, rows: list[tuple[int, str]], min_match: int):
        texts = Texts(pa.array([t for _, t in rows], pa.string()), MARKS)
        words = texts.word_hashes()
        self.ids = [i for i, _ in rows]
        self.first, self.counts = texts.first, texts.counts
        self.halves = texts.one, texts.two
        self.min_match = min_match
        #: By run length: hashes in ascending order, and the item and word of each.
        self.seeds = {}
        least = np.minimum(self.counts, min_match)
        owner = texts.owners()
        for k in sorted(set(least[least > 0].tolist())):
            h = run_hashes(words, k)
            at = np.arange(len(h))
            at = at[(least[owner[at]] == k) & (at + k <= self.first[1:][owner[at]])]
            order = at[np.lexsort((at, h[at]))]
            self.seeds[k] = (h[order], owner[order].astype(np.int32), (order - self.first[owner[order]]).astype(np.int32))

    def hits(self, words: np.ndarray, texts: Texts) -> Iterator[np.ndarray]:
        """Shared seeds in stretches of about HITS: rows of text, item, word of the item, word of the text, length."""
        for k, (keys, items, ats) in self.seeds.items():
            h = run_hashes(words, k)
            low = np.searchsorted(keys, h)
            found = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == h)
            owner = np.searchsorted(texts.first, found, side="right") - 1
            inside = found + k <= texts.first[1:][owner]
            found, owner = found[inside], owner[inside]
            low = low[found]
            count = np.searchsorted(keys, h[found], side="right") - low
            for part in np.split(np.arange(len(found)), np.flatnonzero(np.diff(np.cumsum(count) // HITS)) + 1):
                n = count[part]
                which = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                place = np.repeat(found[part] - texts.first[owner[part]], n)
                yield np.stack([np.repeat(owner[part], n), items[which], ats[which], place, np.full(len(which), k)])

    def covering(self, words: np.ndarray, texts: Texts, threshold: float) -> set[int]:
        """Pairs (text x number of items + item) whose seeds cover so many words of the item that they can reach the threshold."""
        seen = [np.unique(np.stack([h[0] * len(self.ids) + h[1], h[2], h[4]]), axis=1) for h in self.hits(words, texts) if h.size]
        if not seen:
            return set()
        pair, at, k = np.unique(np.concatenate(seen, axis=1), axis=1)
        out = set()
        edges = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        for a, z in zip(edges, [*edges[1:], len(pair)]):
            # places ascend; of two seeds that overlap the words count once
            ends = np.maximum.accumulate(at[a:z] + k[a:z])
            covered = int((ends - np.maximum(at[a:z], np.concatenate([[0], ends[:-1]]))).clip(0).sum())
            if covered >= threshold * self.counts[pair[a] % len(self.ids)]:
                out.add(int(pair[a]))
        return out

    def confirmed(self, words: np.ndarray, texts: Texts, pairs: set[int]) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
        """(text, item) -> [(word of the item, word of the text, length)] of the seeds of these pairs whose words are the same, and not only their hashes."""
        wanted = np.array(sorted(pairs), np.int64)
        out: dict = defaultdict(list)
        for h in self.hits(words, texts):
            pair = h[0] * len(self.ids) + h[1]
            h = h[:, wanted[np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)] == pair]
            if not h.size:
                continue
            same = np.ones(h.shape[1], bool)
            for j in range(int(h[4, 0])):
                a, b = self.first[h[1]] + h[2] + j, texts.first[h[0]] + h[3] + j
                for x, y in zip(self.halves, (texts.one, texts.two)):
                    same &= x[a] == y[b]
            for doc, item, at, place, k in h[:, same].T.tolist():
                out[doc, item].append((at, place, k))
        return out


def runs(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Maximal common runs (item word, text word, words): seeds that follow each other on one diagonal."""
    by_diagonal = defaultdict(list)
    for a, b, k in hits:
        by_diagonal[b - a].append((a, k))
    out = []
    for d, found in by_diagonal.items():
        found.sort()
        begin, last, k = found[0][0], found[0][0], found[0][1]
        for a, _ in found[1:]:
            if a > last + 1:
                out.append((begin, begin + d, last + k - begin))
                begin = a
            last = a
        out.append((begin, begin + d, last + k - begin))
    return out


def tile(matches: list[tuple[int, int, int]], n_item: int, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles from maximal runs: the longest first; ties to the smaller item word, then text word. A run that marked words cut is taken up again by its longest free parts."""
    least = min(min_match, n_item)
    heap = [(-n, a, b) for a, b, n in matches if n >= least]
    heapq.heapify(heap)
    item_marked = bytearray(n_item)
    text_marked: set[int] = set()
    tiles = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [not item_marked[a + i] and b + i not in text_marked for i in range(n)]
        if all(free):
            tiles.append((a, b, n))
            for i in range(n):
                item_marked[a + i] = 1
                text_marked.add(b + i)
            continue
        begin = None
        for i, ok in enumerate([*free, False]):
            if ok and begin is None:
                begin = i
            elif not ok and begin is not None:
                if i - begin >= least:
                    heapq.heappush(heap, (begin - i, a + begin, b + begin))
                begin = None
    return tiles


def _scan(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    """Leaks of one block of items: seeds are looked up for a whole slice of documents at once. Columns of docs after doc_id and text (long) come last."""
    also = docs.columns[2:]
    tiles_type = pa.list_(pa.struct([("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for b in slices(batches):
            texts = Texts(b.column(1), MARKS)
            words = texts.word_hashes()
            rows = []
            pairs = held.covering(words, texts, threshold)
            for (doc, item), hits in (held.confirmed(words, texts, pairs) if pairs else {}).items():
                n = int(held.counts[item])
                tiles = tile(runs(hits), n, held.min_match)
                share = sum(t[2] for t in tiles) / n
                if share >= threshold:
                    rows.append((doc, held.ids[item], share, n, [dict(zip(("item_word", "doc_word", "words"), t)) for t in sorted(tiles)]))
            rows.sort(key=lambda r: (r[0], r[1] is None, r[1] or 0))
            cols = list(zip(*rows)) or [[]] * 5
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], tiles_type), *[b.column(c).take(at) for c in also]],
                names=["doc_id", "item_id", "coverage", "item_words", "tiles", *also],
            )

    return docs.mapInArrow(run, ", ".join([SCHEMA, *[f"{c} long" for c in also]]))


def blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about `limit` bytes; the driver holds one block at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).orderBy("item_id")
    for item, text in rows.toLocalIterator():
        n = len(text) * 2
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += n
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of document and leaked item: doc_id, item_id, coverage, item_words, tiles (item_word, doc_word, words).

    docs needs doc_id and text, benchmark item_id and text; other columns are
    ignored. Null or empty texts and items without words leak nothing; rows
    that repeat a doc_id or item_id are tiled each for itself; null ids are
    kept. Without documents or items the result is empty.
    """
    return _leaks(docs, [], benchmark, min_match, threshold, block_bytes)


def _leaks(docs: DataFrame, also: list[str], benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """leaks() with further columns of the document (long)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *also)
    out = None
    for rows in blocks(benchmark, block_bytes):
        part = _scan(plain, Items(rows, min_match), threshold)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], ", ".join([SCHEMA, *[f"{c} long" for c in also]]))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without a leaked item, with all their columns. Each row goes by its own text; a row with a null doc_id stays."""
    docs = placed(docs)
    bad = _leaks(docs, PLACE, benchmark, **how).filter("doc_id is not null")
    return without(docs, bad.select(PLACE).distinct())
