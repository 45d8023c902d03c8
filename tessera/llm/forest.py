"""Nearest neighbours by a forest of random-projection trees with one shared queue.

Every tree projects vectors on its own random orthonormal directions, one for
each depth, and splits each node at a median. The forest is fitted on a
bounded sample (`FIT_ROWS`) and then places every vector. A query walks all
trees at once: a queue over the nodes of all of them gives the node next by
the sum of squared distances to the planes crossed on the way, which for
orthonormal directions bounds the distance to the cell from below, until the
leaves taken hold `share` of all vectors (overlap between trees estimated as if
independent). Vectors in those leaves are ranked by their exact distance.

Leaves are postings: the leaves of a tree are dealt to parts of `PART_ROWS`
vectors, in order, a larger leaf to several; a query goes to the parts of its
leaves, in blocks of `QUERY_ROWS`, and is held against the vectors of these
leaves only. So the work is the sum of the sizes of the leaves taken, and no
task holds more than one part and one block.

`share` buys recall. Unless it is given it is measured: the exact neighbours of
`TRIALS` vectors tell how far the queue must run to meet `RECALL` of them. For
vectors without structure, whose nearest neighbours are hardly nearer than the
rest, that is a large share, whatever the index.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

FIT_ROWS = 50_000
TREES = 4
LEAF_ROWS = 64
#: Vectors whose neighbours are found exactly to set the share, and the part of these that the queue shall meet.
TRIALS = 64
RECALL = 0.97
#: Vectors and queries that a task holds together.
PART_ROWS, QUERY_ROWS = 1 << 15, 1 << 14
#: Vectors that a task takes from Spark as one matrix, and distances in hand at a time.
ROWS, DISTANCES = 2048, 1 << 20
#: Pairs of a part and a block of queries up to which their table is broadcast: 16 bytes each.
MANY = 1 << 20
SCHEMA = "query_id long, vec_id long, score double"


class Forest:
    """Directions (trees, dim, depth) and split values (trees, nodes in heap order)."""

    def __init__(self, sample: np.ndarray, n: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 2):
        dim = sample.shape[1]
        deepest = max(0, int(np.log2(max(1, len(sample) / 16))))
        self.depth = min(deepest, max(0, int(np.ceil(np.log2(max(1, n / leaf_rows))))), dim)
        rng = np.random.default_rng(seed)
        self.directions = np.stack([np.linalg.qr(rng.normal(size=(dim, max(1, self.depth))))[0] for _ in range(trees)])
        self.splits = np.zeros((trees, 1 << self.depth))
        for t in range(trees):
            p = sample @ self.directions[t]
            node = np.ones(len(sample), np.int64)
            for d in range(self.depth):
                order = np.lexsort((p[:, d], node))
                edge = np.searchsorted(node[order], np.arange(1 << d, (2 << d) + 1))
                middle = np.minimum((edge[:-1] + edge[1:]) // 2, len(sample) - 1)
                self.splits[t, 1 << d : 2 << d] = p[order[middle], d]
                node = 2 * node + (p[:, d] > self.splits[t, node])
        self.sizes = np.zeros((trees, 1 << self.depth), np.int64)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows): the leaf of each row in each tree."""
        out = np.empty((len(self.directions), len(x)), np.int64)
        for t, directions in enumerate(self.directions):
            p = x @ directions
            node = np.ones(len(x), np.int64)
            for d in range(self.depth):
                node = 2 * node + (p[:, d] > self.splits[t, node])
            out[t] = node - (1 << self.depth)
        return out

    def walk(self, q: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Leaves (tree, leaf) in the order of the shared queue, and the share of all vectors taken with each."""
        leaf = 1 << self.depth
        n = max(1, int(self.sizes[0].sum()))
        p = np.einsum("i,tij->tj", q, self.directions).tolist()
        queue = [(0.0, t, 1, 0) for t in range(len(p))]
        missed = 1.0
        while queue:
            far, t, node, d = heapq.heappop(queue)
            while node < leaf:
                gap = p[t][d] - self.splits[t, node]
                near = int(gap > 0)
                heapq.heappush(queue, (far + gap * gap, t, 2 * node + 1 - near, d + 1))
                node, d = 2 * node + near, d + 1
            missed *= 1 - self.sizes[t, node - leaf] / n
            yield t, node - leaf, 1 - missed

    def probes(self, q: np.ndarray, share: float) -> list[tuple[int, int]]:
        """The leaves (tree, leaf) that the shared queue takes for a query."""
        taken = []
        for t, leaf, so_far in self.walk(q):
            taken.append((t, leaf))
            if so_far >= share:
                break
        return taken

    def deal(self, part_rows: int = PART_ROWS) -> None:
        """Set first and number, both (trees, leaves): the parts of each leaf. Leaves that lie together share a part of about part_rows vectors; a leaf of more has several to itself."""
        self.first, self.number = np.zeros(self.sizes.shape, np.int64), np.ones(self.sizes.shape, np.int64)
        part = -1
        for t, sizes in enumerate(self.sizes.tolist()):
            held = part_rows
            for leaf, n in enumerate(sizes):
                if held + n > part_rows:
                    part, held = part + 1, 0
                self.first[t, leaf] = part
                held += n
                if n > part_rows:
                    self.number[t, leaf] = -(-n // part_rows)
                    part += int(self.number[t, leaf]) - 1
                    held = part_rows

    def between(self, leaf: np.ndarray, lot: np.ndarray) -> np.ndarray:
        """Where rows of these leaves of the first tree stand among all vectors, from 0 to 1; lots (0 to 1) order those of a leaf."""
        before = np.cumsum(self.sizes[0]) - self.sizes[0]
        return (before[leaf] + lot * self.sizes[0][leaf]) / max(1, int(self.sizes[0].sum()))

    def needed(self, q: np.ndarray, neighbours: np.ndarray) -> list[float]:
        """The share at which each of the neighbours is met."""
        out: dict[int, float] = {}
        where: dict[tuple[int, int], list[int]] = {}
        for t, leaves in enumerate(self.leaves(neighbours)):
            for i, leaf in enumerate(leaves.tolist()):
                where.setdefault((t, leaf), []).append(i)
        for t, leaf, so_far in self.walk(q):
            for i in where.get((t, leaf), ()):
                out.setdefault(i, so_far)
            if len(out) == len(neighbours):
                break
        return list(out.values())


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: vectors that are neither null nor zero and hold finite components only, as array<float> if they are that, else as array<double>."""
    v = F.col("v")
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v")).filter(fine)


def fit(rows: DataFrame, trees: int = TREES, leaf_rows: int = LEAF_ROWS, fit_rows: int = FIT_ROWS) -> tuple[Forest | None, int]:
    """The forest of usable vectors and their dimension, the commonest length. Sizes of leaves count every vector."""
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return None, 0
    dim, n = lengths["dim"], lengths["count"]
    rows = rows.filter(F.size("v") == dim)
    picked = rows.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20)) <= int((1 << 20) * min(1.0, fit_rows / n))).limit(fit_rows)
    sample = np.array([r["v"] for r in picked.select("v").orderBy("v").collect()]).reshape(-1, dim)
    forest = Forest(sample, n, trees, leaf_rows)
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        total = np.zeros(f.sizes.shape, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                for t, leaf in enumerate(f.leaves(_matrix(b.column(0).slice(at, ROWS), dim))):
                    total[t] += np.bincount(leaf, minlength=total.shape[1])
        t, leaf = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(leaf), pa.array(total[t, leaf])], names=["tree", "leaf", "n"])

    # a row for each leaf: at most trees x FIT_ROWS / 16, however many vectors there are
    for r in rows.select("v").mapInArrow(count, "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        forest.sizes[r["tree"], r["leaf"]] = r["n"]
    forest.deal()
    return forest, dim


def _first(k: int, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of candidates (query, score, id) the places of the k first of each query, ties to the smaller id."""
    order = np.lexsort((ids, score, who))
    begin = np.searchsorted(who[order], who[order])
    return order[np.arange(len(order)) - begin < k]


def _near(q: np.ndarray, x: np.ndarray, own: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, exact distance) of the k nearest of x to each row of q, but those of its own name."""
    out = []
    step = max(1, DISTANCES // max(1, len(x)))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        about = (part * part).sum(1)[:, None] + (x * x).sum(1) - 2 * (part @ x.T)
        about[own[at : at + step, None] == names[None, :]] = np.inf
        inside = np.isfinite(about)
        if len(x) > k:
            # the product rounds otherwise than the exact distance
            line = np.partition(about, k - 1, axis=1)[:, k - 1 : k]
            inside &= about <= line * (1 + 1e-9) + 1e-9
        i, j = np.nonzero(inside)
        exact = np.concatenate([np.sqrt(((x[j[c : c + 8192]] - part[i[c : c + 8192]]) ** 2).sum(1)) for c in range(0, len(i), 8192)] or [np.zeros(0)])
        keep = _first(k, i, exact, names[j])
        out.append((i[keep] + at, j[keep], exact[keep]))
    return tuple(np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3))


def _exact(rows: DataFrame, dim: int, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Each task's k nearest vectors to each of a few queries."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                names = b.column(0).slice(at, ROWS).to_numpy()
                i, j, score = _near(q, _matrix(b.column(1).slice(at, ROWS), dim), ids, names, k)
                held = [np.concatenate(x) for x in zip(held, (i, score, names[j]))]
                keep = _first(k, held[0], held[1], held[2])
                held = [x[keep] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0].astype(np.int64)]), pa.array(held[2]), pa.array(held[1])], names=["query_id", "vec_id", "score"])

    return rows.select("vec_id", "v").mapInArrow(run, SCHEMA)


def measured_share(rows: DataFrame, forest: Forest, dim: int, k: int, trials: int = TRIALS, recall: float = RECALL) -> float:
    """The share of all vectors at which `recall` of the exact neighbours of some vectors are met."""
    some = rows.orderBy(F.xxhash64(F.lit(7), "vec_id", "v"), "vec_id").limit(trials).collect()
    ids, q = np.array([r["vec_id"] for r in some]), np.array([r["v"] for r in some])
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = _exact(rows, dim, ids, q, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("vec_id").alias("found_id")).distinct()
    found = best.join(rows, F.col("found_id") == F.col("vec_id")).select("query_id", "v").collect()
    needed: list[float] = []
    for own, x in zip(ids.tolist(), q):
        near = [r["v"] for r in found if r["query_id"] == own]
        if near:
            needed += forest.needed(x, np.array(near))
    return min(1.0, float(np.quantile(needed, recall))) if needed else 1.0


def _lot() -> Column:
    return F.xxhash64(F.lit(3), "vec_id", "v").alias("lot")


def _placed(rows: DataFrame, forest: Forest, dim: int) -> DataFrame:
    """part, leaf, vec_id, v: each vector once for each tree."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                lot = part.column(2).to_numpy().view(np.uint64)
                for t, leaf in enumerate(f.leaves(_matrix(part.column(1), dim))):
                    own = f.first[t, leaf] + (lot % f.number[t, leaf].astype(np.uint64)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(leaf), t, np.int32)), pa.array(leaf), part.column(0), part.column(1)], names=["part", "tree", "leaf", "vec_id", "v"])

    return rows.select("vec_id", "v", _lot()).mapInArrow(run, f"part long, tree int, leaf long, vec_id long, v {kind}")


def _asked(asked: DataFrame, forest: Forest, dim: int, share: float, blocks: int) -> DataFrame:
    """part, block, query_id, lot, q, leaves: each query once for each part that holds leaves it takes. Blocks follow the leaves of the first tree, so that queries that lie together ask together."""
    shared = asked.sparkSession.sparkContext.broadcast(forest)
    kind = asked.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            x = _matrix(b.column(1), dim)
            lots = b.column(2).to_numpy()
            block = np.minimum((f.between(f.leaves(x)[0], lots.view(np.uint64) / 2.0**64) * blocks).astype(np.int64), blocks - 1)
            for i, q in enumerate(x):
                parts: dict[int, list[int]] = {}
                for t, leaf in f.probes(q, share):
                    for p in range(f.first[t, leaf], f.first[t, leaf] + f.number[t, leaf]):
                        parts.setdefault(p, []).append(leaf)
                n = len(parts)
                one = b.slice(i, 1).take(pa.array([0] * n, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([block[i]] * n, pa.int64()), one.column(0), one.column(2), one.column(1), pa.array(list(parts.values()), pa.list_(pa.int32()))], names=["part", "block", "query_id", "lot", "q", "leaves"])

    return asked.select("vec_id", "v", _lot()).mapInArrow(run, f"part long, block long, query_id long, lot long, q {kind}, leaves array<int>")


def _distinct(x: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of all vectors but those that equal k + 1 others of smaller names, which can't be among anyone's k nearest."""
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    same = np.unique(whole, return_inverse=True)[1].ravel()
    order = np.lexsort((names, same))
    s, n = same[order], names[order]
    new = np.ones(len(n), bool)
    new[1:] = (n[1:] != n[:-1]) | (s[1:] != s[:-1])
    number = np.cumsum(new)
    return order[number - number[np.searchsorted(s, s)] <= k]


def _searcher(dim: int, k: int):
    """Of a part and a block of queries: the k nearest found for each query, with how often a row occurs."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        ids, lots = asked.column("query_id").to_numpy(), asked.column("lot").to_numpy()
        q = _matrix(asked.column("q").combine_chunks(), dim)
        lists = asked.column("leaves").combine_chunks()
        x, names, leaf = _matrix(held.column("v").combine_chunks(), dim), held.column("vec_id").to_numpy(), held.column("leaf").to_numpy()
        keep = _distinct(x, names, k) if len(x) else np.zeros(0, np.int64)
        keep = keep[np.argsort(leaf[keep], kind="stable")]
        x, names, leaf = x[keep], names[keep], leaf[keep]
        wanted = lists.flatten().to_numpy()
        who = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(wanted, kind="stable")
        wanted, who = wanted[order], who[order]
        parts = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        pending = 0
        for one in np.unique(wanted):
            a, z = np.searchsorted(leaf, [one, one + 1])
            if a == z:
                continue
            i = who[slice(*np.searchsorted(wanted, [one, one + 1]))]
            near, j, score = _near(q[i], x[a:z], ids[i], names[a:z], k)
            parts.append((i[near], score, names[a:z][j]))
            pending += len(near)
            if pending > DISTANCES:
                parts, pending = [_best(parts, k)], 0
        i, score, name = _best(parts, k)
        # equal rows of one id stand as one, with their number
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (score[1:] != score[:-1]) | (name[1:] != name[:-1])
        at = np.flatnonzero(new)
        tree = held.column("tree")[0].as_py() if held.num_rows else 0
        return pa.table({"query_id": ids[i[at]], "lot": lots[i[at]], "tree": np.full(len(at), tree, np.int32), "vec_id": name[at], "score": score[at], "n": np.diff(np.append(at, len(i)))})

    return run


def _best(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, score, name = (np.concatenate([p[c] for p in parts]) for c in range(3))
    keep = _first(k, i, score, name)
    return i[keep], score[keep], name[keep]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float | None = None, trees: int = TREES, leaf_rows: int = LEAF_ROWS, fit_rows: int = FIT_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision).

    Vectors that are null, zero, hold null or non-finite components, or have
    another length than most, take no part, nor have rows with a null id. A
    query never finds rows of its own id; of repeated rows with one id it
    finds each. Queries that repeat an id and a vector are one; those that
    repeat an id with other vectors are each ranked for itself, under the one
    id. Other columns are ignored. Without vectors or queries the result is
    empty.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors, id_col, vector_col).filter("vec_id is not null")
    forest, dim = fit(rows, trees, leaf_rows, fit_rows)
    if forest is None:
        return empty
    rows = rows.filter(F.size("v") == dim)
    wanted = usable(queries, id_col, vector_col).filter(F.col("vec_id").isNotNull() & (F.size("v") == dim)).dropDuplicates(["vec_id", "v"])
    if share is None:
        share = measured_share(rows, forest, dim, k)
    blocks = -(-wanted.count() // QUERY_ROWS)
    if not blocks:
        return empty
    asked = materialise(_asked(wanted, forest, dim, share, blocks))
    pairs = asked.select(F.col("part").alias("own_part"), F.col("block").alias("own_block")).distinct()
    if forest.first.max() * blocks < MANY:
        pairs = F.broadcast(pairs)
    held = _placed(rows, forest, dim).join(pairs, F.col("part") == F.col("own_part"))
    found = asked.groupBy("part", "block").cogroup(held.groupBy("own_part", "own_block")).applyInArrow(_searcher(dim, k), "query_id long, lot long, tree int, vec_id long, score double, n long")
    # a row lies in one leaf of each tree: trees that find it find the same row
    found = found.groupBy("query_id", "lot", "vec_id", "score", "tree").agg(F.sum("n").alias("n")).groupBy("query_id", "lot", "vec_id", "score").agg(F.max("n").alias("n"))
    found = found.select("query_id", "lot", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    order = Window.partitionBy("query_id", "lot").orderBy("score", "vec_id")
    out = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    out = materialise(out)
    discard(asked)
    return out
