"""Near-duplicate documents: SuperMinHash, banding, verification on full sets, grouping.

A document's set is its distinct shingles of `k` words, each known by two
hashes of 64 bits. Documents with one and the same set form a class, known by
128 bits that come from both; everything after that is done for classes. Classes that agree in a band meet in a bucket; the
members of a bucket are tied to its least member, and tied classes form a
candidate group. Within a group all links are confirmed on the full sets:

* a group of at most `group_rows` classes and GROUP_ITEMS elements is one
  task's work;
* a larger one is first held against one hub of its own, class by class, in
  parallel; then the classes that don't link with the hub are held against
  all of the group in blocks of that size. Pairs that the hub's distances
  rule out (Jaccard distance is a metric) and pairs already connected are
  passed over; no other pair is.

So no link between members of a group is lost, and a pair above the threshold
misses all bands with probability (1 - s^rows)^bands, under 1e-5 at s = 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import Texts, U, distinct_per_owner, mix
from .common import PLACE, discard, materialise, placed, slices, without
from ..operators.components import anew, components
from .superminhash import band_keys, signatures

ROWS = 6
#: Classes of a candidate group that one task holds with their sets.
GROUP_ROWS = 1000
#: Elements of these sets together.
GROUP_ITEMS = 1 << 21


def _sum_per_set(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Both hashes of the elements, bounds of each text's set, and each set's identity: 16 bytes, half from each hash."""
    texts = Texts(column)
    one, two, bounds = distinct_per_owner(*texts.shingles(k), texts.n)
    sizes = np.diff(bounds).astype(U)
    halves = mix(_sum_per_set(mix(one ^ U(0x2545F4914F6CDD1D)), bounds) + sizes), mix(_sum_per_set(mix(two + U(0x9E6C63D0876A9A47)), bounds) ^ (sizes * U(0xBF58476D1CE4E5B9)))
    raw = np.stack(halves, axis=1).astype(">u8").tobytes()
    offsets = np.arange(texts.n + 1, dtype=np.int32) * 16
    return one, two, bounds, pa.Array.from_buffers(pa.binary(), texts.n, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, c (the set's identity), bands, and what columns of docs follow doc_id and text (long)."""
    also = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            one, _, bounds, ids = _sets(b.column(1), k)
            keys = band_keys(signatures(one, bounds), ROWS).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds)), ids, lists, *[b.column(c) for c in also]], names=["doc_id", "n", "c", "bands", *also])

    return docs.mapInArrow(run, ", ".join(["doc_id long, n long, c binary, bands array<long>", *[f"{c} long" for c in also]]))


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    """c, items, twins (both hashes of each element) of every document given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            one, two, bounds, ids = _sets(b.column(0), k)
            at = pa.array(bounds.astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, *[pa.ListArray.from_arrays(at, pa.array(h.view(np.int64))) for h in (one, two)]], names=["c", "items", "twins"])

    return docs.mapInArrow(run, "c binary, items array<long>, twins array<long>")


def _numbered(one: np.ndarray, two: np.ndarray) -> tuple[int, np.ndarray]:
    """How many different pairs there are, and the number of each."""
    values, code = np.unique(one, return_inverse=True)
    twin = np.empty(len(values), two.dtype)
    twin[code] = two
    if (twin[code] != two).any():
        values, code = np.unique(np.stack([one, two], axis=1), axis=0, return_inverse=True)
    return len(values), code.ravel()


def _parts(group: pa.Table, index: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both hashes of the elements of the rows at index."""
    lists = [group.column(x).combine_chunks() for x in ("items", "twins")]
    flat = [x.flatten().to_numpy() for x in lists]
    at = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
    return [(flat[0][at[i] : at[i + 1]], flat[1][at[i] : at[i + 1]]) for i in index]


class Linker:
    """Links between sets of one group, found through an inverted index and joined into a forest."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], percent: int):
        self.percent = percent
        self.sizes = np.array([len(x) for x, _ in items])
        self.owner = np.repeat(np.arange(len(items)), self.sizes)
        one, two = (np.concatenate([x[i] for x in items] or [np.zeros(0, np.int64)]) for i in range(2))
        n, self.code = _numbered(one, two)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        order = np.argsort(self.code, kind="stable")
        self.posting = self.owner[order]
        self.first = np.searchsorted(self.code[order], np.arange(n + 1))
        self.parent = list(range(len(items)))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def linked(self, x: int) -> np.ndarray:
        """All sets that link with set x."""
        codes = self.code[self.bounds[x] : self.bounds[x + 1]]
        counts = np.zeros(len(self.sizes), np.int64)
        if len(codes):
            hits = np.concatenate([self.posting[self.first[i] : self.first[i + 1]] for i in codes])
            counts = np.bincount(hits, minlength=len(self.sizes))
        union = self.sizes + self.sizes[x] - counts
        return np.flatnonzero((100 * counts >= self.percent * union) & (counts > 0))

    def join(self, only: np.ndarray) -> list[tuple[int, int]]:
        """The links that join components, from the sets in `only`, widest postings first; a set is passed over when all are one."""
        out = []
        weight = np.diff(self.first)
        degree = [int(weight[self.code[self.bounds[x] : self.bounds[x + 1]]].sum()) for x in only]
        left = len(self.parent)
        for x in only[np.argsort(-np.array(degree), kind="stable")]:
            if left == 1:
                break
            for y in self.linked(int(x)).tolist():
                a, b = self.find(int(x)), self.find(y)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
                    out.append((int(x), y))
                    left -= 1
        return out


def _small_groups(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each group (g), a group in one task."""

    def run(group: pa.Table) -> pa.Table:
        c = group.column("c").to_pylist()
        order = np.array(sorted(range(len(c)), key=c.__getitem__), np.int64)
        return _named([c[i] for i in order], Linker(_parts(group, order), percent).join(np.arange(len(c))))

    return sets.groupBy("g").applyInArrow(run, "a binary, b binary")


def _named(c: list[bytes], links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([c[x] for x, _ in links], pa.binary()), "b": pa.array([c[y] for _, y in links], pa.binary())})


def _large_groups(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """An intermediate table, and the same for groups of more classes (g, c, items, twins, blocks, hub), by a star and blocks. Nothing is dealt out by g alone: a group's classes lie in its blocks, and what a block needs is copied to each of them."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    sets = sets.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")))
    hubs = sets.filter("c = hub").select(F.col("g").alias("hub_g"), F.col("items").alias("hub_items"), F.col("twins").alias("hub_twins"), every.alias("hub_block"))
    both = F.least(F.size(F.array_intersect("items", "hub_items")), F.size(F.array_intersect("twins", "hub_twins")))
    held = sets.join(hubs, (F.col("g") == F.col("hub_g")) & (F.col("block") == F.col("hub_block")))
    held = held.withColumn("both", both).withColumn("of", F.size("items") + F.size("hub_items") - F.col("both"))
    held = materialise(held.select("g", "c", "hub", "items", "twins", "blocks", "block", (1 - F.col("both") / F.col("of")).alias("far"), (100 * F.col("both") >= percent * F.col("of")).alias("linked")))
    star = held.filter("linked and c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b"))
    # the left side of a block pair: classes that the hub left over; the right side: all
    left = held.filter("not linked").withColumn("left_block", F.col("block")).withColumn("right_block", every).withColumn("is_left", F.lit(True))
    rest = held.filter("not linked").select("g", "blocks", "block").distinct().select(F.col("g").alias("rest_g"), F.col("block").alias("left_block"), every.alias("to_block"))
    right = held.join(rest, (F.col("g") == F.col("rest_g")) & (F.col("block") == F.col("to_block"))).withColumn("right_block", F.col("block")).withColumn("is_left", F.lit(False))
    columns = ["g", "left_block", "right_block", "is_left", "c", "items", "twins", "far", "linked"]
    pairs = left.select(columns).unionByName(right.select(columns))
    reach = 1 - percent / 100

    def run(group: pa.Table) -> pa.Table:
        left, far, linked = (group.column(x).to_numpy() for x in ("is_left", "far", "linked"))
        names = group.column("c").to_pylist()
        c = np.unique(np.array(names, object), return_inverse=True)[1]
        # the triangle inequality: who is nearer to the hub than this can link with no class on the left
        keep = left | (far >= far[left].min() - reach - 1e-9) if left.any() else left
        index = np.flatnonzero(keep)
        index = index[np.lexsort((~left[index], c[index]))]
        index = index[np.concatenate([[True], c[index][1:] != c[index][:-1]])] if len(index) else index
        linker = Linker(_parts(group, index), percent)
        # what links with the hub is one component already
        main = np.flatnonzero(linked[index])
        for x in main[1:]:
            linker.parent[x] = int(main[0])
        return _named([names[i] for i in index], linker.join(np.flatnonzero(left[index])))

    return held, star.unionByName(pairs.groupBy("g", "left_block", "right_block").applyInArrow(run, "a binary, b binary"))


def groups(docs: DataFrame, k: int = 5, percent: int = 80, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links), kept (doc_id = component_id), class_id.

    Links hold where 100 x intersection >= percent x union. docs needs doc_id
    and text; other columns are ignored. A text of fewer than k words is one
    shingle; a null or empty one has none, is linked with nothing and kept.
    Each row is answered for itself: repeated rows form a class and all carry
    its id. A null doc_id takes part in links but names no component; where a
    component has no other id its rows get null and are kept. The result is a
    table in the shared folder; what it was made from is gone by then.
    """
    return _groups(docs, [], k, percent, group_rows)


def _groups(docs: DataFrame, also: list[str], k: int = 5, percent: int = 80, group_rows: int = GROUP_ROWS) -> DataFrame:
    """groups() with further columns of docs (long)."""
    signed = materialise(_signed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *also), k))
    classes = signed.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    banded = classes.select("c", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("c").alias("hub"), F.count("*").alias("members")).filter("members > 1").select(anew("band").alias("bucket"), "hub", "members")
    tied = banded.join(buckets, F.col("band") == F.col("bucket")).groupBy("hub", "c").agg(F.sum("members").alias("degree"))
    tied = materialise(tied)
    group = components(tied.select(F.col("hub").alias("a"), F.col("c").alias("b")))
    degree = tied.groupBy("c").agg(F.sum("degree").alias("degree"))
    rep = materialise(signed.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))
    grouped = rep.join(group.select(F.col("node").alias("c"), F.col("root").alias("g")), "c")
    sizes = grouped.join(degree, "c", "left").groupBy("g").agg(F.count("*").alias("n_group"), F.sum("n").alias("n_items"), F.max_by("c", F.struct("degree", "c")).alias("hub"))
    blocks = F.greatest(F.ceil(F.col("n_group") / group_rows), F.ceil(F.col("n_items") / GROUP_ITEMS)).alias("blocks")
    sizes = sizes.select(anew("g").alias("of_g"), blocks, "hub")
    wanted = grouped.join(sizes, F.col("g") == F.col("of_g")).select(F.col("c").alias("want_c"), F.col("rep").alias("want_id"), "g", "blocks", "hub")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    chosen = texts.join(wanted.select("want_id").distinct(), F.col("doc_id").eqNullSafe(F.col("want_id")), "left_semi")
    sets = _full_sets(chosen.select("text"), k).dropDuplicates(["c"])
    sets = materialise(sets.join(wanted, F.col("c") == F.col("want_c")).select("g", "c", "items", "twins", "blocks", "hub"))
    links = _small_groups(sets.filter("blocks = 1").select("g", "c", "items", "twins"), percent)
    large = sets.filter("blocks > 1")
    held = None
    if large.limit(1).count():
        held, more = _large_groups(large, percent)
        links = links.unionByName(more)
    roots = components(links)
    named = rep.select("c", "rep").join(roots.withColumnRenamed("node", "root_c"), F.col("c") == F.col("root_c"), "left").withColumn("root", F.coalesce("root", "c"))
    least = named.filter("root_c is not null").groupBy("root").agg(F.min("rep").alias("least")).select(anew("root").alias("least_root"), "least")
    named = named.join(least, F.col("root") == F.col("least_root"), "left").select(F.col("c").alias("named_c"), F.coalesce("least", "rep").alias("found"))
    out = signed.join(named, (F.col("c") == F.col("named_c")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("found"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), F.when(F.col("n") > 0, F.col("c")).alias("class_id"), *also)
    out = materialise(out)
    for t in (signed, tied, group, rep, sets, held, roots):
        if t is not None:
            discard(t)
    return out


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents without all but the least id of each group, with all their columns; of rows with one id and one set of shingles the first stays. Each row goes by its own text; rows with a null doc_id or without words stay."""
    docs = placed(docs)
    found = _groups(docs, PLACE, **how).select("doc_id", "class_id", "kept", *PLACE)
    place = F.struct(*PLACE)
    first = found.filter("kept and doc_id is not null and class_id is not null").groupBy(F.col("doc_id").alias("of_id"), F.col("class_id").alias("of_class")).agg(F.min(place).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    again = found.join(first, (F.col("doc_id") == F.col("of_id")) & (F.col("class_id") == F.col("of_class"))).filter(place != F.col("first"))
    return without(docs, found.filter("not kept and doc_id is not null").select(PLACE).unionByName(again.select(PLACE)))
