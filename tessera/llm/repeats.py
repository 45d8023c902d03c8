"""Long repeats: every byte covered by a 200-byte string that also starts elsewhere.

Sampled suffixes. A window of `length` bytes is owned by one of its `GRAM`-byte
strings, the one of least hash, leftmost of equals; the owner depends on the
window's bytes only, so equal windows have equal owners at equal distances. A
first pass counts owners over all texts. Windows whose owner occurs once are
unique and go no further; for the rest, an owner and the bytes of the windows
it owns travel as one context, sharded by owner.

Logarithmic index family. In a shard contexts arrive in the order of their
owners, equal ones as one, in batches. Each batch gets a suffix array: the
window starts it brings, in the order of the bytes from there on, cut to
`length`. Neighbours whose bytes are equal match. The batch is merge-scanned
against every level of the family, bytes against bytes, for matches on both
sides, and becomes a level; levels of equal size merge, so n windows stand in
at most log2(n / batch) levels and are merged that often. Hashes only choose
where strings meet; no match is decided by one. Once the owners in hand are
complete and hold `BATCH_WINDOWS` windows, the family is answered and let go:
no other owner can match them. A task so holds about a batch, or one owner of
at most `HOT` occurrences.

Contexts of an owner with more than `HOT` occurrences are added up before
they are dealt out, equal ones to one row. An owner that still has more than
`HOT` of them is split: its windows reach at least half of the way to the left
of the owner or at least half of it to the right, and those bytes, which equal
windows share, lengthen the owner. Half the freedom is left each time, until
an owner is a whole window, so splits end after eight rounds and a window lies
in one context throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import Texts, U, mix
from .common import discard, file_backed, in_blocks, materialise, slices

LENGTH = 200
GRAM = 64
#: Occurrences beyond which an owner's windows are dealt out one by one.
HOT = 1000
#: Windows in a batch of an index family; sorting holds the bytes of each.
BATCH_WINDOWS = 1 << 17
#: Windows of a level whose bytes are in hand at a time while a batch is scanned against it.
SCAN_WINDOWS = 1 << 16
#: Bytes of contexts that a task takes from Spark at a time.
BATCH_BYTES = 1 << 20
_POSITION = U((1 << 24) - 1)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def _totals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=total[1:])
    return total, inverse


def _hashes(total: np.ndarray, inverse: np.ndarray, start: np.ndarray | slice, n: int) -> np.ndarray:
    """Hashes of the n bytes from each start."""
    if isinstance(start, slice):
        return mix((total[start.start + n : start.stop + n] - total[start]) * inverse[start])
    return mix((total[start + n] - total[start]) * inverse[start])


def owned(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one owner: text, first and last window start, the owner's hash and its place (positions in data)."""
    none = np.zeros(0, np.int64)
    n, wide = len(data) - length + 1, length - gram + 1
    if n <= 0:
        return none, none, none, none.astype(U), none
    if len(data) > int(_POSITION):
        # a text beyond 16 MB: runs of overlapping stretches, cut where they meet
        return _owned_long(data, bounds, length, gram)
    total, inverse = _totals(data)
    grams = _hashes(total, inverse, slice(0, len(data) - gram + 1), gram)
    value = (grams & ~_POSITION) | np.arange(len(grams), dtype=U)
    # least of each `wide` values: suffix minima of one stretch meet prefix minima of the next
    pad = -len(value) % wide
    table = np.concatenate([value, np.full(pad, ~U(0), U)]).reshape(-1, wide)
    prefix = np.minimum.accumulate(table, axis=1).ravel()
    suffix = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    owner = (np.minimum(suffix[:n], prefix[wide - 1 : wide - 1 + n]) & _POSITION).astype(np.int64)
    room = np.zeros(len(data) + 1, np.int32)
    long = np.diff(bounds) >= length
    np.add.at(room, bounds[:-1][long], 1)
    np.add.at(room, bounds[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(room[:-1])[:n] > 0)
    if not len(starts):
        return none, none, none, none.astype(U), none
    text = np.searchsorted(bounds, starts, side="right") - 1
    own = owner[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], starts[at], starts[np.append(at[1:], len(starts)) - 1], grams[own[at]], own[at]


def _owned_long(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    step, out = 1 << 22, []
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        for s in range(int(a), max(int(a) + 1, int(b) - length + 1), step):
            part = data[s : min(int(b), s + step + length - 1)]
            _, lo, hi, h, own = owned(part, np.array([0, len(part)]), length, gram)
            out.append((np.full(len(lo), k), lo + s, hi + s, h, own + s))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(5))


class Family:
    """Suffix arrays in levels, sizes falling by half at least from level to level. An entry is the place of a window in the bytes added so far."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.data = np.zeros(0, np.uint8)
        self.levels: list[np.ndarray] = []
        self.matched: list[np.ndarray] = []

    def _bytes(self, starts: np.ndarray) -> np.ndarray:
        """(starts, length): the bytes of windows."""
        return np.lib.stride_tricks.sliding_window_view(self.data, self.length)[starts]

    def _strings(self, starts: np.ndarray) -> np.ndarray:
        return self._bytes(starts).view(f"S{self.length}").ravel()

    def add(self, data: np.ndarray, starts: np.ndarray) -> None:
        """Bytes and the window starts in them: sort these as suffixes, note the matches among them and with every level, keep them as a level and merge equal sizes."""
        if not len(starts):
            return
        starts = starts + len(self.data)
        self.data = np.concatenate([self.data, data])
        table = self._bytes(starts)
        order = pc.sort_indices(pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.length), len(starts), [None, pa.py_buffer(table)])).to_numpy().astype(np.int64)
        starts, table = starts[order], table[order]
        same = np.flatnonzero((table[1:] == table[:-1]).all(axis=1))
        self.matched += [starts[same], starts[same + 1]]
        strings = table.view(f"S{self.length}").ravel()
        places = [self._scan(level, starts, strings) for level in self.levels]
        self.levels.append(starts)
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            small, large = self.levels.pop(), self.levels.pop()
            at = places.pop() if len(places) == len(self.levels) + 1 and len(small) == len(starts) else self._places(large, self._strings(small))
            self.levels.append(np.insert(large, at, small))

    def _places(self, level: np.ndarray, strings: np.ndarray) -> np.ndarray:
        """Where sorted strings go in a level, left of equals; the level's bytes are looked at in stretches."""
        out = np.zeros(len(strings), np.int64)
        for a in range(0, len(level), SCAN_WINDOWS):
            held = self._strings(level[a : a + SCAN_WINDOWS])
            out += np.searchsorted(held, strings)
        return out

    def _scan(self, level: np.ndarray, starts: np.ndarray, strings: np.ndarray) -> np.ndarray:
        """Note the matches of sorted entries with a level; where they go in it."""
        at = self._places(level, strings)
        inside = np.flatnonzero(at < len(level))
        for a in range(0, len(inside), SCAN_WINDOWS):
            i = inside[a : a + SCAN_WINDOWS]
            met = i[(self._bytes(level[at[i]]) == self._bytes(starts[i])).all(axis=1)]
            # equal entries of a level were noted when they met, but for a single one
            self.matched += [starts[met], level[at[met]]]
        return at

    def found(self) -> np.ndarray:
        """Places of all windows that have an equal one."""
        return np.unique(np.concatenate(self.matched)) if self.matched else np.zeros(0, np.int64)


def _counted(docs: DataFrame) -> DataFrame:
    """block, owner, n: owners of each block, added up in the task that reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(block: int) -> pa.RecordBatch:
            u, n = np.unique(np.concatenate(held.pop(block)), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), block, np.int64)), pa.array(u.view(np.int64)), pa.array(n)], names=["block", "owner", "n"])

        for b in slices(batches):
            for block, a, z in _stretches(b.column(2)):
                for other in [x for x in held if x != block]:
                    yield out(other)
                t = Texts(b.column(1).slice(a, z - a))
                held.setdefault(block, []).append(owned(t.data, t.bounds)[3])
        for block in list(held):
            yield out(block)

    return docs.mapInArrow(run, "block long, owner long, n long")


def _stretches(column: pa.Array) -> Iterator[tuple[int, int, int]]:
    blocks = column.to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
    for a, z in zip(edges, [*edges[1:], len(blocks)]):
        yield int(blocks[a]), int(a), int(z)


def _packets(docs: DataFrame) -> DataFrame:
    """block, ids, sizes, texts: rows that lie together, their texts compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            for block, a, z in _stretches(b.column(2)):
                t = Texts(b.column(1).slice(a, z - a))
                row = block, b.column(0).slice(a, z - a).to_pylist(), t.sizes.tolist(), squeeze.compress(t.data.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], names=["block", "ids", "sizes", "texts"])

    return docs.mapInArrow(run, "block long, ids array<long>, sizes array<long>, texts binary")


_PART = "block long, kind int, doc_id long, n_bytes long, sha string, seq int, texts binary, runs array<int>, starts array<int>, run int, owner long, hot boolean, n int, place int, context binary"


def _split(packets: pa.Table, asked: pa.Table) -> pa.Table:
    """Of a block: rows without a repeated owner, done (kind 0); other rows with the runs of windows that have one (kind 1); those runs, one of each owner and bytes (kind 2)."""
    owners = asked.column("owner").to_numpy().view(U)
    hot = asked.column("hot").to_numpy(zero_copy_only=False)
    order = np.argsort(owners)
    owners, hot = owners[order], hot[order]
    expand, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
    rows: list[dict] = []
    known: dict[tuple[int, bytes], int] = {}
    contexts: list[dict] = []
    seq = 0
    for packet in packets.to_pylist():
        block, sizes = packet["block"], np.array(packet["sizes"], np.int64)
        raw = expand.decompress(packet["texts"]) if sizes.sum() else b""
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        text, lo, hi, own, gram = owned(np.frombuffer(raw, np.uint8), bounds)
        at = np.minimum(np.searchsorted(owners, own), max(0, len(owners) - 1))
        many = owners[at] == own if len(owners) else np.zeros(len(own), bool)
        text, lo, hi, own, gram, at = text[many], lo[many], hi[many], own[many], gram[many], at[many]
        edges = np.searchsorted(text, np.arange(len(sizes) + 1))
        for i, doc_id in enumerate(packet["ids"]):
            a, z = int(bounds[i]), int(bounds[i + 1])
            if edges[i] == edges[i + 1]:
                rows.append({"block": block, "kind": 0, "doc_id": doc_id, "n_bytes": z - a, "sha": hashlib.sha256(raw[a:z]).hexdigest()})
                continue
            names = []
            for j in range(edges[i], edges[i + 1]):
                piece = raw[lo[j] : hi[j] + LENGTH]
                key = (int(own[j]), piece)
                if key not in known:
                    known[key] = len(contexts)
                    contexts.append({"block": block, "kind": 2, "run": len(contexts), "owner": int(own[j : j + 1].view(np.int64)[0]), "hot": bool(hot[at[j]]), "n": 0, "place": int(gram[j] - lo[j]), "context": piece})
                contexts[known[key]]["n"] += 1
                names.append(known[key])
            rows.append({"block": block, "kind": 1, "doc_id": doc_id, "n_bytes": z - a, "seq": seq, "texts": squeeze.compress(raw[a:z]), "runs": names, "starts": (lo[edges[i] : edges[i + 1]] - a).tolist()})
            seq += 1
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in _PART.split(", ")])
    return pa.Table.from_pylist(rows + contexts, schema)


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (inclusive) of the runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


class Shard:
    """Contexts in the order of (owner, bytes), held until their owners are complete."""

    def __init__(self, length: int = LENGTH, batch: int = BATCH_WINDOWS):
        self.length, self.batch = length, batch
        self.clear()

    def clear(self) -> None:
        self.owners: list[int] = []
        self.pieces: list[bytes] = []
        self.times: list[int] = []
        self.members: list[tuple[int, int, int, int]] = []
        self.windows = 0

    def add(self, owner: int, piece: bytes, n: int, block: int | None, run: int, lo: int) -> None:
        """A context, which occurs n times; without a block it is there for others to match."""
        if not self.owners or self.owners[-1] != owner or self.pieces[-1] != piece:
            self.owners.append(owner)
            self.pieces.append(piece)
            self.times.append(0)
            self.windows += len(piece) - self.length + 1
        self.times[-1] += n
        if block is not None:
            self.members.append((block, run, lo, len(self.owners) - 1))

    def full(self, owner: int) -> bool:
        """Whether a batch is in hand and `owner` begins another."""
        return self.windows >= self.batch and self.owners[-1] != owner

    def answer(self) -> pa.RecordBatch:
        """block, run, lo, hi of the stretches of repeated windows of each context in hand."""
        owners, times = np.array(self.owners, np.int64), np.array(self.times)
        sizes = np.array([len(p) for p in self.pieces], np.int64)
        w = sizes - self.length + 1
        first = np.cumsum(w) - w
        flags = np.repeat(times > 1, w)
        # a context that is the only one of its owner has no other to match
        alone = np.ones(len(owners), bool)
        alone[1:] &= owners[1:] != owners[:-1]
        alone[:-1] &= owners[1:] != owners[:-1]
        several = np.flatnonzero(~alone)
        family, begin, held, number = Family(self.length), [], 0, []
        cut = np.flatnonzero(np.diff(np.cumsum(w[several]) // self.batch)) + 1
        for part in np.split(several, cut):
            if not len(part):
                continue
            at = np.cumsum(sizes[part]) - sizes[part]
            starts = np.repeat(at - (np.cumsum(w[part]) - w[part]), w[part]) + np.arange(int(w[part].sum()))
            family.add(np.frombuffer(b"".join([self.pieces[i] for i in part]), np.uint8), starts)
            begin.append(starts + held)
            number.append(np.repeat(first[part] - (np.cumsum(w[part]) - w[part]), w[part]) + np.arange(int(w[part].sum())))
            held += int(sizes[part].sum())
        if begin:
            places = np.concatenate(begin)
            flags[np.concatenate(number)[np.searchsorted(places, family.found())]] = True
        of_window = np.repeat(np.arange(len(w)), w)
        # a stretch ends where its context ends
        edge = flags.copy()
        edge[1:] &= ~flags[:-1] | (of_window[1:] != of_window[:-1])
        last = flags.copy()
        last[:-1] &= ~flags[1:] | (of_window[1:] != of_window[:-1])
        lo, hi = np.flatnonzero(edge), np.flatnonzero(last)
        piece = of_window[lo]
        blocks, runs, base, of = np.array(self.members, np.int64).reshape(-1, 4).T
        left, right = np.searchsorted(of, piece), np.searchsorted(of, piece, side="right")
        count = right - left
        member = np.repeat(left - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        out = [blocks[member], runs[member].astype(np.int32), (base[member] + np.repeat(lo - first[piece], count)).astype(np.int32), (base[member] + np.repeat(hi - first[piece], count)).astype(np.int32)]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["block", "run", "lo", "hi"])


_CONTEXT = "owner long, size int, place int, context binary, n long, block long, run int, lo int"
_FOUND = "block long, run int, lo int, hi int"


def _matched(contexts: DataFrame) -> DataFrame:
    """(block, run, lo, hi): stretches of repeated windows of each context, by index families in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for b in slices(batches, "context", BATCH_BYTES):
            for owner, piece, n, block, run_, lo in zip(*(b.column(i).to_pylist() for i in range(6))):
                if shard.owners and shard.full(owner):
                    yield shard.answer()
                shard.add(owner, piece, n, block, run_, lo)
        if shard.owners:
            yield shard.answer()

    shards = contexts.select("owner", "context", "n", "block", "run", "lo").repartition("owner").sortWithinPartitions("owner", "context")
    return shards.mapInArrow(run, _FOUND)


def halves(size: int, place: int, context: bytes, length: int = LENGTH) -> list[tuple[bytes, int, int, bytes, int]]:
    """A context, whose owner has `size` bytes from `place` on, as one or two: the longer owner, its size and place, the bytes of its windows, and the first of these windows in the context."""
    free, windows = length - size, len(context) - length + 1
    left = (free + 1) // 2
    right = free - left + 1
    cut = min(windows, max(0, place - left + 1))
    out = []
    if cut:
        out.append((context[place - left : place + size], size + left, place - left, context[: cut - 1 + length], 0))
    if cut < windows:
        out.append((context[place : place + size + right], size + right, place - cut, context[cut:], cut))
    return out


def _halved(contexts: DataFrame) -> DataFrame:
    """Contexts with longer owners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "context", BATCH_BYTES):
            rows = []
            for owner, size, place, context, n, block, run_, lo in zip(*(c.to_pylist() for c in b.columns)):
                for own, size_, place_, part, at in halves(size, place, context):
                    name = hashlib.blake2b(own, digest_size=8, person=b"%d" % (size_ - size), salt=b"left" if at == 0 and place_ != place else b"right").digest()
                    rows.append((int.from_bytes(name, "big", signed=True), size_, place_, part, n, block, run_, lo + at))
            cols = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split(" ")[0] for c in _CONTEXT.split(", ")])

    return contexts.mapInArrow(run, _CONTEXT)


def _spread(contexts: DataFrame, most: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Contexts of common owners: equal ones as one, without a block where there are several; what is found of those (all of their windows); the tables that both read. No owner has more than `most` contexts."""
    found, ready, tables = None, None, []
    again = F.col("n") > 1
    while True:
        own = [F.min(c).alias(c) for c in ("size", "place")]
        merged = contexts.groupBy("owner", "context").agg(F.sum("n").alias("n"), *own, *[F.min(c).alias(c) for c in ("block", "run", "lo")])
        merged = materialise(merged.withColumn("block", F.when(~again, F.col("block"))))
        several = merged.filter(again).select("owner", "context")
        last = (F.length("context") - LENGTH + F.col("lo")).cast("int").alias("hi")
        more = contexts.filter("block is not null").join(several, ["owner", "context"], "left_semi").select("block", "run", "lo", last)
        large = merged.filter(F.col("size") < LENGTH).groupBy("owner").count().filter(F.col("count") > most).select("owner")
        large = materialise(large)
        small = merged.join(large, "owner", "left_anti")
        found = more if found is None else found.unionByName(more)
        ready = small if ready is None else ready.unionByName(small)
        tables += [merged, large]
        if not large.limit(1).count():
            return ready, found, tables
        contexts = materialise(_halved(merged.join(large, "owner", "left_semi").select(*[c.split(" ")[0] for c in _CONTEXT.split(", ")])))
        tables.append(contexts)


def _removed(rows: pa.Table, found: pa.Table) -> pa.Table:
    """Of a block: the bytes covered by repeated windows, and what is left."""
    expand = zstandard.ZstdDecompressor()
    run, lo, hi = (found.column(c).to_numpy() for c in ("run", "lo", "hi"))
    order = np.argsort(run, kind="stable")
    run, lo, hi = run[order], lo[order], hi[order]
    out = []
    for r in rows.to_pylist():
        raw = expand.decompress(r["texts"])
        mark = np.zeros(len(raw) + 1, np.int64)
        names, starts = np.array(r["runs"]), np.array(r["starts"])
        a, z = np.searchsorted(run, names), np.searchsorted(run, names, side="right")
        count = z - a
        which = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        begin = np.repeat(starts, count)
        np.add.at(mark, begin + lo[which], 1)
        np.add.at(mark, begin + hi[which] + LENGTH, -1)
        gone = np.cumsum(mark[:-1]) > 0
        s, e = _intervals(gone)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append({"doc_id": r["doc_id"], "n_bytes": len(raw), "n_removed": int(gone.sum()), "n_spans": len(s), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": [{"start": int(x), "end": int(y) + 1} for x, y in zip(s, e)]})
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    return pa.Table.from_pylist(out, schema)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs of bytes, end exclusive).

    docs needs doc_id and text; other columns are ignored. Texts are judged as
    UTF-8 bytes as they came in; a null text is empty. Every row is a text of
    its own, so repeated rows repeat each other, whatever their ids; texts
    below 200 bytes lose nothing. docs that are not read from Parquet files
    are written to the shared folder first. The result is a table in the shared
    folder; what it was made from is gone by then.
    """
    if not file_backed(docs):
        docs = materialise(docs.select("doc_id", "text"))
    own = in_blocks(docs)
    counted = materialise(_counted(own))
    several = counted.groupBy("owner").agg(F.sum("n").alias("times")).filter("times > 1").withColumnRenamed("owner", "again")
    asked = counted.join(several, F.col("owner") == F.col("again")).select("block", "owner", (F.col("times") > hot).alias("hot"))
    parts = materialise(_packets(own).groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_split, _PART))
    kinds = [F.lit(GRAM).alias("size"), "place", "context", F.col("n").cast("long").alias("n"), "block", "run", F.lit(0).alias("lo")]
    contexts = parts.filter("kind = 2").select("hot", "owner", *kinds)
    common, copied, tables = _spread(contexts.filter("hot").drop("hot"), hot)
    found = _matched(contexts.filter("not hot").drop("hot").unionByName(common)).unionByName(copied)
    removed = parts.filter("kind = 1").select("block", "doc_id", "texts", "runs", "starts").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_removed, RESULT)
    untouched = parts.filter("kind = 0").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"))
    out = materialise(untouched.unionByName(removed))
    for t in (counted, parts, *tables):
        discard(t)
    return out
