"""Removed bytes against a dictionary of all 200-byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np

from tessera.llm import catalog, repeats

from .colliding import colliding


def plain(rows, n=200):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for (d, _), r in zip(rows, raws):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int(((gone[1:] == 0) & gone[:-1]).sum())
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((str(d), len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def hard(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    stock = [" ".join(word() for _ in range(120)) for _ in range(4)]
    rows = []
    for i in range(60):
        t = "".join(rng.choice([" ".join(word() for _ in range(rng.randrange(60))), (s := rng.choice(stock))[(a := rng.randrange(len(s))) : a + rng.randrange(150, 420)]]) for _ in range(4))
        if rng.random() < 0.3 and len(t) > 10:
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        rows.append((i, t))
    return [*rows, (60, "ab" * 500), (61, "a" * 199), (62, "a" * 200), (63, "q" * 201), (64, None), (None, ""), (64, stock[0]), (64, stock[0]), (65, "é" * 99 + "x"), (66, "é" * 99 + "x")]


def test_equal_to_all_strings(spark):
    rows = hard(1)
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, block string").repartition(3)
    assert got(repeats.remove_repeats(df)) == plain(rows)
    assert got(repeats.remove_repeats(df, hot=2)) == plain(rows), "by way of longer owners"
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_long_texts_in_stretches(monkeypatch):
    rng = random.Random(5)
    data = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(6000)), np.uint8)
    whole = repeats.owned(data, np.array([0, 1000, 6000]))
    windows = lambda x: {(int(t), s): (int(h), int(own)) for t, lo, hi, h, own in zip(*x) for s in range(lo, hi + 1)}
    assert windows(whole) == windows(repeats._owned_long(data, np.array([0, 1000, 6000]), 200, 64))


def test_family_keeps_few_levels_in_suffix_order_and_all_matches():
    rng = np.random.default_rng(2)
    f, every = repeats.Family(8), []
    for _ in range(40):
        p = rng.choice(np.frombuffer(b"\x00a\xff", np.uint8), 60)
        f.add(p, np.arange(0, 53))
        every.append(p)
    flat = np.concatenate(every).tobytes()
    starts = [60 * i + j for i in range(40) for j in range(53)]
    seen = Counter(flat[i : i + 8] for i in starts)
    assert f.found().tolist() == [i for i in starts if seen[flat[i : i + 8]] > 1] and len(f.levels) <= 7
    for level in f.levels:
        strings = [flat[i : i + 8] for i in level]
        assert strings == sorted(strings)


def test_halves_keep_every_window_and_its_owner():
    rng = random.Random(8)
    for _ in range(200):
        size, length = rng.randrange(4, 20), 20
        place = rng.randrange(0, length - size + 1)
        windows = rng.randrange(1, place + 2)
        # each window holds the owner
        first = max(0, place + size - length)
        context = bytes(rng.randrange(256) for _ in range(place - first + length))[: windows - 1 + length]
        place -= first
        if place + size > length or windows - 1 > place:
            continue
        todo, seen = [(context[place : place + size], size, place, context, 0)], []
        while todo:
            own, n, at, part, lo = todo.pop()
            assert part[at : at + n] == own and all(at - w >= 0 and at - w + n <= length for w in range(len(part) - length + 1))
            if n == length:
                assert len(part) == length
                seen.append((lo, part))
            else:
                todo += [(o, m, q, x, lo + y) for o, m, q, x, y in repeats.halves(n, at, part, length)]
        assert sorted(seen) == [(i, context[i : i + length]) for i in range(len(context) - length + 1)]


def test_shard_of_many_batches():
    rng = random.Random(3)
    shard, rows = repeats.Shard(20, 64), []
    for owner in range(3):
        stock = bytes(rng.choice(b"xyz") for _ in range(400))
        for i in sorted({stock[(a := rng.randrange(340)) : a + rng.randrange(20, 60)] for _ in range(12)}):
            rows += [(owner, i, rng.choice((1, 1, 2)))] * rng.choice((1, 1, 2))
    for number, (owner, piece, n) in enumerate(rows):
        shard.add(owner, piece, n, 7, number, 0)
    got = sorted((r["run"], i) for r in shard.answer().to_pylist() for i in range(r["lo"], r["hi"] + 1))
    want = []
    for number, (owner, piece, _) in enumerate(rows):
        seen = Counter()
        for o, p, n in rows:
            if o == owner:
                for i in range(len(p) - 19):
                    seen[p[i : i + 20]] += n
        want += [(number, i) for i in range(len(piece) - 19) if seen[piece[i : i + 20]] > 1]
    assert got == sorted(want)


def test_equal_hashes_are_not_equal_texts(spark):
    rows = list(enumerate(colliding()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeats.remove_repeats(docs)) == plain(rows)
    assert got(repeats.remove_repeats(docs, hot=1)) == plain(rows)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(catalog.op7_long_repeats(spark, sf)) == plain(rows)
