"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over byte n-grams, packed into one long each. Its counts are a
table with a row for each n-gram of all trusted texts; the counts of lower
orders are continuation counts, each from the table above it. Texts ask for
the distinct n-grams of a block of rows; the questions are joined with the
count tables order by order, every table sharded by n-gram or context, and the
answers go back to the block, where each text's log probabilities are summed.
No task holds the model. A document is rejected if its perplexity is above a
quantile, times a margin, of trusted texts of its language that were kept aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import Texts, U
from .common import PLACE, discard, in_blocks, materialise, placed, slices, without

ORDER = 4
QUANTILE = 0.995
MARGIN = 1.0
#: One of so many folds of the trusted texts sets the line and is not counted.
FOLDS = 5
#: Distinct n-grams a counting task holds before it lets them go.
HELD = 1 << 20
BLOOM_BITS = 1 << 26
#: Bytes of a text that asks for itself. Shorter ones share their n-grams with a block, whose texts stay compressed but for a slice.
LONG_BYTES = 1 << 18
#: Bytes of text in hand at a time; counting n-grams takes some ten arrays of eight times that.
SLICE = 1 << 19


def packed(texts: Texts, order: int) -> np.ndarray:
    """The n-gram that ends at each byte; bytes before a text count as 0."""
    n = len(texts.data)
    out = np.zeros(n, U)
    begin = np.repeat(texts.bounds[:-1], texts.sizes)
    place = np.arange(n) - begin
    for j in range(order - 1, -1, -1):
        part = np.zeros(n, U)
        if j < n:
            part[j:] = texts.data[: n - j]
        if j:
            part[place < j] = 0
        out = (out << U(8)) | part
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate([p[i] for p in parts]) for i in range(2))
    u, inverse = np.unique(codes, return_inverse=True)
    return u, np.bincount(inverse, counts, len(u)).astype(np.int64)


def raw_counts(texts: DataFrame, order: int) -> DataFrame:
    """gram, n over all texts (one column, text); each task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []

        def out() -> pa.RecordBatch:
            u, c = _merge(parts)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["gram", "n"])

        for b in slices(batches, limit=SLICE):
            parts.append(np.unique(packed(Texts(b.column(0)), order), return_counts=True))
            if len(parts) >= 32:
                merged = _merge(parts)
                parts[:] = [merged]
                if len(merged[0]) > HELD:
                    yield out()
        if parts:
            yield out()

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Of rows (doc_id, text) those whose id may be among ids (trusted_id): a Bloom filter of BLOOM_BITS bits at most, however many ids there are. It saves the others the way through a join and decides nothing."""
    places = lambda c: F.array(*[F.pmod(F.xxhash64(F.lit(i), c.cast("long")), F.lit(BLOOM_BITS)) for i in (1, 2, 3)])
    bits = ids.select(F.explode(places(F.col("trusted_id"))).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    held = np.zeros(BLOOM_BITS // 64, np.int64)
    for r in bits.collect():
        held[r["word"]] = r["bits"]
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            p = b.column(2).flatten().to_numpy().reshape(-1, 3)
            hit = ((words[p >> 6] >> (p & 63)) & 1).all(axis=1)
            yield b.select([0, 1]).filter(pa.array(hit))

    known = rows.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", places(F.col("doc_id")).alias("places"))
    return known.mapInArrow(run, "doc_id long, text string")


def _low(gram: Column, order: int) -> Column:
    """The last order - 1 bytes."""
    return gram.bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many n-grams occur one to four times; kept inside (0, 1), (0, 2), (0, 3) where a table is too small to tell."""
    seen = {r["n"]: r["count"] for r in counts.filter("n <= 4").groupBy("n").count().collect()}
    n = [seen.get(i, 0) for i in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i * 0.5
        out.append(min(max(d, 0.1 * i), 0.95 * i))
    return tuple(out)


class Model:
    """Count tables of all orders in the shared folder, and their discounts."""

    def __init__(self, texts: DataFrame, order: int = ORDER):
        self.order = order
        self.tables: dict[int, DataFrame] = {order: materialise(raw_counts(texts, order))}
        for k in range(order - 1, 0, -1):
            self.tables[k] = materialise(self.tables[k + 1].groupBy(_low(F.col("gram"), k + 1).alias("gram")).agg(F.count("*").alias("n")))
        self.discounts = {k: discounts(t) for k, t in self.tables.items()}

    def taken(self, k: int) -> Column:
        """The discount of a row of order k."""
        d = self.discounts[k]
        return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])

    def probabilities(self, asked: DataFrame, k: int | None = None) -> DataFrame:
        """(gram) distinct to (gram, p): each order's discounted share plus what it leaves to the order below."""
        k = self.order if k is None else k
        if k == 0:
            return asked.select("gram", F.lit(1 / 256).alias("p"))
        asked = materialise(asked)
        below = self.probabilities(asked.select(_low(F.col("gram"), k).alias("gram")).distinct(), k - 1).select(F.col("gram").alias("low"), F.col("p").alias("p_low"))
        table = self.tables[k]
        context = F.shiftrightunsigned("gram", 8)
        contexts = table.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(self.taken(k)).alias("left"))
        own = table.select(F.col("gram").alias("own"), "n")
        out = asked.select("gram").join(own, F.col("gram") == F.col("own"), "left").withColumn("h", context)
        out = out.join(contexts, F.col("h") == F.col("context"), "left").join(below, _low(F.col("gram"), k) == F.col("low"))
        share = F.when(F.col("n").isNull(), 0.0).otherwise(F.greatest(F.col("n") - self.taken(k), F.lit(0.0)))
        return out.select("gram", F.when(F.col("total").isNull(), F.col("p_low")).otherwise((share + F.col("left") * F.col("p_low")) / F.col("total")).alias("p"))

    def discard(self) -> None:
        for t in self.tables.values():
            discard(t)


def _asked(docs: DataFrame, order: int) -> DataFrame:
    """block, gram: the distinct n-grams of each block, once for each task that reads of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(block: int) -> pa.RecordBatch:
            u = np.unique(np.concatenate(held.pop(block)))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), block, np.int64)), pa.array(u.view(np.int64))], names=["block", "gram"])

        for b in slices(batches, limit=SLICE):
            blocks = b.column(2).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
            for a, z in zip(edges, [*edges[1:], len(blocks)]):
                block = int(blocks[a])
                for other in [x for x in held if x != block]:
                    yield out(other)
                held.setdefault(block, []).append(np.unique(packed(Texts(b.column(1).slice(a, z - a)), order)))
                if len(held[block]) >= 16:
                    held[block] = [np.unique(np.concatenate(held[block]))]
        for block in list(held):
            yield out(block)

    return docs.mapInArrow(run, "block long, gram long")


def _packets(docs: DataFrame) -> DataFrame:
    """block, ids, langs, files, rows, sizes, texts: the rows of a block with their language and PLACE, their texts compressed for the way to its answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in slices(batches, limit=SLICE):
            blocks = b.column(2).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
            rows = []
            for a, z in zip(edges, [*edges[1:], len(blocks)]):
                t = Texts(b.column(1).slice(a, z - a))
                rows.append((int(blocks[a]), *[b.column(c).slice(a, z - a).to_pylist() for c in ("doc_id", "lang", *PLACE)], t.sizes.tolist(), squeeze.compress(t.data.tobytes())))
            cols = list(zip(*rows))
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.list_(pa.int64())] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["block", "ids", "langs", "files", "rows", "sizes", "texts"])

    return docs.mapInArrow(run, "block long, ids array<long>, langs array<string>, files array<long>, rows array<long>, sizes array<long>, texts binary")


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, PLACE, n_bytes, perplexity (null without text) of placed() rows, so that a block is the same rows at each reading."""
    order = model.order
    own = in_blocks(docs, F.col("lang").cast("string").alias("lang"), *PLACE, long_bytes=LONG_BYTES)
    asked = materialise(_asked(own.select("doc_id", "text", "block"), order))
    known = model.probabilities(asked.select("gram").distinct()).select(F.col("gram").alias("known"), F.log("p").alias("lp"))
    answers = asked.join(known, F.col("gram") == F.col("known")).select("block", "gram", "lp")

    def run(packets: pa.Table, answers: pa.Table) -> pa.Table:
        grams, lp = answers.column("gram").to_numpy().view(U), answers.column("lp").to_numpy()
        # a block that two tasks read asks twice; the answers are the same
        order_ = np.argsort(grams)
        grams, lp = grams[order_], lp[order_]
        expand = zstandard.ZstdDecompressor()
        ids, langs, files, rows, sizes, sums = [], [], [], [], [], []
        for packet in packets.to_batches():
            for i, raw in enumerate(packet.column("texts").to_pylist()):
                n = np.array(packet.column("sizes")[i].as_py(), np.int64)
                data = expand.decompress(raw) if n.sum() else b""
                bounds = np.concatenate([[0], np.cumsum(n)])
                t = Texts(pa.array([], pa.string()))
                t.data, t.bounds, t.n = np.frombuffer(data, np.uint8), bounds, len(n)
                total = np.zeros(len(data) + 1)
                if len(data):
                    np.cumsum(lp[np.searchsorted(grams, packed(t, order))], out=total[1:])
                for held, c in ((ids, "ids"), (langs, "langs"), (files, "files"), (rows, "rows")):
                    held += packet.column(c)[i].as_py()
                sizes.append(n)
                sums.append(total[bounds[1:]] - total[bounds[:-1]])
        n, s = np.concatenate(sizes or [np.zeros(0, np.int64)]), np.concatenate(sums or [np.zeros(0)])
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            p = np.exp(-s / n)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "_tessera_file": pa.array(files, pa.int64()), "_tessera_row": pa.array(rows, pa.int64()), "n_bytes": pa.array(n), "perplexity": pa.array(p, mask=n == 0)})

    return _packets(own).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, lang string, _tessera_file long, _tessera_row long, n_bytes long, perplexity double")


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept.

    The trusted texts are those of docs whose label is 1. The model counts all
    but a fold of them (one of FOLDS, by hash of the id). The line is the
    quantile of this fold, which the model hasn't seen, or that of all trusted
    rows of the language if it is larger, as in a fold of a few rows; where all
    trusted rows are in the fold the model counts them too. Rows without text
    have no perplexity and are kept, as are rows of a language without trusted
    text where no language has any; a language that has none itself takes the
    largest threshold of the others. Repeated rows are judged alike; a null id
    is judged by its text. Other columns are ignored. docs that are not read
    from Parquet files are written to the shared folder first. The result is a table in the
    shared folder; the model is gone by then.
    """
    return _judge(placed(docs.select("doc_id", "text", "lang")), labels, label, order, quantile, margin).drop(*PLACE)


def _judge(docs: DataFrame, labels: DataFrame, label: str = "quality", order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """judge() of placed() rows, with PLACE last."""
    trusted_ids = labels.filter(F.col(label) == 1).select(F.col("doc_id").alias("trusted_id")).filter("trusted_id is not null").distinct().withColumn("aside", F.crc32(F.concat(F.lit("aside|"), F.col("trusted_id").cast("string")).cast("binary")) % FOLDS == 0)
    counted = trusted_ids.filter("not aside")
    if not counted.limit(1).count():
        counted = trusted_ids
    texts = _likely(docs.select("doc_id", "text"), counted).join(counted.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left_semi").select(F.coalesce("text", F.lit("")).alias("text"))
    model = Model(texts, order)
    named = materialise(perplexities(docs, model))
    trusted = named.join(trusted_ids, F.col("doc_id") == F.col("trusted_id")).filter("perplexity is not null")
    at = lambda c: F.percentile_approx(c, quantile, 10000) * margin
    lines = trusted.groupBy("lang").agg(F.greatest(at(F.when(F.col("aside"), F.col("perplexity"))), at(F.col("perplexity"))).alias("line"))
    widest = lines.agg(F.max("line").alias("widest"))
    out = named.join(lines.withColumnRenamed("lang", "line_lang"), F.col("lang").eqNullSafe(F.col("line_lang")), "left").crossJoin(F.broadcast(widest))
    out = out.withColumn("threshold", F.coalesce("line", "widest"))
    out = materialise(out.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"), *PLACE))
    model.discard()
    discard(named)
    return out


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that judge() keeps, with all their columns; each row goes by its own text."""
    docs = placed(docs)
    bad = _judge(docs, labels, **how).filter(~F.col("kept"))
    return without(docs, bad.select(PLACE).distinct())
