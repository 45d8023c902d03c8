"""Token counts by prefix dynamic programming over a public BPE vocabulary.

A sequence of BPE tokens is what the merges give exactly when every two
neighbours are, so the last token of a prefix and its token count follow from
shorter prefixes: the last token t of word[:i] is the one whose predecessor,
the last token of word[:i - len(t)], may stand before it. One pass over a word
gives the count at each of its prefixes; the counts of a text's prefixes are
sums over its words. Nothing is encoded a second time to answer where a text
must be cut for a budget.

The vocabulary's word form (merges, end-of-word suffix, byte alphabet) is read
from its JSON file; normaliser and word splitting are the library's own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Chunks and words whose counts a worker keeps; beyond it the store is emptied. Only time depends on it.
KEPT = 1_000_000
NEVER = 1 << 60


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts at prefixes for a `tokenizers` JSON file with a BPE model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.parts = {}
        for a, b in pairs:
            self.parts.setdefault(a + b, (a, b))
        self.vocab = model["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        pieces = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(pieces[0]["pattern"]["Regex"])
        self.bytes = byte_alphabet()
        self.words: dict[str, int] = {}
        self.chunks: dict[bytes, int] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.right: dict[str, list] = {}
        self.left: dict[str, list] = {}
        self.plant()

    def merged(self, symbols: tuple[str, ...]) -> tuple[str, ...]:
        """What the merges make of the symbols, lowest rank first and from the left."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), NEVER))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(parts)

    def symbols(self, token: str) -> tuple[str, ...]:
        """A token's single symbols; the end-of-word suffix belongs to the last."""
        if self.suffix and token.endswith(self.suffix):
            body = token.removesuffix(self.suffix)
            return (*body[:-1], body[-1] + self.suffix)
        return tuple(token)

    def edge(self, token: str, side: int, store: dict[str, list]) -> list[tuple[str, int, int]]:
        """The pieces at one edge of a token as its merges go on: (piece, rank that made it, rank that used it up)."""
        out, used = [], NEVER
        piece = token
        while piece:
            made = self.rank[self.parts[piece]] if piece in self.parts else -1
            out.append((piece, made, used))
            used = made
            piece = self.parts[piece][side] if piece in self.parts else ""
        store[token] = out
        return out

    def fits(self, left: str, right: str) -> bool:
        """Whether the merges leave these two tokens side by side: no merge across them comes before both are complete."""
        for a, made_a, used_a in self.right.get(left) or self.edge(left, 1, self.right):
            for b, made_b, used_b in self.left.get(right) or self.edge(right, 0, self.left):
                r = self.rank.get((a, b))
                # of equal ranks the leftmost merges first
                if r is not None and r < used_a and r <= used_b and made_a < used_b and made_b < used_a:
                    return False
        return True

    def plant(self) -> None:
        """Two tries of reversed tokens that the merges can make: those inside a word, and those that close it."""
        self.inner, self.closing = {}, {}
        for t in self.vocab:
            closes = bool(self.suffix) and t.endswith(self.suffix) and t != self.suffix
            if t in self.special or self.merged(self.symbols(t)) != (t,):
                continue
            node = self.closing if closes else self.inner
            for ch in reversed(t.removesuffix(self.suffix) if closes else t):
                node = node.setdefault(ch, {})
            node[""] = t
        if not self.suffix:
            self.closing = self.inner

    def _last(self, shown: str, i: int, lasts: list[str], node: dict) -> tuple[str, int]:
        """The last token of shown[:i], among those in a trie, and where it begins."""
        pairs = self.pairs
        at = i
        # at most one token fits, so the order of the search is free
        while at:
            at -= 1
            node = node.get(shown[at])
            if node is None:
                break
            t = node.get("")
            if t is None:
                continue
            if not at:
                return t, 0
            key = lasts[at], t
            fit = pairs.get(key)
            if fit is None:
                if len(pairs) > KEPT:
                    pairs.clear()
                fit = pairs[key] = self.fits(*key)
            if fit:
                return t, at
        raise ValueError(f"no token ends at {i} of {shown!r}")

    def word(self, shown: str) -> list[int]:
        """Token counts of shown[:1], shown[:2], ..., each as a whole word, where shown is a word in the byte alphabet."""
        lasts, counts, out = [""], [0], []
        for i in range(1, len(shown) + 1):
            t, at = self._last(shown, i, lasts, self.inner)
            lasts.append(t)
            counts.append(counts[at] + 1)
            out.append(counts[self._last(shown, i, lasts, self.closing)[1]] + 1)
        return out

    def word_count(self, shown: str) -> int:
        """Token count of a whole word in the byte alphabet: its open prefixes, then the closing token."""
        lasts, counts, last, inner = [""], [0], self._last, self.inner
        for i in range(1, len(shown)):
            t, at = last(shown, i, lasts, inner)
            lasts.append(t)
            counts.append(counts[at] + 1)
        return counts[last(shown, len(shown), lasts, self.closing)[1]] + 1

    def split(self, part: str) -> list[str]:
        """Words of a stretch in the byte alphabet. Beyond ASCII the library splits, as its tables of letters are of a Unicode version of its own."""
        if not part.isascii():
            return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))]
        words = self.pattern.findall(part.lower())
        return words if part.isprintable() else ["".join([self.bytes[b] for b in w.encode()]) for w in words]

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of a text: plain, or an added token of the vocabulary."""
        at = 0
        if self.split_special:
            for m in self.split_special.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], False
                yield m.group(), True
                at = m.end()
        if at < len(text):
            yield text[at:], False

    def chunk(self, raw: bytes) -> int:
        """Tokens of a stretch without white space. Neither words nor added tokens contain white space, and normalising doesn't reach across it, so chunks add up."""
        n = 0
        for part, special in self.pieces(raw.decode()):
            if special:
                n += 1
                continue
            for w in self.split(part):
                k = self.words.get(w)
                if k is None:
                    if len(self.words) > KEPT:
                        self.words.clear()
                    k = self.words[w] = self.word_count(w)
                n += k
        return n

    def prefixes(self, raw: bytes) -> np.ndarray:
        """Token count of the text up to the end of each of its white-space separated chunks."""
        found = raw.split()
        known = self.chunks
        counts = list(map(known.get, found))
        if None in counts:
            if len(known) > KEPT:
                known.clear()
            for i, k in enumerate(counts):
                if k is None:
                    w = found[i]
                    if w not in known:
                        known[w] = self.chunk(w)
                    counts[i] = known[w]
        return np.cumsum(np.array(counts, np.int64))

    def total(self, text: str) -> int:
        """Tokens of a whole text, as the library's encode without begin and end tokens gives them."""
        p = self.prefixes(text.encode())
        return int(p[-1]) if len(p) else 0


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary in a worker process."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, chunks_within (white-space separated chunks that fit in `limit` tokens), and with `prefixes` the array of counts at every chunk end.

    docs needs doc_id and text; other columns are ignored. Null texts are
    empty: 0 bytes, 0 tokens. Each row is counted by itself, so repeated rows
    and null ids give a row each. `path` must be readable on all executors.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chunks_within long" + (", prefix_counts array<int>" if prefixes else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in slices(batches):
            rows = []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                raw = raw or b""
                p = c.prefixes(raw)
                n = int(p[-1]) if len(p) else 0
                fit = len(p) if n <= limit else int(np.searchsorted(p, limit, side="right"))
                rows.append((len(raw), n, n > limit, fit) + ((p.astype(np.int32),) if prefixes else ()))
            cols = list(zip(*rows))
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32())]
            names = ["n_bytes", "n_tokens", "over_limit", "chunks_within", "prefix_counts"][: len(cols)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(cols, types))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, schema)
