"""Whole batches of texts as numpy arrays: words, hashes and n-grams without a Python object for each word.

A word is a run of bytes other than 0x20 and 0x09-0x0D, known by 128 bits: by
its own bytes, A-Z lower-cased, where they are 16 at most, else by their
BLAKE2. Words of up to 16 bytes so differ whenever their bytes do. Two hashes
of a word are the two halves of a permutation of these 128 bits, and whatever
is made of words has two hashes, one from each half.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: By a number of bytes from 0 to 8: the bits of so many.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
#: Weights of words in a sequence, for each of the two hashes.
_WEIGHTS = (0xD1342543DE82EF95, 0xA0761D6478BD642F)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


#: Separators for matching words whatever their punctuation: white space and the ASCII marks.
MARKS = _WS.copy()
MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Texts:
    """UTF-8 bytes of an Arrow string column; null texts are empty. `separators`: a mask of the 256 bytes that stand between words."""

    def __init__(self, column: pa.Array, separators: np.ndarray = _WS):
        self.separators = separators
        col = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = col.buffers()
        off = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = raw[off[0] : off[-1]]
        self.bounds = off - off[0]
        self.n = len(col)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def words(self) -> None:
        """Set start, end (byte positions) and first (per text: index of its first word, and one more at the end)."""
        black = ~self.separators[self.data]
        n = len(black)
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        start = black.copy()
        start[1:] &= ~black[:-1] | edge[1:n]
        end = black.copy()
        end[:-1] &= ~black[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        self.counts = np.diff(self.first)

    def identities(self) -> tuple[np.ndarray, np.ndarray]:
        """The 128 bits of each word in two halves."""
        if not hasattr(self, "start"):
            self.words()
        low = np.concatenate([_LOWER[self.data], np.zeros(16, np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(low, 8)
        size = self.end - self.start
        one = eight[self.start].view(U).ravel() & _FIRST[np.minimum(size, 8)]
        two = eight[self.start + 8].view(U).ravel() & _FIRST[np.clip(size - 8, 0, 8)]
        self.head = one.copy()
        long = size > 16
        zeros = np.flatnonzero(low[: len(self.data)] == 0)
        if len(zeros):
            # a zero byte can't be told from none
            long[np.searchsorted(self.start, zeros, side="right") - 1] = True
        at = np.flatnonzero(long)
        if len(at):
            raw = low.tobytes()
            digests = b"".join([hashlib.blake2b(raw[a:z], digest_size=16).digest() for a, z in zip(self.start[at].tolist(), self.end[at].tolist())])
            one[at], two[at] = np.frombuffer(digests, U).reshape(-1, 2).T
        self.one, self.two = one, two
        return one, two

    def word_hashes(self) -> np.ndarray:
        """The first hash of each word; the second goes to self.second, the 128 bits to self.one and self.two."""
        one, two = self.identities()
        one = one ^ mix(two + U(0x632BE59BD9B4E019))
        two = two ^ mix(one + U(0x8CB92BA72F3D8DD7))
        self.second = mix(two)
        return mix(one)

    def prefix_hashes(self, size: int) -> np.ndarray:
        """A hash of each word's first `size` bytes (8 at most), after word_hashes()."""
        return mix((self.head & _FIRST[size]) + U(0x5851F42D4C957F2D))

    def owners(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(self.n), self.counts)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes of k consecutive words within a text, and the owners; a text of fewer words gives its whole sequence as one, one without words none."""
        first = self.word_hashes()
        owner = self.owners()
        n = len(first)
        if not n:
            return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
        left = self.first[1:][owner] - np.arange(n)
        short = (self.counts < k) & (self.counts > 0)
        keep = left >= k
        keep[self.first[:-1][short]] = True
        out = []
        for words, weight in zip((first, self.second), _WEIGHTS):
            h = np.zeros(n, U)
            for j in range(min(k, n)):
                h[: n - j] += words[j:] * U(pow(weight, j + 1, 1 << 64))
            h = mix(h)
            for b, c in zip(self.first[:-1][short], self.counts[short]):
                v = sum(int(words[b + j]) * pow(weight, j + 1, 1 << 64) for j in range(c)) + int(c) * 0x5851F42D4C957F2D
                h[b] = mix(np.array([v & (1 << 64) - 1], U))[0]
            out.append(h[keep])
        return *out, owner[keep]


def distinct_per_owner(one: np.ndarray, two: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's distinct pairs of hashes, ascending by the first, and the bounds of each owner's run."""
    order = np.argsort(one, kind="stable")
    order = order[np.argsort(owner[order].astype(np.uint32 if n > 65535 else np.uint16), kind="stable")]
    one, two, owner = one[order], two[order], owner[order]
    if len(one):
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (owner[1:] != owner[:-1])
        one, two, owner = one[new], two[new], owner[new]
    return one, two, np.searchsorted(owner, np.arange(n + 1))
