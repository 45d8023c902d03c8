"""Texts that a polynomial hash modulo 2**64 can't tell apart.

The signs of the Thue-Morse sequence make a sum of 64 powers of an odd base
divisible by a high power of two; of many sums of four shifted copies two are
equal modulo what is left.
"""

import numpy as np

BASE = 0x9E3779B97F4A7C15


def colliding(letter: str = "m") -> tuple[str, str]:
    """Two texts of 200 letters with equal sums of byte x BASE^i modulo 2**64."""
    signs = np.array([(-1) ** bin(i).count("1") for i in range(64)])
    factor = sum(int(s) * pow(BASE, i, 1 << 64) for i, s in enumerate(signs)) % (1 << 64)
    free = 64 - ((factor & -factor).bit_length() - 1)
    powers = np.array([pow(BASE, i, 1 << 64) for i in range(136)], np.uint64)
    four = np.sort(np.random.default_rng(1).integers(0, 136, (1 << 22, 4)), axis=1)
    sums = powers[four].sum(axis=1, dtype=np.uint64) & np.uint64((1 << free) - 1)
    order = np.argsort(sums, kind="stable")
    for i in np.flatnonzero(sums[order][1:] == sums[order][:-1]):
        shift = np.zeros(136, int)
        np.add.at(shift, four[order[i]], 1)
        np.add.at(shift, four[order[i + 1]], -1)
        if shift.any():
            break
    other = np.full(200, ord(letter))
    other[:199] += np.convolve(shift, signs)
    one, two = letter * 200, bytes(other.tolist()).decode()
    value = lambda s: sum(ord(ch) * pow(BASE, i, 1 << 64) for i, ch in enumerate(s)) % (1 << 64)
    assert one != two and value(one) == value(two) and two.isalpha() and two.islower()
    return one, two
