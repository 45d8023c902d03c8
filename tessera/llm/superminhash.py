"""SuperMinHash signatures of whole batches of sets in numpy.

Element e sends the value j + u(e, j) to register p_e(j), for j = 0, 1, ...,
where p_e is a permutation of the registers that belongs to e, and a register
keeps the smallest value it gets. Values of step j lie between j and j + 1, so
once every register of a set has a value, later steps can't change it and the
set stops early: one of n elements after about REGISTERS x log(REGISTERS) / n
steps. The permutations are four Feistel rounds over two half bytes whose
round functions are the sixteen half bytes of a hash of e.
"""

from __future__ import annotations

import numpy as np

from .bytesops import U, mix

REGISTERS = 256
_NONE = U(0xFFFFFFFFFFFFFFFF)


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, REGISTERS) 64-bit registers; h holds the sets' element hashes one set after another. Empty sets have all registers unset."""
    n = len(bounds) - 1
    out = np.full((n, REGISTERS), _NONE, U)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    keys = [mix(h + U((0x632BE59BD9B4E019 * (i + 1)) % (1 << 64))) for i in range(4)]
    e = h
    open_sets = sizes > 0
    four, low = U(4), U(15)
    for j in range(REGISTERS):
        left, right = U(j >> 4), U(j & 15)
        for k in keys:
            left, right = right, left ^ ((k >> (right * four)) & low)
        register = (left * U(16) + right).astype(np.int64)
        value = mix(e ^ U((0xA0761D6478BD642F * (j + 1)) % (1 << 64))) >> U(1)
        step = np.full(n * REGISTERS, _NONE, U)
        np.minimum.at(step, owner * REGISTERS + register, value)
        step = step.reshape(n, REGISTERS)
        free = out == _NONE
        out[free] = step[free]
        left_open = (out == _NONE).any(axis=1) & open_sets
        if not left_open.any():
            break
        if left_open.sum() < open_sets.sum():
            stay = left_open[owner]
            owner, e, keys = owner[stay], e[stay], [k[stay] for k in keys]
            open_sets = left_open
    return out


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """(sets, REGISTERS // rows) keys: sets agree in one where they agree in `rows` registers."""
    bands = REGISTERS // rows
    out = np.zeros((len(registers), bands), U)
    cut = registers[:, : bands * rows].reshape(len(registers), bands, rows)
    for r in range(rows):
        out = mix(out + cut[:, :, r] * U(0x9E3779B97F4A7C15 + 2 * r))
    return mix(out + np.arange(bands, dtype=np.uint64) * U(0xD1342543DE82EF95))
