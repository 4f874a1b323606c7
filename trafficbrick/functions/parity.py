"""Seeded lookup tables for the ``parity`` hash family.

The tables are drawn from the C library's ``rand()`` stream (the additive
feedback generator of glibc's default ``random()``: 31-word state seeded by a
Lehmer recurrence, 310 discarded outputs, then ``r[i] = r[i-3] + r[i-31]``).
Their size is fixed by the hash width (2 x 65,536 + 131,072 entries plus a
131,072-entry bin map), never by the data, so they are safe to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from .hashing import BRICK_DIM, R17

# Fixed values of the generator: Lehmer multiplier and modulus, state length,
# feedback lags and the number of outputs discarded after seeding.
LEHMER_A = 16807
LEHMER_M = 2147483647
STATE_WORDS = 31
LAG_SHORT = 3
DISCARD = 310


def libc_rand(seed: int, n: int) -> np.ndarray:
    """First ``n`` outputs of ``rand()`` after ``srand(seed)`` (glibc TYPE_3)."""
    seed = seed or 1
    head = STATE_WORDS + LAG_SHORT          # r[0..30] seeded, r[31..33] copy r[0..2]
    total = head + DISCARD + n
    r = np.zeros(total, dtype=np.uint64)
    r[0] = seed
    for i in range(1, STATE_WORDS):
        r[i] = (LEHMER_A * int(r[i - 1])) % LEHMER_M
    r[STATE_WORDS:head] = r[:LAG_SHORT]
    # r[i] = r[i-31] + r[i-3] (mod 2^32); the lag-3 term allows 3 words per step
    mask = np.uint64(0xFFFFFFFF)
    i = head
    while i < total:
        j = min(i + LAG_SHORT, total)
        r[i:j] = (r[i - STATE_WORDS:j - STATE_WORDS] + r[i - LAG_SHORT:j - LAG_SHORT]) & mask
        i = j
    return (r[head + DISCARD:] >> np.uint64(1)).astype(np.int64)


@dataclass(frozen=True)
class ParityTables:
    t1: np.ndarray   # 65,536 entries, indexed by the low 16 bits
    t2: np.ndarray   # 65,536 entries, indexed by the high 16 bits
    t3: np.ndarray   # 131,072 entries, indexed by (lo + hi) & 131071
    bin_map: np.ndarray  # 131,072 entries: hash -> bin in [reserved, dim)
    reserved: int

    def hash17(self, ip: np.ndarray) -> np.ndarray:
        ip = np.asarray(ip, dtype=np.int64)
        lo, hi = ip & 65535, ip >> 16
        return self.t1[lo] ^ self.t2[hi] ^ self.t3[(lo + hi) & R17]


def parity_tables(seed: int, reserved: int, dim: int = BRICK_DIM) -> ParityTables:
    """Draw the tables in the native order: T1[i], T2[i], T3[i], T3[i+65536] for
    each i, then the 131,072-entry bin map."""
    half = 65536
    draws = libc_rand(seed, 4 * half + 2 * half)
    table_draws = draws[:4 * half].reshape(half, 4) % R17
    t1, t2 = table_draws[:, 0].copy(), table_draws[:, 1].copy()
    t3 = np.concatenate([table_draws[:, 2], table_draws[:, 3]])
    bin_map = reserved + draws[4 * half:] % (dim - reserved)
    return ParityTables(t1, t2, t3, bin_map, reserved)
