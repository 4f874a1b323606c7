"""Vectorised words and rolling hashes over Arrow string columns (numpy inside tasks).

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Texts are handled
in slices of bounded size, so memory does not follow the size of an Arrow batch.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
_LONG = 256
_U = np.uint64


def splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    return mix((np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) ^ _U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_T = splitmix(256, 11)
_POW = splitmix(_LONG, 23) | _U(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the ``n + 1`` offsets of a string column (null: empty)."""
    a = pc.fill_null(column.cast(pa.large_string()), "")
    offs = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset:a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (a longer text stands alone)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Words:
    """The words of some texts: byte ranges ``start``/``end``, ``first[k]:first[k+1]`` those of text k."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data = data
        n = len(data)
        inside = ~_SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offs)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        out = np.empty(len(self.start), dtype=_U)
        lens = self.end - self.start
        cum = np.cumsum(lens)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(cum, (cum[i - 1] if i else 0) + SLICE_BYTES, "right")))
            ln = lens[i:j]
            body = self.data[self.start[i]:self.end[j - 1]][self.inside[self.start[i]:self.end[j - 1]]]
            at = np.cumsum(ln) - ln
            pos = np.arange(len(body)) - np.repeat(at, ln)
            np.minimum(pos, _LONG - 1, out=pos)
            out[i:j] = np.add.reduceat(_T[body] * _POW[pos], at) + ln.astype(_U) * _U(0xD6E8FEB86659FD93)
            i = j
        for k in np.flatnonzero(lens > _LONG):
            word = self.data[self.start[k]:self.end[k]].tobytes()
            out[k] = _U(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
        return mix(out)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and text of every run of ``size`` words within one text."""
        many = np.maximum(np.diff(self.first) - size + 1, 0)
        text = np.repeat(np.arange(len(many)), many)
        at = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + self.first[:-1][text]
        return at, text


def rolling(h: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hash of ``size`` consecutive word hashes, for every start (starts near the end included only if full)."""
    m = len(h)
    if m < size:
        return np.zeros(0, dtype=_U)
    base = (0x9E3779B97F4A7C15 * (2 * salt + 1) + 0x632BE59BD9B4E018) % (1 << 64) | 1
    inv = pow(base, -1, 1 << 64)
    up, down = np.full(m, base, dtype=_U), np.full(m, inv, dtype=_U)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    total = np.zeros(m + 1, dtype=_U)
    np.cumsum(h * up, out=total[1:])
    return mix((total[size:] - total[:-size]) * down[:m - size + 1] + _U(size))
