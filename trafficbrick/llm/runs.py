"""Vectorised character runs over Arrow string columns (numpy inside tasks).

Texts are handled in parts of bounded size. A text longer than a part is cut
before a blank that follows a word character; no run, word or pretoken crosses
such a place, so cutting there changes no result.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa

from .wordhash import mix, slices, splitmix, text_bytes

PART = 1 << 20
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_CUT = re.compile(r"(?<=\w) ")
_LONG = 256
_POW = splitmix(_LONG, 37) | np.uint64(1)
# Code points with the Unicode property White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class Part(NamedTuple):
    """Rows ``lo..hi-1`` of a batch (one row, or a stretch of it, when it is long)."""
    lo: int
    hi: int
    text: str
    points: np.ndarray      # code points of ``text``
    offsets: np.ndarray     # of the rows in ``points``, hi - lo + 1


@functools.cache
def classes() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    kinds = np.frombuffer(bytes({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
                                for c in range(sys.maxunicode + 1)), dtype=np.uint8).copy()
    kinds[_WHITE] = SPACE
    return kinds


@functools.cache
def lower() -> np.ndarray:
    """Lower-case code point of each code point (itself where that is no single one)."""
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c).lower()
        if len(x) == 1:
            out[c] = ord(x)
    return out


def parts(column: pa.Array, limit: int = PART) -> Iterator[Part]:
    data, offs = text_bytes(column)
    for i, j in slices(offs, limit):
        text = data[offs[i]:offs[j]].tobytes().decode()
        if len(text) <= limit or j - i > 1:
            points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            # bytes that start a character tell the rows' places in code points
            heads = np.r_[0, np.cumsum((data[offs[i]:offs[j]] & 0xC0) != 0x80)]
            yield Part(i, j, text, points, heads[offs[i:j + 1] - offs[i]].astype(np.int64))
            continue
        at = 0
        while at < len(text):
            m = _CUT.search(text, at + limit)
            end = m.start() if m else len(text)
            points = np.frombuffer(text[at:end].encode("utf-32-le"), dtype=np.uint32)
            yield Part(i, j, text[at:end], points, np.array([0, len(points)], dtype=np.int64))
            at = end


def run_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``points[start:end]`` (runs in order, not overlapping, not empty)."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    lens = end - start
    at = np.cumsum(lens) - lens
    body = points if lens.sum() == len(points) else points[np.arange(lens.sum()) + np.repeat(start - at, lens)]
    pos = np.arange(len(body)) - np.repeat(at, lens)
    np.minimum(pos, _LONG - 1, out=pos)
    h = np.add.reduceat((body.astype(np.uint64) + np.uint64(1)) * _POW[pos], at) + lens.astype(np.uint64)
    for k in np.flatnonzero(lens > _LONG):
        digest = hashlib.blake2b(points[start[k]:end[k]].tobytes(), digest_size=8).digest()
        h[k] = np.uint64(int.from_bytes(digest, "little"))
    return mix(h)


def run_sums(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of place-weighted code points of all runs, and where each run begins in them.

    ``sums[place + k] - sums[place]`` tells the first ``k`` characters of a run.
    """
    lens = end - start
    at = np.cumsum(lens) - lens
    pos = np.arange(lens.sum()) - np.repeat(at, lens)
    body = points[pos + np.repeat(start, lens)].astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(body) + 1, dtype=np.uint64)
    # places beyond the table weigh by another rule, so that long runs differ as well
    far = pos >= _LONG
    np.cumsum(body * np.where(far, mix(pos.astype(np.uint64)) | np.uint64(1), _POW[np.minimum(pos, _LONG - 1)]), out=sums[1:])
    return sums, at


def pretokens(part: Part, special: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the byte-level pretokens of a part, and which of them are ``special``.

    The split is that of the published pattern: contractions, runs of letters,
    of numbers or of other signs, each with one blank before it, and white space.
    """
    p, n = part.points, len(part.points)
    edge = np.zeros(n + 3, dtype=bool)
    edge[part.offsets] = True
    edge[n:] = True
    marks, at = [], part.text.find(special) if special else -1
    while at >= 0:
        if not edge[at + 1:at + len(special)].any():
            marks.append(at)
        at = part.text.find(special, at + len(special) if marks and marks[-1] == at else at + 1)
    marks = np.array(marks, dtype=np.int64)
    edge[marks] = True
    edge[marks + len(special)] = True
    kind = classes()[p]
    head = edge[:n].copy()
    head[1:] |= kind[1:] != kind[:-1]
    a = np.flatnonzero(head)
    b = np.r_[a[1:], n]
    # white space before something else gives its last character away: a blank to what follows
    white = (kind[a] == SPACE) & ~edge[b] if n else np.zeros(0, dtype=bool)
    last = b[white] - 1
    head[last] = True
    head[b[white][p[last] == 0x20]] = False
    # contractions: an apostrophe of its own before s, t, m, d, re, ve or ll
    lone = a[(p[a] == 0x27) & (b - a == 1) & head[a] & ~edge[a + 1]]
    q = np.r_[p, 0, 0, 0]
    one, two = q[lone + 1], q[lone + 2]
    long = ~edge[lone + 2] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
    short = np.isin(one, [115, 116, 109, 100])
    for which, size in ((short, 2), (long, 3)):
        head[lone[which] + 1] = False
        after = lone[which] + size
        head[after[after < n]] = True
    for m in marks:
        head[m + 1:m + len(special)] = False
    start = np.flatnonzero(head)
    return start, np.isin(start, marks)
