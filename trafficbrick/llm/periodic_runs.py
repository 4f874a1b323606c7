"""Periodic run detection by maximal pairs (operator 11).

A *run* is a stretch of consecutive words of one text with smallest period ``q``
(words ``q`` apart are equal) that holds at least ``exponent`` periods and
``size`` words, and that no neighbouring word extends keeping the period.

Method. A pair of places ``i < j`` whose next ``l`` words are equal, but neither
the words before nor those after them, is a *maximal pair*. One with distance
``q = j - i`` and ``l >= (exponent - 1) * q`` is exactly the stretch ``i .. j + l - 1``
of period ``q`` that cannot be extended, so nothing is left to extend. The pairs come
from the LCP-interval tree of the text's suffixes, bottom up: where subtrees meet at
an interval of ``l`` words, each place of the smaller one looks for places of the
larger one at a distance the constraints allow, among those of another left-word
class. Places of an interval that lie that close are spaced by the period of what
they share, and all but the first of a run have the same word on their left: so one
look at the leftmost, and one at the next on the right, passes over a whole class
list, and the work follows the number of places and runs.

Only suffixes that share at least ``size * (exponent - 1) / exponent`` words with
another of the same text can take part. These are found by a rolling hash, and only
the part of the tree over them is built: words are told apart by 64-bit hashes,
suffixes are sorted by doubling, their common lengths come from the same ranks.

Texts are independent rows: nothing is shuffled, and a task holds one slice of 2 MB
of text at a time (a longer text alone).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from functools import partial
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordhash import Words, mix, rolling, slices, text_bytes

SIZE = 24
EXPONENT = 3
_BLANKS = " \t\n\u000b\f\r"


def _dense(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in lexicographic order of ``columns``, and each row's dense rank in it."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=np.int64)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


class Suffixes:
    """The suffixes that share ``least`` words with another one of the same text, in
    lexicographic order, and the common length of each with the one before it.

    ``place``: their first words, ``common[k]``: words that ``place[k - 1]`` and
    ``place[k]`` share (0 where that is fewer than ``least``).
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray, least: int):
        self.place, self.common = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(hashes)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        many = np.maximum(np.diff(first) - least + 1, 0)
        owner = np.repeat(np.arange(len(many)), many)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[:-1][owner]
        if len(at) < 2:
            return
        key = mix(rolling(hashes, least, 5)[at] + mix(owner.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.r_[False, same] | np.r_[same, False]
        active = np.zeros(n, dtype=bool)
        active[at[order[twice]]] = True
        if not active.any():
            return
        # what follows the first ``least`` words must be in order as well: one step beyond takes part
        held = active.copy()
        held[least:] |= active[:-least] & (text[least:] == text[:-least])
        places = np.flatnonzero(held)
        where = np.full(n, -1, dtype=np.int64)
        where[places] = np.arange(len(places))
        words = np.unique(hashes, return_inverse=True)[1] + 1
        stop = first[1:][text]

        def word(p: np.ndarray, k: np.ndarray | int) -> np.ndarray:
            """Number of the word ``k`` places on (0 beyond the text)."""
            return np.where(p + k < stop[p], words[np.minimum(p + k, n - 1)], 0)

        def later(p: np.ndarray, step: int | np.ndarray) -> np.ndarray:
            """Where the suffix ``step`` words on is held (-1: nowhere)."""
            inside = p + step < stop[p]
            return np.where(inside, where[np.minimum(p + step, n - 1)], -1)

        # as many words as fit in one number
        fit = max(1, 62 // int(n + 1).bit_length())
        columns = [text[places]]
        for k in range(0, least, fit):
            packed = np.zeros(len(places), dtype=np.int64)
            for j in range(k, min(k + fit, least)):
                packed = packed * (n + 1) + word(places, j)
            columns.append(packed)
        order, rank = _dense(*columns)
        ranks, span = [rank], least
        while rank[order[-1]] + 1 < len(places):
            nxt = later(places, span)
            order, rank = _dense(rank, np.where(nxt >= 0, rank[nxt], -1))
            if (rank == ranks[-1]).all():
                break
            ranks.append(rank)
            span *= 2
        order = order[active[places[order]]]
        a, b = places[order[:-1]], places[order[1:]]
        shared = np.zeros(len(a), dtype=np.int64)
        for t in range(len(ranks) - 1, -1, -1):
            x, y = later(a, shared), later(b, shared)
            shared += np.where((x >= 0) & (y >= 0) & (ranks[t][x] == ranks[t][y]), least << t, 0)
        near = shared > 0
        for _ in range(least - 1):
            u, v = word(a[near], shared[near]), word(b[near], shared[near])
            more = (u == v) & (u > 0)
            near[near] = more
            shared[near] += 1
        self.place, self.common = places[order], np.r_[0, shared]
        # words may agree past what is held only where ranks differ, so lengths below ``least`` are none
        self.common[self.common < least] = 0


def _meet(a: list[int], b: list[int], l: int, left: np.ndarray, size: int, exponent: int, found: list) -> list[int]:
    """The places of two subtrees of an interval of ``l`` words, in order; their maximal
    pairs with distance ``q``, ``size - l <= q <= l / (exponent - 1)``, go to ``found``."""
    if len(a) > len(b):
        a, b = b, a
    reach, least = l // (exponent - 1), size - l
    for i in a:
        own = left[i]
        k = bisect_left(b, i - reach)
        if k < len(b) and b[k] < i and left[b[k]] != own and i - b[k] >= least:
            found.append((b[k], i - b[k] + l, i - b[k]))
        k = bisect_right(b, i, k)
        while k < len(b) and b[k] - i <= reach and left[b[k]] != own:
            if b[k] - i >= least:
                found.append((i, b[k] - i + l, b[k] - i))
            k += 1
    if len(a) * 8 < len(b):
        for i in a:
            insort(b, i)
    else:
        b.extend(a)
        b.sort()
    return b


def maximal_pairs(place: list[int], common: list[int], left, size: int, exponent: int) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the maximal pairs in one tree: suffixes in order and
    what each shares with the one before it."""
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []
    under = [place[0]]
    for p, l in zip(place[1:], common[1:]):
        while stack and stack[-1][0] >= l:
            above, held = stack.pop()
            under = _meet(held, under, above, left, size, exponent, found)
        stack.append((l, under))
        under = [p]
    while stack:
        above, held = stack.pop()
        under = _meet(held, under, above, left, size, exponent, found)
    return found


def runs_of(hashes: np.ndarray, first: np.ndarray, size: int, exponent: int) -> np.ndarray:
    """Rows ``text, start, length, period`` of all runs of some texts, in that order;
    ``hashes`` of all words, ``first[k]:first[k + 1]`` those of text ``k``; starts count from the text's first word."""
    least = -(-size * (exponent - 1) // exponent)
    s = Suffixes(hashes, first, least)
    found: list[tuple[int, int, int]] = []
    if len(s.place):
        left = np.zeros(len(hashes), dtype=np.uint64)
        left[1:] = hashes[:-1]
        starts = first[:-1][np.diff(first) > 0]
        # nothing is like what lies before a text: a class of its own (one place a text has it)
        lefts = dict(zip(s.place.tolist(), left[s.place].tolist()))
        for p in starts[np.isin(starts, s.place)].tolist():
            lefts[p] = None
        heads = np.flatnonzero(s.common == 0)
        tails = np.r_[heads[1:], len(s.common)]
        # a tree with no two places close enough for its longest common part has no run
        tree = np.repeat(np.arange(len(heads)), tails - heads)
        order = np.lexsort((s.place, tree))
        gap = np.full(len(order), np.iinfo(np.int64).max)
        gap[1:] = np.where(tree[order][1:] == tree[order][:-1], np.diff(s.place[order]), gap[1:])
        close = np.minimum.reduceat(gap, heads) * (exponent - 1) <= np.maximum.reduceat(s.common, heads)
        for a, b in zip(heads[close].tolist(), tails[close].tolist()):
            found += maximal_pairs(s.place[a:b].tolist(), s.common[a:b].tolist(), lefts, size, exponent)
    if not found:
        return np.zeros((0, 4), dtype=np.int64)
    pairs = np.array(found, dtype=np.int64)
    # a stretch is found with the multiples of its period too: the smallest is its own
    pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
    once = np.r_[True, (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)]
    pairs = pairs[once]
    text = np.searchsorted(first, pairs[:, 0], "right") - 1
    out = np.c_[text, pairs[:, 0] - first[text], pairs[:, 1], pairs[:, 2]]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    step = np.bincount(lo, minlength=n + 1)[:n + 1] - np.bincount(hi, minlength=n + 1)[:n + 1]
    return np.cumsum(step)[:n] > 0


def _without(w: Words, offs: np.ndarray, gone: np.ndarray) -> pa.Array:
    """The texts' words that are not ``gone``, joined by one blank."""
    many = np.diff(w.first)
    kept = np.flatnonzero(~gone)
    owner = np.repeat(np.arange(len(many)), many)[kept]
    mask = w.inside.copy()
    dead = np.flatnonzero(gone)
    if len(dead):
        mask &= ~_covered(w.start[dead], w.end[dead], len(mask))
    joint = w.end[kept[:-1]][owner[1:] == owner[:-1]]       # a blank follows each word but a text's last
    out = w.data.copy()
    out[joint] = 0x20
    mask[joint] = True
    ends = np.r_[0, np.cumsum(mask)][offs].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(many), pa.py_buffer(ends), pa.py_buffer(out[mask])).cast(pa.string())


def _run_batches(batches: Iterator[pa.RecordBatch], size: int, exponent: int) -> Iterator[pa.RecordBatch]:
    """In: rest, text. Out: rest, n_words, runs, text."""
    names = ["start", "length", "period"]
    for b in batches:
        data, offs = text_bytes(b.column(1))
        for i, j in slices(offs):
            own = offs[i:j + 1] - offs[i]
            w = Words(data[offs[i]:offs[j]], own)
            found = runs_of(w.hashes(), w.first, size, exponent)
            begin = found[:, 1] + w.first[found[:, 0]]
            gone = _covered(begin + found[:, 3], begin + found[:, 2], len(w))
            ends = np.searchsorted(found[:, 0], np.arange(j - i + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], names)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), pa.array(np.diff(w.first).astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), rows), _without(w, own, gone)], ["rest", "n_words", "runs", "text"])


def find_runs(docs: DataFrame, text_col: str = "text", size: int = SIZE, exponent: int = EXPONENT) -> DataFrame:
    """The runs of every whole text, and the text without their repetitions.

    Returns ``rest`` (a struct of all columns of ``docs`` but the text), ``n_words``,
    ``runs`` (``start`` as a word number from 0, ``length``, ``period``; by start, then
    period) and ``text``: the words that lie in no run after its first period, joined by
    one blank. One row for each row of ``docs``.

    ``exponent`` is a whole number from 3 on, ``size`` at least that. Null, empty or
    wordless text: no words, no runs, empty ``text``. Very long texts: memory follows
    the longest text of a task. Repeated rows, ids and texts are treated alike, row by
    row; no column but the text matters, so null ids are no special case. Runs that
    overlap are all returned. An empty table gives an empty result.
    """
    if exponent < 3 or size < exponent:
        raise ValueError("exponent must be 3 or more, size at least that")
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select((F.struct(*rest) if rest else F.struct(F.lit(None).cast("string").alias("none"))).alias("rest"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_run_batches, size=size, exponent=exponent),
                           f"rest {rows.schema['rest'].dataType.simpleString()}, n_words bigint, "
                           "runs array<struct<start: bigint, length: bigint, period: bigint>>, text string")


def most_repeated(runs: str) -> Column:
    """Of an array of runs the one of the greatest exact ``length / period`` (ties: the first); null without one."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_periodic_tail(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in a tenth of the documents (by CRC-32 ``h`` of the id as text) the words
    from place ``a`` on repeat the ``p`` words found there, ``g = h / 10``, ``a = g % n``,
    ``p = 1 + (n - a) / (3 + g % 8)`` for ``n`` words. Other texts, and rows without an id, stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.coalesce(F.col("text"), F.lit(""))
    inner = F.btrim(text, F.lit(_BLANKS))
    w = F.split(inner, r"[\x20\x09-\x0D]+")
    n = F.size(w).cast("bigint")
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    turns = F.floor((n - a - 1) / p) + 1
    words = F.concat(F.slice(w, 1, a.cast("int")),
                     F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), turns.cast("int"))))
    edited = F.array_join(F.slice(words, 1, n.cast("int")), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (inner != ""), edited).otherwise(text).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Every document's runs after its edit: their number, the one of most repetitions, and
    digests of all runs and of the text without repetitions."""
    from ..session import read_table
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_runs(with_periodic_tail(docs))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    top = out.select(F.col("rest.doc_id").alias("doc_id"), "runs", most_repeated("runs").alias("top"),
                     F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return top.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("top.start").alias("start"),
                      F.col("top.length").alias("length"), F.col("top.period").alias("period"),
                      F.expr("1000 * top.length div top.period").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")
