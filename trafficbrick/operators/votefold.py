"""The weighted majority vote as a fold over sorted packets, for many cells at a time.

A cell's state is a candidate flow with the ports of the packet that installed it,
and a count. A packet of the candidate's flow adds its weight, another takes it away,
and one that takes more than there is becomes the candidate with what is left over.
Source 0 stands for no candidate.

Neighbouring packets of one flow in a cell are one *run*, which acts as a whole. The
first runs of all cells are folded together in one numpy step, then the second ones,
and so on; the few cells that have many more runs than the rest are finished one by one.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa

FIELDS = ("src_ip", "dst_ip", "sport", "dport", "count")
TOGETHER = 32       # cells that make a common step worth while


def no_votes(n: int) -> np.ndarray:
    """The state of ``n`` cells without a candidate: one row of each of ``FIELDS``."""
    return np.zeros((len(FIELDS), n), dtype=np.int64)


class Runs:
    """Runs of packets sorted by cell and order. ``cell`` numbers the cells from 0, without gaps."""

    def __init__(self, cell: np.ndarray, src: np.ndarray, dst: np.ndarray, sport: np.ndarray, dport: np.ndarray, w: np.ndarray):
        change = np.ones(len(cell), dtype=bool)
        change[1:] = (cell[1:] != cell[:-1]) | (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
        self.first = np.flatnonzero(change)
        self.cell, self.src, self.dst = cell[self.first], src[self.first], dst[self.first]
        self.sport, self.dport = sport, dport
        self.running = np.cumsum(w)
        self.before = self.running[self.first] - w[self.first]
        self.total = np.add.reduceat(w, self.first) if len(w) else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.cell, np.arange((int(cell[-1]) + 1 if len(cell) else 0) + 1))


def fold(runs: Runs, state: np.ndarray) -> np.ndarray:
    """Fold all runs into ``state`` (FIELDS x cells), in place."""
    many = np.diff(runs.bounds)
    order = np.argsort(-many, kind="stable")
    step, n = 0, len(order)
    while n:
        n = int(np.searchsorted(-many[order[:n]], -step, "left"))       # cells with more than ``step`` runs
        if n < TOGETHER:
            break
        cells = order[:n]
        _step(runs, runs.bounds[cells] + step, state, cells)
        step += 1
    for c in order[:n].tolist():
        _finish(runs, int(runs.bounds[c]) + step, int(runs.bounds[c + 1]), state, c)
    return state


def _step(runs: Runs, k: np.ndarray, state: np.ndarray, cells: np.ndarray) -> None:
    """One run (number ``k``) of each of ``cells``."""
    src, dst, _, _, count = state[:, cells]
    total = runs.total[k]
    fresh = src == 0
    same = ~fresh & (src == runs.src[k]) & (dst == runs.dst[k])
    taken = ~fresh & ~same & (total > count)
    # the packet at which the run has taken away more than there was
    at = np.where(taken, np.searchsorted(runs.running, runs.before[k] + count, "right"), runs.first[k])
    at = np.minimum(at, len(runs.running) - 1)
    new = fresh | taken
    into = cells[new]
    state[0, into], state[1, into] = runs.src[k][new], runs.dst[k][new]
    state[2, into], state[3, into] = runs.sport[at[new]], runs.dport[at[new]]
    state[4, cells] = np.where(fresh, total, np.where(same, count + total, np.abs(count - total)))


def _finish(runs: Runs, k: int, end: int, state: np.ndarray, cell: int) -> None:
    """The runs ``k .. end - 1`` of one cell."""
    src, dst, sport, dport, count = state[:, cell].tolist()
    installed = -1      # the packet that installed the candidate, if one of these did
    alone = np.diff(runs.first[k:end + 1], append=len(runs.running) if end == len(runs.first) else []) == 1
    for s, d, total, i, before, one in zip(runs.src[k:end].tolist(), runs.dst[k:end].tolist(), runs.total[k:end].tolist(),
                                           runs.first[k:end].tolist(), runs.before[k:end].tolist(), alone.tolist()):
        if src == 0:
            src, dst, installed, count = s, d, i, total
        elif src == s and dst == d:
            count += total
        elif total <= count:
            count -= total
        else:
            installed = i if one else int(np.searchsorted(runs.running, before + count, "right"))
            src, dst, count = s, d, total - count
    if installed >= 0:
        sport, dport = int(runs.sport[installed]), int(runs.dport[installed])
    state[:, cell] = src, dst, sport, dport, count


# ---------------------------------------------------------------- sorted packets, batch by batch
#: Columns that the folds over batches take: the key of a group, then its packets in order.
GROUP = ("window_start", "window_end", "cell", "chunk")
PACKET = ("src_ip", "dst_ip", "w", "sport", "dport")
RESULT = "window_start timestamp_ntz, window_end timestamp_ntz, cell int, chunk int, src_ip bigint, dst_ip bigint, " \
         "sport int, dport int, count bigint, need bigint, gain bigint"
Start = tuple[int, int, int, int, int]      # FIELDS


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    c = batch.column(name)
    if pa.types.is_timestamp(c.type):
        c = c.cast(pa.timestamp("us")).cast(pa.int64())
    return c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def fold_batches(batches: Iterator[pa.RecordBatch], starts: dict[tuple[int, int, int], Start]) -> Iterator[pa.RecordBatch]:
    """Fold packets sorted by ``GROUP`` and order; one row a group (see ``RESULT``).

    A group begins with the state that ``starts`` has for its (window start, cell, chunk), else
    without a candidate. For one that has, ``need`` is the least count with which that
    candidate outlasts the whole group, and ``gain`` what its count changes by then (both null
    otherwise). Memory is one batch, whatever the size of a group.
    """
    key, state, signed = None, None, None       # of the group that the last batch ended in
    for b in batches:
        if not b.num_rows:
            continue
        group = [_column(b, c) for c in GROUP]
        src, dst, w, sport, dport = (_column(b, c) for c in PACKET)
        change = np.zeros(b.num_rows, dtype=bool)
        change[0] = True
        for g in group:
            change[1:] |= g[1:] != g[:-1]
        first = np.flatnonzero(change)
        keys = [tuple(k) for k in zip(*[g[first].tolist() for g in group])]
        begun = keys[0] == key
        if key is not None and not begun:
            yield _results([key], state, [signed])
        columns = no_votes(len(keys))
        sums: list = [None] * len(keys)
        if begun:
            columns[:, 0], sums[0] = state[:, 0], signed
        for n, (ws, _, cell, chunk) in enumerate(keys if starts else ()):
            own = starts.get((ws, cell, chunk))
            if own is None:
                continue
            if n or not begun:
                columns[:, n], sums[n] = own, (0, 0)
            i, j = first[n], first[n + 1] if n + 1 < len(first) else b.num_rows
            run = sums[n][0] + np.cumsum(np.where((src[i:j] == own[0]) & (dst[i:j] == own[1]), w[i:j], -w[i:j]))
            sums[n] = (int(run[-1]), min(sums[n][1], int(run.min())))
        fold(Runs(np.cumsum(change) - 1, src, dst, sport, dport, w), columns)
        if len(keys) > 1:
            yield _results(keys[:-1], columns[:, :-1], sums[:-1])
        key, state, signed = keys[-1], columns[:, -1:].copy(), sums[-1]
    if key is not None:
        yield _results([key], state, [signed])


def _results(keys: list[tuple], state: np.ndarray, sums: list) -> pa.RecordBatch:
    ws, we, cell, chunk = (np.array(x, dtype=np.int64) for x in zip(*keys))
    at = lambda x: pa.array(x).cast(pa.timestamp("us"))
    src, dst, sport, dport, count = state
    return pa.RecordBatch.from_arrays(
        [at(ws), at(we), pa.array(cell.astype(np.int32)), pa.array(chunk.astype(np.int32)), pa.array(src), pa.array(dst),
         pa.array(sport.astype(np.int32)), pa.array(dport.astype(np.int32)), pa.array(count),
         pa.array([None if s is None else -s[1] for s in sums], pa.int64()), pa.array([None if s is None else s[0] for s in sums], pa.int64())],
        [f.split()[0] for f in RESULT.split(", ")])


# ---------------------------------------------------------------- mergeable form
PARTIAL = "window_start timestamp_ntz, window_end timestamp_ntz, cell int, src_ip bigint, dst_ip bigint, sport int, dport int, cnt bigint"
HELD = 1 << 20      # cells that a task holds before it puts its summaries out


def _best_of_each(window: np.ndarray, cell: np.ndarray, src, dst, w, sport, dport) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packets in any order: the (window, cell) pairs as rows, and each one's summary (FIELDS x pairs)."""
    order = np.lexsort((dst, src, cell, window))
    window, cell, src, dst, w, sport, dport = (x[order] for x in (window, cell, src, dst, w, sport, dport))
    new_cell = np.r_[True, (window[1:] != window[:-1]) | (cell[1:] != cell[:-1])]
    new_flow = new_cell | np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]
    flow = np.flatnonzero(new_flow)
    sums = np.add.reduceat(w, flow)
    owner = np.cumsum(new_cell)[flow] - 1
    # the heaviest flow of each, of equals the first
    rank = np.lexsort((np.arange(len(flow)), -sums, owner))
    head = rank[np.r_[True, owner[rank][1:] != owner[rank][:-1]]]
    total = np.bincount(owner, sums).astype(np.int64)
    at = flow[head]
    state = np.stack([src[at], dst[at], sport[at], dport[at], np.maximum(2 * sums[head] - total, 0)])
    return window[new_cell], cell[new_cell], state


def partial_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's vote summaries (``PARTIAL``): one a window and cell, whatever the number of packets.

    A summary is a candidate and a count. Two of one flow add up; of different flows the larger
    stays, with the difference. What is cancelled are always pairs of unlike weights, so the
    sum of the counts of a flow with more than half of the weight exceeds that of all others,
    whatever the order of packets, batches and merges.
    """
    windows: dict[tuple[int, int], int] = {}
    keys, state = np.zeros(0, np.int64), no_votes(0)

    def out() -> pa.RecordBatch:
        spans = np.array(sorted(windows, key=windows.get), dtype=np.int64).reshape(-1, 2)
        where, cell = keys >> 32, keys & 0xFFFFFFFF
        at = lambda c: pa.array(spans[where, c]).cast(pa.timestamp("us"))
        return pa.RecordBatch.from_arrays(
            [at(0), at(1), pa.array(cell.astype(np.int32)), pa.array(state[0]), pa.array(state[1]), pa.array(state[2].astype(np.int32)),
             pa.array(state[3].astype(np.int32)), pa.array(state[4])], [f.split()[0] for f in PARTIAL.split(", ")])

    for b in batches:
        if not b.num_rows:
            continue
        ws, we, cell = (_column(b, c) for c in GROUP[:3])
        spans, number = np.unique(np.stack([ws, we], axis=1), axis=0, return_inverse=True)
        ids = np.array([windows.setdefault(tuple(s), len(windows)) for s in spans.tolist()], dtype=np.int64)
        window, of_cell, new = _best_of_each(ids[number.ravel()], cell, *[_column(b, c) for c in PACKET])
        own = window << 32 | of_cell
        order = np.argsort(own)
        own, new = own[order], new[:, order]
        at = np.searchsorted(keys, own)
        held = np.zeros(len(own), dtype=bool)
        held[at < len(keys)] = keys[at[at < len(keys)]] == own[at < len(keys)]
        cols = at[held]
        old, come = state[:, cols], new[:, held]
        same = (old[0] == come[0]) & (old[1] == come[1])
        keep = same | (old[4] >= come[4])
        merged = np.where(keep, old, come)
        merged[4] = np.where(same, old[4] + come[4], np.abs(old[4] - come[4]))
        state[:, cols] = merged
        keys, state = np.insert(keys, at[~held], own[~held]), np.insert(state, at[~held], new[:, ~held], axis=1)
        if len(keys) >= HELD:
            yield out()
            windows.clear()
            keys, state = np.zeros(0, np.int64), no_votes(0)
    if len(keys):
        yield out()
