"""Ordered weighted vote on a stream (F6) with ``transformWithStateInPandas``.

State is keyed by (window, slice of cells); a map in it holds one entry for each cell
that had a packet. A micro-batch reads a slice's entries in one pass, folds its own
rows in (cell, ts, seq, ...) order -- all cells of the slice together, see
:mod:`trafficbrick.operators.votefold` -- and writes back the entries of the cells it
touched, no others. Micro-batches fold in arrival order. What a key holds at once is its
rows of one micro-batch, which the source's files-per-trigger bounds.

Spark's state worker takes each row that it is given apart in Python. So the packets of a key
that lie in one Arrow batch come to it packed in one row (``pack_batches``).

A window's slice registers one event-time timer, at the window's end. When the
watermark passes it, the slice's final candidates are emitted and its state goes. Rows of
windows that closed before are late (F7): Spark drops them before the fold, by the
window's end and not by their own time, and the fold ignores what comes through.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.timecols import instant_to_wallclock, wallclock_to_instant
from ..operators.binning import assign_bins
from ..operators.decode import is_ipv4, with_weight
from ..operators.votefold import FIELDS

SLICES = 64
KEY = ["start", "end", "slice"]
ORDER = ["at", "seq", "src_ip", "dst_ip", "w", "sport", "dport"]
_ENTRY = "src_ip bigint, dst_ip bigint, sport bigint, dport bigint, count bigint"
_PACKED = "start bigint, end bigint, slice int, packets binary"
_OUT = "window_close timestamp, start bigint, end bigint, cell int, " + _ENTRY


def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packets of each batch as one row a key (``_PACKED``): the key, and ``cell`` and ``ORDER`` of its packets,
    column after column, as bytes of int64."""
    for b in batches:
        if not b.num_rows:
            continue
        start, end, part, *cols = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in (*KEY, "cell", *ORDER))
        order = np.lexsort((part, end, start))
        keys = np.stack([start, end, part])[:, order]
        first = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        cols = np.stack(cols)[:, order]
        packets = [cols[:, i:j].tobytes() for i, j in zip(first.tolist(), [*first[1:].tolist(), b.num_rows])]
        start, end, part = keys[:, first]
        yield pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), pa.array(part.astype(np.int32)), pa.array(packets, pa.binary())],
                                         [*KEY, "packets"])


def cell_votes() -> StatefulProcessor:
    """The processor of the votes.

    The worker that prepares a query's state on the driver does not see the modules that were
    shipped to the executors: a class made here travels by value and imports the fold where it runs.
    """
    class CellVotes(StatefulProcessor):
        """The votes of one slice of cells in one window; keys are (start, end, slice), in microseconds."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.votes = handle.getMapState("votes", "cell int", _ENTRY)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
            end_ms = -(-int(key[1]) // 1000)
            if end_ms <= timerValues.getCurrentWatermarkInMs():
                return
            from trafficbrick.operators.votefold import Runs, fold, no_votes
            cols = np.concatenate([np.frombuffer(b, dtype=np.int64).reshape(len(ORDER) + 1, -1) for p in rows for b in p["packets"]], axis=1)
            order = np.lexsort(cols[::-1])
            cell, _, _, src, dst, w, sport, dport = (c[order] for c in cols)
            touched, number = np.unique(cell, return_inverse=True)
            held = {k[0]: v for k, v in self.votes.iterator()}
            state = no_votes(len(touched))
            for n, c in enumerate(touched.tolist()):
                if c in held:
                    state[:, n] = held[c]
            fold(Runs(number, src, dst, sport, dport, w), state)
            for c, entry in zip(touched.tolist(), state.T.tolist()):
                self.votes.updateValue((c,), tuple(entry))
            if not held:
                self.handle.registerTimer(end_ms)
            return
            yield  # a generator without rows

        def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            rows = [(k[0], *v) for k, v in self.votes.iterator()]
            self.votes.clear()
            if rows:
                out = pd.DataFrame(rows, columns=["cell", *FIELDS])
                # the last instant inside the window: what the window's rows carry as event time downstream
                out.insert(0, "window_close", pd.Timestamp(int(key[1]) - 1, unit="us"))
                out.insert(1, "start", int(key[0]))
                out.insert(2, "end", int(key[1]))
                yield out

        def close(self) -> None:
            pass

    return CellVotes()


def clocked(packets: DataFrame, duration: str, watermark: str, weight: str = "bytes") -> DataFrame:
    """IPv4 packets of a stream with weight ``w`` and ``window`` (of instants, under the watermark).

    All packets, IPv4 or not, drive the watermark.
    """
    # watermarks need TIMESTAMP: the wall-clock event time is read as UTC
    clock = packets.withColumn("ts", wallclock_to_instant(F.col("ts"))).withWatermark("ts", watermark)
    # a condition without the event time would be moved below the watermark
    ours = clock.where(F.when(is_ipv4(), F.col("ts")).isNotNull())
    return with_weight(ours, weight).withColumn("window", F.window("ts", duration))


def windowed_packets(packets: DataFrame, duration: str, watermark: str, strata: DataFrame | None = None, reserved: int = 1,
                     weight: str = "bytes", **bin_kw) -> DataFrame:
    """``clocked`` packets with their bins."""
    return assign_bins(clocked(packets, duration, watermark, weight), strata, reserved, **bin_kw)


def fold_votes(binned: DataFrame, slices: int = SLICES) -> DataFrame:
    """Final votes of every (window, cell) of ``windowed_packets``, as ``window_close`` (an
    event-time column), ``start``, ``end`` (microseconds), ``cell`` and the candidate (zeros: none)."""
    rows = binned.select(F.unix_micros("window.start").alias("start"), F.unix_micros("window.end").alias("end"),
                         F.pmod(F.col("cell"), F.lit(slices)).alias("slice"), "cell", F.unix_micros("ts").alias("at"),
                         *[F.col(c).cast("bigint").alias(c) for c in ORDER[1:]])
    return (rows.mapInArrow(pack_batches, _PACKED).groupBy(*KEY)
                .transformWithStateInPandas(cell_votes(), _OUT, "append", "EventTime", eventTimeColumnName="window_close"))


def stream_vote(packets: DataFrame, duration: str, watermark: str = "0 seconds", strata: DataFrame | None = None,
                reserved: int = 1, slices: int = SLICES, weight: str = "bytes", **bin_kw) -> DataFrame:
    """Streaming DataFrame of final vote candidates per (window, cell), emitted
    when the watermark passes the window end (use ``append`` output mode).

    The query needs the RocksDB state store (:func:`trafficbrick.streaming.start.start`
    sets it). ``slices`` is the number of state keys a window has at most.
    """
    v = fold_votes(windowed_packets(packets, duration, watermark, strata, reserved, weight, **bin_kw), slices).where("src_ip <> 0")
    return v.select(instant_to_wallclock(F.timestamp_micros("start")).alias("window_start"),
                    instant_to_wallclock(F.timestamp_micros("end")).alias("window_end"), "cell", "src_ip", "dst_ip",
                    F.col("sport").cast("int").alias("sport"), F.col("dport").cast("int").alias("dport"), "count")
