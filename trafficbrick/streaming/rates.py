"""Live rates and drop figures.

Totals by interval are one streaming aggregation; when the watermark closes an interval its
totals go to a processor that keeps, for each device, the counters since the start and the
previous sample. It puts out one row a tick: the counters, the ones before, and the times,
from which the rates are plain columns.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.timecols import instant_to_wallclock, wallclock_to_instant
from ..operators.decode import LINE_OVERHEAD
from ..operators.rates import with_interval_rates, with_total_rates
from ..operators.summary import with_drop_share

_COUNTERS = ["since", "at", "packets", "bytes"]
_STATE = "since bigint, at bigint, packets bigint, bytes bigint"
_OUT = "device string, since bigint, at bigint, packets bigint, bytes bigint, prev_at bigint, prev_packets bigint, prev_bytes bigint"
ALL_DEVICES = ""


def device_counters() -> StatefulProcessor:
    """The processor of the counters (a class that travels by value, see :mod:`trafficbrick.streaming.vote`)."""

    class DeviceCounters(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", _STATE)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
            new = pd.concat(list(rows)).sort_values("end")
            since, at, packets, count = self.last.get() if self.last.exists() else (int(new["start"].iloc[0]), None, 0, 0)
            out = new[["end"]].rename(columns={"end": "at"})
            out.insert(0, "device", key[0])
            out.insert(1, "since", since)
            out["packets"] = packets + new["packets"].cumsum()
            out["bytes"] = count + new["bytes"].cumsum()
            for c, first in (("at", at), ("packets", packets), ("bytes", count)):
                out[f"prev_{c}"] = out[c].shift(1).astype("Int64")
                out.iloc[0, out.columns.get_loc(f"prev_{c}")] = first if at is not None else pd.NA
            self.last.update(tuple(int(v) for v in out[_COUNTERS].iloc[-1]))
            yield out

        def close(self) -> None:
            pass

    return DeviceCounters()


def stream_totals(packets: DataFrame, duration: str, watermark: str = "0 seconds", by_device: bool = True) -> DataFrame:
    """Closed intervals with traffic (E9): ``window, device, packets, bytes`` (line bytes)."""
    p = packets.withColumn("ts", wallclock_to_instant(F.col("ts"))).withWatermark("ts", watermark)
    return (p.groupBy(F.window("ts", duration).alias("window"), (F.col("device") if by_device else F.lit(ALL_DEVICES)).alias("device"))
             .agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("wire_len") + LINE_OVERHEAD).cast("bigint").alias("bytes")))


def stream_counters(packets: DataFrame, duration: str, watermark: str = "0 seconds", by_device: bool = True) -> DataFrame:
    """One row a device and closed interval: ``device, window_end, start``, counters since the start
    (``packets, bytes``) and those of the sample before (``prev_*``, null on the first)."""
    totals = stream_totals(packets, duration, watermark, by_device).select(
        F.unix_micros("window.start").alias("start"), F.unix_micros("window.end").alias("end"), "device", "packets", "bytes")
    c = totals.groupBy("device").transformWithStateInPandas(device_counters(), _OUT, "append", "None")
    at = lambda n: instant_to_wallclock(F.timestamp_micros(n))
    return c.select("device", at("at").alias("window_end"), at("since").alias("start"), "packets", "bytes",
                    at("prev_at").alias("prev_window_end"), "prev_packets", "prev_bytes")


def stream_rates(packets: DataFrame, duration: str, watermark: str = "0 seconds", since: str = "start", by_device: bool = True) -> DataFrame:
    """Live counters and rates since the ``"start"`` (F4) or since the ``"last"`` sample (F3), with the
    columns of the batch operators (``device`` only if ``by_device``).

    The query needs the RocksDB state store (:func:`trafficbrick.streaming.start.start` sets it).
    """
    if since not in ("start", "last"):
        raise ValueError("since must be 'start' or 'last'")
    keys = ["device"] if by_device else []
    c = stream_counters(packets, duration, watermark, by_device)
    return with_total_rates(c, keys) if since == "start" else with_interval_rates(c, keys)


def stream_capture_totals(stats: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """Receive and drop counters over all devices per sample time, with the drop share (E11),
    once the watermark has passed the time."""
    t = (stats.withColumn("at", wallclock_to_instant(F.col("ts"))).withWatermark("at", watermark)
              .groupBy("at").agg(F.sum("recv").cast("bigint").alias("recv"), F.sum("drop").cast("bigint").alias("drop")))
    return with_drop_share(t.select(instant_to_wallclock(F.col("at")).alias("ts"), "recv", "drop"))
