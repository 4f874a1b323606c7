"""Rate statistics (F3, F4) over per-interval totals.

Input: ``traffic_totals`` rows ``(window_start, window_end, device, packets,
line_bytes)``. Ordered scans use :mod:`trafficbrick.operators.scan`, so a busy
device's long history is split by day rather than handed to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import delta_ms
from .scan import previous_row, running_sums

BITS_PER_GIGABIT_BYTE = 125_000_000  # bytes per gigabit


def cumulative_rates(totals: DataFrame, bucket: str = "day", keys=("device",)) -> DataFrame:
    """Since-start counters per device (F4): packets, bytes, elapsed ms, pkt/s, Mbit/s.

    ``keys=()`` gives the counters of the whole monitor. ``totals`` is read three
    times: give a written table (one row per interval).
    """
    keys = list(keys)
    b = F.date_trunc(bucket, F.col("window_end"))
    cum = running_sums(totals, keys, ["window_end"], ["packets", "line_bytes"], b)
    start = totals.groupBy(*keys).agg(F.min("window_start").alias("start"))
    # without keys the start is one row
    j = cum.join(start, keys, "left") if keys else cum.crossJoin(F.broadcast(start))
    return with_total_rates(j.select(*keys, "window_end", "start", F.col("packets_cum").cast("bigint").alias("packets"),
                                     F.col("line_bytes_cum").cast("bigint").alias("bytes")), keys)


def with_total_rates(counters: DataFrame, keys: list[str]) -> DataFrame:
    """Rates of counters ``packets, bytes`` from ``start`` to ``window_end``."""
    return (counters.select(*keys, "window_end", "packets", "bytes", delta_ms(F.col("window_end"), F.col("start")).alias("ms"))
                    .withColumn("pps", F.col("packets") * 1000.0 / F.col("ms"))
                    .withColumn("mbps", F.col("bytes") * 8.0 / (F.col("ms") * 1000.0)))


def interval_rates(cumulative: DataFrame, bucket: str = "day", keys=("device",)) -> DataFrame:
    """Since-last-sample statistics (F3): packets, ms, pkt/s and Gbit/s.

    ``gbps`` is exact; ``gbps_trunc`` first truncates the byte delta to whole
    gigabits, as a native monitor's integer counters do.
    """
    keys = list(keys)
    p = previous_row(cumulative.select(*keys, "window_end", "packets", "bytes"), keys, "window_end",
                     ["window_end", "packets", "bytes"], F.date_trunc(bucket, F.col("window_end")))
    return with_interval_rates(p, keys)


def with_interval_rates(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Rates between each sample of counters and the one before (``prev_*``; rows without one go)."""
    secs = F.col("ms") / 1000.0
    return (samples.where(F.col("prev_window_end").isNotNull())
                   .select(*keys, "window_end", (F.col("packets") - F.col("prev_packets")).alias("packets"),
                           (F.col("bytes") - F.col("prev_bytes")).alias("bytes"),
                           delta_ms(F.col("window_end"), F.col("prev_window_end")).alias("ms"))
                   .withColumn("pps", F.col("packets") / secs)
                   .withColumn("gbps", F.col("bytes") * 8.0 / 1e9 / secs)
                   .withColumn("gbps_trunc", F.floor(F.col("bytes") / BITS_PER_GIGABIT_BYTE) / secs))
