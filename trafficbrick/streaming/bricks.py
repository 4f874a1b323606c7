"""Streaming summaries (F2, F5, F7) with Structured Streaming.

The live pipeline closes event-time windows by watermark and writes, for each, its cells,
top-k, report and document. What names a cell's heavy flow is chosen by ``hitters_by``:

* ``"flow"``: one streaming aggregation keeps the flows of each window, ``(window, src, dst)
  -> bytes, packets, first ports``, in the state store. In ``append`` mode a window's flows
  come out once, all in the same micro-batch, when the watermark passes the window's end
  (F2: state for that window is then dropped; F7: rows later than the watermark are
  discarded); the batch roll-ups give the cells with their exact heaviest flow.
* ``"vote"``: the ordered vote of each cell (:mod:`trafficbrick.streaming.vote`) and the
  estimates -- sums by sub-bucket, then their largest, two chained aggregations -- meet in a
  stream-stream join on window and cell. All three close a window in the same micro-batch.

With ``fill``, ticks (:mod:`trafficbrick.streaming.ticks`) add windows without traffic.

The sink writes a micro-batch's cells once to a staging table and derives the other
outputs from it; each output is filed by date and batch, and a replayed batch overwrites
its own folders, so the sink is idempotent and a reader prunes by date.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import instant_to_wallclock
from ..operators import keys as K
from ..operators.binning import assign_bins
from ..operators.hitters import hitter_report, top_hitters
from ..operators.store import document_bytes
from ..operators.summary import WINDOW_COLS, dense_brick, dense_windows
from ..plans.summary import cells_of
from ..session import drop_path, scratch_path
from .start import start
from .ticks import window_ticks
from .vote import SLICES, clocked, fold_votes, windowed_packets

CELL = "cell int, src_bin int, dst_bin int, bytes bigint, est bigint, src_ip bigint, dst_ip bigint, sport int, dport int"
FLOW = "src_ip bigint, dst_ip bigint, bytes bigint, packets bigint, pp bigint"


def _wallclock(*named) -> list:
    return [instant_to_wallclock(c).alias(n) for n, c in zip(WINDOW_COLS, named)]


def streaming_flows(packets: DataFrame, duration: str, watermark: str, weight: str = "bytes") -> DataFrame:
    """Windowed flow aggregation over a streaming (or batch) packet DataFrame."""
    p = clocked(packets, duration, watermark, weight)
    first = K.first_packet_key(F.unix_micros("ts"), F.col("seq"))
    return (p.groupBy("window", "src_ip", "dst_ip")
             .agg(F.sum("w").alias("bytes"), F.count(F.lit(1)).alias("packets"),
                  F.min_by(K.pack_ports(F.col("sport"), F.col("dport")), first).alias("pp")))


def streaming_estimates(binned: DataFrame) -> DataFrame:
    """``window, cell, bytes, est`` of closed windows: sums by sub-bucket, and their largest."""
    subs = binned.groupBy("window", "cell", "sub").agg(F.sum("w").alias("b"))
    return subs.groupBy("window", "cell").agg(F.sum("b").cast("bigint").alias("bytes"), F.max("b").cast("bigint").alias("est"))


def vote_cells(packets: DataFrame, duration: str, watermark: str, strata: DataFrame | None = None, reserved: int = 1,
               weight: str = "bytes", slices: int = SLICES, dim: int = 128, **bin_kw) -> DataFrame:
    """Cells of closed windows with the candidates of the ordered vote (zeros: none): votes and
    estimates joined on window and cell."""
    binned = windowed_packets(packets, duration, watermark, strata, reserved, weight, dim=dim, **bin_kw)
    votes = (fold_votes(binned, slices).withColumn("window", F.window("window_close", duration))
             .select("window", "cell", "src_ip", "dst_ip", F.col("sport").cast("int").alias("sport"), F.col("dport").cast("int").alias("dport")))
    both = streaming_estimates(binned).join(votes, ["window", "cell"])
    return both.select(*_wallclock(F.col("window.start"), F.col("window.end")), "cell", (F.col("cell") / F.lit(dim)).cast("int").alias("src_bin"),
                       (F.col("cell") % dim).cast("int").alias("dst_bin"), "bytes", "est", "src_ip", "dst_ip", "sport", "dport")


def closed_windows(packets: DataFrame, duration: str, watermark: str, hitters_by: str = "flow", fill: bool = False,
                   strata: DataFrame | None = None, reserved: int = 1, weight: str = "bytes", slices: int = SLICES, **bin_kw) -> DataFrame:
    """The rows of closed windows: flows, or cells with ``hitters_by="vote"``; with ``fill`` also one
    row of nulls beside the window for each window, empty or not (a tick)."""
    if hitters_by not in ("flow", "vote"):
        raise ValueError("hitters_by must be 'flow' or 'vote'")
    if hitters_by == "vote":
        rows = vote_cells(packets, duration, watermark, strata, reserved, weight, slices, **bin_kw)
    else:
        flows = streaming_flows(packets, duration, watermark, weight)
        rows = flows.select(*_wallclock(F.col("window.start"), F.col("window.end")), "src_ip", "dst_ip",
                            F.col("bytes").cast("bigint").alias("bytes"), "packets", "pp")
    if not fill:
        return rows
    ticks = window_ticks(clocked(packets, duration, watermark, weight))
    return rows.unionByName(ticks.select(*_wallclock(F.timestamp_micros("start"), F.timestamp_micros("end"))), allowMissingColumns=True)


def cells_of_closed(rows: DataFrame, hitters_by: str, strata: DataFrame | None = None, reserved: int = 1, fill: bool = False,
                    **bin_kw) -> DataFrame:
    """The cells of a micro-batch of ``closed_windows``; with ``fill`` also a row without a cell for each window with ticks.

    ``rows`` is read once: a second reading would run the micro-batch's state a second time.
    """
    if hitters_by == "vote":
        return rows
    if not fill:
        return cells_of(assign_bins(rows.where(F.col("src_ip").isNotNull()), strata, reserved, **bin_kw)).drop("flow_bytes")
    ticks = rows.withColumn("tick", F.col("src_ip").isNull()).na.fill(0, ["src_ip", "dst_ip"])
    binned = assign_bins(ticks, strata, reserved, **bin_kw)
    return cells_of(binned.withColumns({c: F.when(~F.col("tick"), F.col(c)) for c in ("cell", "sub")})).drop("flow_bytes")


def write_closed(rows: DataFrame, output_path: str, batch_id: int, hitters_by: str = "flow", strata: DataFrame | None = None,
                 reserved: int = 1, k: int = 20, unit: str = "bytes", fill: bool = False, **bin_kw) -> None:
    """Write the outputs of one micro-batch of ``closed_windows`` under ``output_path``."""
    spark, base = rows.sparkSession, output_path.rstrip("/")
    staged = scratch_path(spark, "stream-cells")
    cells_of_closed(rows, hitters_by, strata, reserved, fill, **bin_kw).write.parquet(staged)
    kept = spark.read.parquet(staged)
    cells = kept.where(F.col("cell").isNotNull())
    top = top_hitters(cells.where(F.col("src_ip") != 0), k=k)
    windows = kept.where(F.col("cell").isNull()).select(*WINDOW_COLS).distinct() if fill else None
    documents = document_bytes(dense_windows(cells, windows) if fill else dense_brick(cells))
    for name, df, at in (("cells", cells, "window_start"), ("top", top, "window_start"),
                         ("report", hitter_report(top, unit), "window_start"), ("documents", documents, "ts")):
        (df.withColumn("date", F.to_date(at)).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
           .option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch_id").parquet(f"{base}/{name}"))
    drop_path(spark, staged)


def stream_bricks(packets: DataFrame, output_path: str, checkpoint: str, duration: str = "3 seconds",
                  watermark: str = "0 seconds", strata: DataFrame | None = None, reserved: int = 1,
                  weight: str = "bytes", k: int = 20, trigger: dict | None = None,
                  sink: Callable | None = None, state_partitions: int | None = None, hitters_by: str = "flow",
                  fill: bool = False, slices: int = SLICES, **bin_kw):
    """Start the live pipeline; returns the ``StreamingQuery``.

    Default sink: ``<output_path>/{cells,top,report,documents}/date=<day>/batch_id=<n>``
    parquet folders, overwritten per batch. ``sink(batch_df, batch_id)`` may
    replace it (it receives the rows of ``closed_windows``). ``bin_kw`` (such as
    ``parity=``, the seeded hash) goes to ``assign_bins``.
    """
    closed = closed_windows(packets, duration, watermark, hitters_by, fill, strata, reserved, weight, slices,
                            **(bin_kw if hitters_by == "vote" else {}))
    unit = "bytes" if weight == "bytes" else "packets"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if sink is not None:
            sink(batch, batch_id)
        else:
            write_closed(batch, output_path, batch_id, hitters_by, strata, reserved, k, unit, fill, **bin_kw)

    w = (closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
               .foreachBatch(write_batch).trigger(**(trigger or {"availableNow": True})))
    return start(packets.sparkSession, w, state_partitions)


def read_stream_output(spark, output_path: str, name: str) -> DataFrame:
    """One output of the sink, with the ``date`` and ``batch_id`` it is filed under."""
    return spark.read.parquet(f"{output_path.rstrip('/')}/{name}")
