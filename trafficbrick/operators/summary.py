"""Per-window traffic summaries.

All aggregations are declarative ``groupBy().agg()`` with partial (map-side)
aggregation: a hot cell, device or window collapses to one row per task before
the shuffle, so skew costs nothing beyond a single row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addr import flow_label
from ..functions.hashing import BRICK_DIM
from ..functions.timecols import micros_to_wallclock, wallclock_micros
from ..session import scratch_path
from .binning import assign_bins
from .decode import ipv4_only, with_weight, LINE_OVERHEAD

WINDOW_COLS = ["window_start", "window_end"]


def with_window(df: DataFrame, duration: str = "3 seconds", ts: str = "ts") -> DataFrame:
    """Tumbling, epoch-aligned event-time window (F1) as two flat columns."""
    return (df.select("*", F.window(ts, duration).alias("_w"))
              .withColumn("window_start", F.col("_w.start"))
              .withColumn("window_end", F.col("_w.end"))
              .drop("_w"))


def binned_packets(packets: DataFrame, duration: str, strata: DataFrame | None = None, reserved: int = 1,
                   weight: str = "bytes", **bin_kw) -> DataFrame:
    """IPv4 packets with window, weight ``w`` and bin/cell/sub columns."""
    p = with_weight(ipv4_only(packets), weight)
    return assign_bins(with_window(p, duration), strata, reserved, **bin_kw)


def kept_packets(binned: DataFrame) -> DataFrame:
    """``binned`` with the columns that votes and sums need, written once under the checkpoint
    folder and read back: for plans that go through the packets more than once."""
    path = scratch_path(binned.sparkSession, "binned-packets")
    (binned.select(*WINDOW_COLS, "src_bin", "dst_bin", "cell", "sub", "ts", "seq", "src_ip", "dst_ip", "w", "sport", "dport")
           .write.parquet(path))
    return binned.sparkSession.read.parquet(path)


def brick(binned: DataFrame) -> DataFrame:
    """Sparse traffic matrix (E1): ``window, src_bin, dst_bin, cell, bytes``."""
    return (binned.groupBy(*WINDOW_COLS, "src_bin", "dst_bin")
                  .agg(F.sum("w").alias("bytes"))
                  .withColumn("cell", (F.col("src_bin") * BRICK_DIM + F.col("dst_bin")).cast("int")))


def sub_buckets(binned: DataFrame, weight_col: str = "w") -> DataFrame:
    """Source-hashed sub-bucket sums per cell (E2): ``window, cell, sub, bytes``."""
    return binned.groupBy(*WINDOW_COLS, "cell", "sub").agg(F.sum(weight_col).alias("bytes"))


def cell_estimate(subs: DataFrame) -> DataFrame:
    """Largest sub-bucket of each cell (E3) -- an upper bound on any one source's
    weight in the cell; also returns the cell total."""
    return subs.groupBy(*WINDOW_COLS, "cell").agg(F.max("bytes").alias("est"), F.sum("bytes").alias("cell_bytes"))


def active_cells(hitters: DataFrame) -> DataFrame:
    """Cells holding a candidate, per window."""
    return hitters.where(F.col("src_ip") != 0).groupBy(*WINDOW_COLS).agg(F.count(F.lit(1)).alias("active_cells"))


def traffic_totals(packets: DataFrame, duration: str, by_device: bool = True) -> DataFrame:
    """Packets and line bytes per interval (E9) -- every frame, IPv4 or not."""
    keys = WINDOW_COLS + (["device"] if by_device else [])
    return (with_window(packets, duration)
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("packets"),
                 F.sum(F.col("wire_len") + LINE_OVERHEAD).cast("bigint").alias("line_bytes")))


def capture_totals(stats: DataFrame) -> DataFrame:
    """Receive/drop counters summed over devices per sample time, with drop %.

    Drop % is 0 when nothing was received, even if drops were counted.
    """
    t = stats.groupBy("ts").agg(F.sum("recv").cast("bigint").alias("recv"), F.sum("drop").cast("bigint").alias("drop"))
    return with_drop_share(t)


def with_drop_share(t: DataFrame) -> DataFrame:
    """``ts, recv, drop`` with their ``total`` and ``drop_pct``."""
    pct = F.when(F.col("recv") == 0, F.lit(0.0)).otherwise(
        F.col("drop") * 100.0 / (F.col("recv") + F.col("drop")))
    return t.select("ts", "recv", "drop", (F.col("recv") + F.col("drop")).alias("total"), pct.alias("drop_pct"))


def _densify(arr, field: str, fill, n: int):
    """Dense length-``n`` array from a cell-sorted sparse array of structs:
    each entry contributes the zero run since the previous cell plus its value,
    then a tail of fill values -- linear in ``n``, all JVM-side."""
    fill_col = fill if not isinstance(fill, (int, str)) else F.lit(fill)

    def piece(e, k):
        prev = F.when(k == 0, F.lit(0)).otherwise(F.element_at(arr, F.greatest(k, F.lit(1)))["cell"] + 1)
        return F.concat(F.array_repeat(fill_col, (e["cell"] - prev).cast("int")), F.array(e[field]))

    body = F.flatten(F.transform(arr, piece))
    return F.concat(body, F.array_repeat(fill_col, (F.lit(n) - F.size(body)).cast("int")))


def all_windows(cells: DataFrame) -> DataFrame:
    """Every window from the first to the last of ``cells``; two
    values reach the driver, the windows are made in Spark.

    Window bounds are wall-clock times and are read as such, in no zone, so clock changes
    of the session's zone neither drop nor shift a window.
    """
    at = wallclock_micros(F.col("window_start"))
    step = wallclock_micros(F.col("window_end")) - at
    r = cells.agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.max(step).alias("step")).first()
    n = 0 if r.lo is None else (r.hi - r.lo) // r.step + 1
    edge = lambda shift: micros_to_wallclock(F.lit(r.lo or 0) + (F.col("id") + shift) * F.lit(r.step or 1))
    return cells.sparkSession.range(n).select(edge(0).alias("window_start"), edge(1).alias("window_end"))


def dense_brick(cells: DataFrame, dim: int = BRICK_DIM, fill: bool = False) -> DataFrame:
    """One document per window (E10): ``ts`` (window end), ``data`` (dim*dim bytes,
    row-major, zeros included) and ``hitters`` (flow labels, ``''`` when empty).

    ``cells`` has ``window, cell, bytes`` and optionally the cell's candidate
    ``src_ip, dst_ip, sport, dport`` (source 0 = none). Each window gathers at
    most dim*dim sparse entries -- a bound set by the brick dimension, not by
    the traffic -- and fills the gaps with array functions; no grid is joined.

    With ``fill``, windows between the first and the last
    that have no cell get a document of zeros too, as an exporter that runs on
    every tick writes.
    """
    return dense_windows(cells, all_windows(cells) if fill else None, dim)


def dense_windows(cells: DataFrame, windows: DataFrame | None = None, dim: int = BRICK_DIM) -> DataFrame:
    """``dense_brick`` of exactly ``windows`` (``window_start, window_end``), zeros where one has no
    cell; without ``windows``, of those that have cells."""
    n = dim * dim
    if "src_ip" in cells.columns:
        label = flow_label("src_ip", "sport", "dst_ip", "dport")
    else:
        label = F.lit("")
    entry = F.struct(F.col("cell").cast("int").alias("cell"), F.col("bytes").cast("bigint").alias("v"), label.alias("h"))
    per = cells.groupBy(*WINDOW_COLS).agg(F.sort_array(F.collect_list(entry)).alias("a"))
    if windows is not None:
        none = F.array().cast("array<struct<cell:int,v:bigint,h:string>>")
        per = windows.join(per.drop("window_end"), "window_start", "left").withColumn("a", F.coalesce("a", none))
    return per.select(
        F.col("window_end").alias("ts"),
        _densify(F.col("a"), "v", F.lit(0).cast("bigint"), n).alias("data"),
        _densify(F.col("a"), "h", F.lit(""), n).alias("hitters"),
    )
