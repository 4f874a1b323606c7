"""The offline job: capture files -> stored summaries.

``read_captures -> decode -> bins -> flows/cells -> top-k, report, documents``.
The cell table -- the one result every output shares -- is written once to
the output folder and read back, so the packet aggregation runs a single time
and the later outputs restart from a durable table rather than a long lineage
(an executor lost while writing the documents does not re-read the captures).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decode import decode_frames, filter_packets
from ..operators.hitters import hitter_report, top_hitters
from ..operators.store import write_bricks
from ..operators.summary import dense_brick
from ..sources.captures import read_captures
from ..sources.strata import read_strata, read_strata_lines, reserved_bins
from .summary import window_summary


def summarize_packets(packets: DataFrame, out_path: str, duration: str = "3 seconds",
                      strata: DataFrame | None = None, reserved: int = 1, weight: str = "bytes", k: int = 20,
                      hitters_by: str = "flow", fill: bool = False, predicate=None, **bin_kw) -> dict[str, str]:
    """Write ``cells``, ``top``, ``report`` and ``documents`` under ``out_path``.

    ``predicate`` (SQL text or a column) keeps only the packets it holds for,
    before binning; ``hitters_by`` and ``fill`` as in ``window_summary``.
    """
    base = out_path.rstrip("/")
    spark = packets.sparkSession
    if predicate is not None:
        packets = filter_packets(packets, predicate)
    cells = window_summary(packets, duration, strata, reserved, weight, k, hitters_by=hitters_by, **bin_kw).cells
    (cells.withColumn("date", F.to_date("window_start"))
          .write.mode("overwrite").partitionBy("date").parquet(f"{base}/cells"))
    stored = spark.read.parquet(f"{base}/cells").drop("date")
    top = top_hitters(stored.where(F.col("src_ip") != 0), k=k)
    top.write.mode("overwrite").parquet(f"{base}/top")
    unit = "bytes" if weight == "bytes" else "packets"
    hitter_report(spark.read.parquet(f"{base}/top"), unit).write.mode("overwrite").parquet(f"{base}/report")
    write_bricks(dense_brick(stored, fill=fill), f"{base}/documents", mode="overwrite")
    return {n: f"{base}/{n}" for n in ("cells", "top", "report", "documents")}


def summarize_captures(spark: SparkSession, capture_path: str, out_path: str, duration: str = "3 seconds",
                       strata_path: str | None = None, parity_seed: int | None = None, weight: str = "bytes",
                       k: int = 20, hitters_by: str = "flow", fill: bool = False, predicate=None) -> dict[str, str]:
    """Capture files -> stored summaries, with optional pinned strata and the
    seeded table hash (``parity_seed``)."""
    strata, reserved = None, 1
    if strata_path:
        strata, reserved = read_strata(spark, strata_path), reserved_bins(read_strata_lines(spark, strata_path))
    kw = {}
    if parity_seed is not None:
        from ..functions.parity import parity_tables
        kw["parity"] = parity_tables(parity_seed, reserved)
    packets = decode_frames(read_captures(spark, capture_path))
    return summarize_packets(packets, out_path, duration, strata, reserved, weight, k, hitters_by, fill, predicate, **kw)
