"""End-to-end window summary: brick, sub-bucket estimates, hitters, top-k, documents.

The plan aggregates packets **once** to flows ``(window, src, dst)`` -- with
map-side combine, so the packet shuffle carries at most one row per flow per
task -- then bins the flows (hash + broadcast strata lookup on flows, not on
packets) and rolls them up twice: to ``(window, cell, sub)`` and to
``(window, cell)``. Those later shuffles carry at most 16,384 x 256 and 16,384
rows per window. Brick, estimates and the exact hitter all come out of that
single pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import BRICK_DIM
from ..functions.timecols import wallclock_micros
from ..operators import keys as K
from ..operators.binning import assign_bins
from ..operators.decode import ipv4_only, with_weight
from ..operators.hitters import flow_sums, hitter_report, top_hitters, vote_hitters
from ..operators.summary import WINDOW_COLS, binned_packets, dense_brick, kept_packets, with_window


@dataclass
class WindowSummary:
    flows: DataFrame      # window, src_ip, dst_ip, bytes, packets, p{sport,dport}, bins...
    cells: DataFrame      # window, cell, src_bin, dst_bin, bytes, est, hitter columns
    top: DataFrame        # top-k hitters per window
    report: DataFrame     # report lines
    documents: DataFrame  # dense per-window documents


def flows_of(packets: DataFrame, duration: str, weight: str = "bytes") -> DataFrame:
    """Packets -> flows ``(window, src_ip, dst_ip, bytes, packets, pp)``; ``pp``
    packs the ports of the flow's first packet."""
    p = with_window(with_weight(ipv4_only(packets), weight), duration)
    first = K.first_packet_key(wallclock_micros(F.col("ts")), F.col("seq"))
    return (p.groupBy(*WINDOW_COLS, "src_ip", "dst_ip")
             .agg(F.sum("w").alias("bytes"), F.count(F.lit(1)).alias("packets"),
                  F.min_by(K.pack_ports(F.col("sport"), F.col("dport")), first).alias("pp")))


def cells_of(binned_flows: DataFrame, dim: int = BRICK_DIM) -> DataFrame:
    """Roll binned flows up to cells: total bytes, estimate and dominant flow.

    Two hash aggregations: by (window, cell, sub) then by (window, cell). The
    dominant flow travels as a packed key (weight, src, dst) that is unique
    per flow, so every ``max_by`` below picks the same flow.
    """
    rk = F.when(F.col("src_ip") != 0, K.heavy_key(F.col("bytes"), F.col("src_ip"), F.col("dst_ip")))
    f = binned_flows.withColumn("rk", rk)
    subs = (f.groupBy(*WINDOW_COLS, "cell", "sub")
             .agg(F.sum("bytes").alias("sub_bytes"), F.max("rk").alias("rk"),
                  F.max_by("src_ip", "rk").alias("src_ip"), F.max_by("dst_ip", "rk").alias("dst_ip"),
                  F.max_by("pp", "rk").alias("pp"), F.max_by("bytes", "rk").alias("fb")))
    cells = (subs.groupBy(*WINDOW_COLS, "cell")
                 .agg(F.sum("sub_bytes").alias("bytes"), F.max("sub_bytes").alias("est"), F.max("rk").alias("rk"),
                      F.max_by("src_ip", "rk").alias("src_ip"), F.max_by("dst_ip", "rk").alias("dst_ip"),
                      F.max_by("pp", "rk").alias("pp"), F.max_by("fb", "rk").alias("fb")))
    return cells.select(
        *WINDOW_COLS, "cell",
        (F.col("cell") / F.lit(dim)).cast("int").alias("src_bin"), (F.col("cell") % dim).cast("int").alias("dst_bin"),
        F.col("bytes").cast("bigint").alias("bytes"), F.col("est").cast("bigint").alias("est"),
        F.coalesce(F.col("src_ip"), F.lit(0).cast("bigint")).alias("src_ip"),
        F.coalesce(F.col("dst_ip"), F.lit(0).cast("bigint")).alias("dst_ip"),
        F.coalesce(K.sport_of(F.col("pp")), F.lit(0)).alias("sport"),
        F.coalesce(K.dport_of(F.col("pp")), F.lit(0)).alias("dport"),
        F.col("fb").cast("bigint").alias("flow_bytes"),
    )


def with_candidates(cells: DataFrame, votes: DataFrame) -> DataFrame:
    """``cells`` with the hitter columns of the vote's candidates (0 where a cell has none)."""
    plain = cells.drop("src_ip", "dst_ip", "sport", "dport", "flow_bytes")
    v = votes.select(*WINDOW_COLS, "cell", "src_ip", "dst_ip", "sport", "dport", F.col("count").alias("flow_bytes"))
    return plain.join(v, [*WINDOW_COLS, "cell"], "left").na.fill(0, ["src_ip", "dst_ip", "sport", "dport", "flow_bytes"])


def window_summary(packets: DataFrame, duration: str = "3 seconds", strata: DataFrame | None = None,
                   reserved: int = 1, weight: str = "bytes", k: int = 20, dim: int = BRICK_DIM,
                   hitters_by: str = "flow", fill: bool = False, **bin_kw) -> WindowSummary:
    """The whole summary of ``packets``.

    ``hitters_by="flow"`` names each cell's exact heaviest flow; ``"vote"`` runs
    the native pipeline: candidates of the ordered vote, ranked by the cell
    estimate, reported and written to the documents. ``fill`` adds documents for
    windows without traffic.
    """
    if hitters_by not in ("flow", "vote"):
        raise ValueError("hitters_by must be 'flow' or 'vote'")
    if hitters_by == "vote":
        # the votes need the packets, in order: bin once, then fold and sum what is written
        binned = kept_packets(binned_packets(packets, duration, strata, reserved, weight, dim=dim, **bin_kw))
        flows = flow_sums(binned, "sub", "src_bin", "dst_bin")
        cells = with_candidates(cells_of(flows, dim), vote_hitters(binned))
    else:
        flows = assign_bins(flows_of(packets, duration, weight), strata, reserved, dim=dim, **bin_kw)
        cells = cells_of(flows, dim)
    hitters = cells.where(F.col("src_ip") != 0)
    top = top_hitters(hitters, k=k)
    unit = "bytes" if weight == "bytes" else "packets"
    return WindowSummary(flows, cells, top, hitter_report(top, unit),
                         dense_brick(cells, dim, fill))


def dominant_flows(packets: DataFrame, duration: str = "3 seconds", strata: DataFrame | None = None,
                   reserved: int = 1, weight: str = "bytes", dim: int = BRICK_DIM, **bin_kw) -> DataFrame:
    """Exact heaviest flow per cell (E6) from raw packets, flows-first.

    Packets combine map-side into flows, only the flows are binned, and one
    more hash aggregation picks each cell's heaviest flow. Source 0 never
    names a flow and is not part of the cell total here.
    """
    from ..operators.hitters import pick_dominant
    f = flows_of(packets, duration, weight).where(F.col("src_ip") != 0)
    return pick_dominant(assign_bins(f, strata, reserved, dim=dim, **bin_kw))
