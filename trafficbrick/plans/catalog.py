"""Registered queries: one per operator, over the test tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
match the SQL in :mod:`trafficbrick.plans.oracle`. Packets come from
``lineitem`` (see :mod:`trafficbrick.sources.derived`), tumbling windows are
30 days (the derived traffic spans years), bins use no strata unless the query
is about strata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import addr, hashing, timefmt
from ..operators import binning, decode, hitters, summary
from ..session import read_table
from ..sources import derived
from ..sources.strata import read_strata, reserved_bins, reserved_table, strata_from_lines
from . import summary as plan

WINDOW = "30 days"


def _packets(spark, sf):
    return derived.load_packets(spark, sf)


def _binned(spark, sf, strata=False):
    p = _packets(spark, sf)
    if strata:
        lines = derived.strata_lines_from_supplier(read_table(spark, sf, "supplier"))
        return summary.binned_packets(p, WINDOW, strata_from_lines(lines), reserved_bins(lines))
    return summary.binned_packets(p, WINDOW)


# ------------------------------------------------------------------ E / F1 / G
def q_brick(spark, sf):
    return summary.brick(_binned(spark, sf)).select(*summary.WINDOW_COLS, "src_bin", "dst_bin", "cell",
                                                   F.col("bytes").cast("bigint").alias("bytes"))


def q_sub_buckets(spark, sf):
    return summary.sub_buckets(_binned(spark, sf)).withColumn("bytes", F.col("bytes").cast("bigint"))


def q_cell_estimate(spark, sf):
    e = summary.cell_estimate(summary.sub_buckets(_binned(spark, sf)))
    return e.select(*summary.WINDOW_COLS, "cell", F.col("est").cast("bigint").alias("est"),
                    F.col("cell_bytes").cast("bigint").alias("cell_bytes"))


def q_dominant_flow(spark, sf):
    d = plan.dominant_flows(_packets(spark, sf), WINDOW)
    return d.select(*summary.WINDOW_COLS, "cell", "src_ip", "dst_ip", "sport", "dport",
                    F.col("flow_bytes").cast("bigint").alias("flow_bytes"),
                    F.col("cell_bytes").cast("bigint").alias("cell_bytes"))


def q_vote_hitters(spark, sf):
    return hitters.vote_hitters(_binned(spark, sf))


def q_vote_hitters_strata(spark, sf):
    return hitters.vote_hitters(_binned(spark, sf, strata=True))


def q_vote_hitters_packets(spark, sf):
    return hitters.vote_hitters(summary.binned_packets(_packets(spark, sf), WINDOW, weight="packets"))


def q_vote_merged_majority(spark, sf):
    flagged = hitters.merged_majority(summary.kept_packets(_binned(spark, sf)))
    return flagged.where("is_majority").select(*summary.WINDOW_COLS, "cell", "src_ip", "dst_ip")


def q_majority_fraction(spark, sf):
    b = summary.kept_packets(_binned(spark, sf))
    return hitters.majority_fraction(hitters.verify_majority(b, hitters.vote_hitters(b)))


def q_active_cells(spark, sf):
    return summary.active_cells(hitters.vote_hitters(_binned(spark, sf)))


def _summary(spark, sf, strata=True, **kw):
    p = _packets(spark, sf)
    if strata:
        lines = derived.strata_lines_from_supplier(read_table(spark, sf, "supplier"))
        return plan.window_summary(p, WINDOW, strata_from_lines(lines), reserved_bins(lines), **kw)
    return plan.window_summary(p, WINDOW, **kw)


def q_vote_top_hitters(spark, sf):
    """The native pipeline: vote candidates ranked by the cell estimate."""
    t = _summary(spark, sf, strata=False, hitters_by="vote").top
    return t.select(*summary.WINDOW_COLS, "rank", "cell", "src_ip", "dst_ip", "sport", "dport", "est")


def q_vote_hitter_report(spark, sf):
    return _summary(spark, sf, hitters_by="vote").report


def q_vote_packets_report(spark, sf):
    return _summary(spark, sf, strata=False, hitters_by="vote", weight="packets").report


def q_vote_documents(spark, sf):
    return _summary(spark, sf, hitters_by="vote").documents


FILL_WINDOW = "1 hour"


def q_dense_brick_filled(spark, sf):
    """Hourly documents of the second device, silent hours included."""
    return plan.window_summary(derived.load_event_packets(spark, sf), FILL_WINDOW, fill=True).documents


def q_top_hitters(spark, sf):
    t = _summary(spark, sf, strata=False).top
    return t.select(*summary.WINDOW_COLS, "rank", "cell", "src_ip", "dst_ip", "sport", "dport", "est")


def q_hitter_report(spark, sf):
    return _summary(spark, sf).report


def q_summary_cells(spark, sf):
    c = _summary(spark, sf).cells
    return c.select(*summary.WINDOW_COLS, "cell", "src_bin", "dst_bin", "bytes", "est", "src_ip", "dst_ip",
                    "sport", "dport")


def q_dense_brick(spark, sf):
    return _summary(spark, sf).documents


# ------------------------------------------------------------------ D / A5
def q_hash17(spark, sf):
    p = _packets(spark, sf)
    return p.select("seq", "src_ip", hashing.hash17("src_ip").alias("src_hash"),
                    hashing.hash17("dst_ip").alias("dst_hash"))


def q_hash_bin(spark, sf):
    p = _packets(spark, sf)
    return p.select("seq", "src_ip", "dst_ip",
                    hashing.hash_bin(hashing.hash17("src_ip"), 1).alias("src_bin"),
                    hashing.hash_bin(hashing.hash17("dst_ip"), 7).alias("dst_bin7"))


def q_cell(spark, sf):
    b = _binned(spark, sf)
    return b.select("seq", "src_ip", "dst_ip", "src_bin", "dst_bin", "cell")


def q_sub_bucket(spark, sf):
    p = _packets(spark, sf)
    return p.select("seq", "src_ip", hashing.sub_bucket(hashing.hash17("src_ip")).alias("sub"))


def q_strata_last_wins(spark, sf):
    lines = derived.strata_lines_from_supplier(read_table(spark, sf, "supplier"))
    return strata_from_lines(lines)


def q_reserved_bins(spark, sf):
    lines = derived.strata_lines_from_supplier(read_table(spark, sf, "supplier"))
    return reserved_table(lines)


def q_assign_bin(spark, sf):
    b = _binned(spark, sf, strata=True)
    return b.select("seq", "src_ip", "dst_ip", "src_bin", "dst_bin", "cell", "sub")


def q_brick_strata(spark, sf):
    return summary.brick(_binned(spark, sf, strata=True)).select(
        *summary.WINDOW_COLS, "src_bin", "dst_bin", "cell", F.col("bytes").cast("bigint").alias("bytes"))


# ------------------------------------------------------------------ C
def q_ip_text(spark, sf):
    p = _packets(spark, sf)
    return p.select("seq", "src_ip", addr.ip_to_string("src_ip").alias("src_text"),
                    addr.ip_to_string("dst_ip").alias("dst_text"),
                    addr.ip_from_string(addr.ip_to_string("dst_ip")).alias("dst_back"))


def q_flow_label(spark, sf):
    p = _packets(spark, sf)
    return p.select("seq", addr.flow_label("src_ip", "sport", "dst_ip", "dport").alias("label"))


def q_octets(spark, sf):
    p = _packets(spark, sf)
    return p.select("seq", "src_ip", *[addr.octet("src_ip", i).alias(f"o{i}") for i in (1, 2, 3, 4)])


def q_low_high16(spark, sf):
    p = _packets(spark, sf)
    return p.select("seq", "dst_ip", addr.low16("dst_ip").alias("lo16"), addr.high16("dst_ip").alias("hi16"))


def q_prefix17(spark, sf):
    p = _packets(spark, sf)
    return p.select("seq", "src_ip", addr.prefix17("src_ip").alias("src_prefix17"),
                    addr.prefix17("dst_ip").alias("dst_prefix17"))


def q_delta_ms(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", timefmt.delta_ms(F.col("ts"), F.date_trunc("day", F.col("ts"))).alias("ms"))


def q_duration_text(spark, sf):
    e = read_table(spark, sf, "events")
    ms = F.timestamp_diff("MILLISECOND", F.lit("2023-12-25 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return e.select("event_id", ms.alias("ms"), timefmt.duration_string(ms).alias("text"))


def q_format_count(spark, sf):
    b = summary.brick(_binned(spark, sf))
    return b.select(*summary.WINDOW_COLS, "cell", timefmt.format_count(F.col("bytes"), 0).alias("bytes_text"))


QUERIES = {
    "brick": q_brick,
    "sub_buckets": q_sub_buckets,
    "cell_estimate": q_cell_estimate,
    "dominant_flow": q_dominant_flow,
    "vote_hitters": q_vote_hitters,
    "vote_hitters_strata": q_vote_hitters_strata,
    "vote_hitters_packets": q_vote_hitters_packets,
    "vote_top_hitters": q_vote_top_hitters,
    "vote_hitter_report": q_vote_hitter_report,
    "vote_packets_report": q_vote_packets_report,
    "vote_documents": q_vote_documents,
    "dense_brick_filled": q_dense_brick_filled,
    "vote_merged_majority": q_vote_merged_majority,
    "majority_fraction": q_majority_fraction,
    "active_cells": q_active_cells,
    "top_hitters": q_top_hitters,
    "hitter_report": q_hitter_report,
    "summary_cells": q_summary_cells,
    "dense_brick": q_dense_brick,
    "hash17": q_hash17,
    "hash_bin": q_hash_bin,
    "cell": q_cell,
    "sub_bucket": q_sub_bucket,
    "strata_last_wins": q_strata_last_wins,
    "reserved_bins": q_reserved_bins,
    "assign_bin": q_assign_bin,
    "brick_strata": q_brick_strata,
    "ip_text": q_ip_text,
    "flow_label": q_flow_label,
    "octets": q_octets,
    "low_high16": q_low_high16,
    "prefix17": q_prefix17,
    "delta_ms": q_delta_ms,
    "duration_text": q_duration_text,
    "format_count": q_format_count,
}


# ------------------------------------------------------------------ A3 / A4 / B
from ..operators import rates, store, view  # noqa: E402
from ..session import scratch_path  # noqa: E402
from ..sources.devices import union_devices  # noqa: E402
from ..functions.hashing import BRICK_DIM  # noqa: E402

TOTALS_WINDOW = "1 day"
TRUNC_SNAPLEN = 40
RETAIN_BYTES = 5_000_000


def _all_packets(spark, sf):
    return union_devices({"eth0": derived.load_packets(spark, sf), "eth1": derived.load_event_packets(spark, sf)})


def _frames(spark, sf):
    return derived.frames_from_packets(_all_packets(spark, sf))


def q_union_devices(spark, sf):
    return _all_packets(spark, sf)


def q_decode_frames(spark, sf):
    return decode.decode_frames(_frames(spark, sf))


def q_packet_weight(spark, sf):
    p = _all_packets(spark, sf)
    return (decode.with_weight(decode.with_weight(p, "bytes", "w_bytes"), "packets", "w_packets")
            .select("device", "seq", "w_bytes", "w_packets"))


def q_line_bytes(spark, sf):
    return decode.with_line_bytes(_all_packets(spark, sf)).select("device", "seq", "wire_len", "line_bytes")


def q_filter_packets(spark, sf):
    f = decode.filter_packets(_all_packets(spark, sf), "dport = 443 AND wire_len > 1000")
    return decode.filter_packets(f, F.col("eth_type") == 2048).select("device", "seq", "src_ip", "dst_ip", "wire_len")


def q_first_seen(spark, sf):
    return decode.first_seen(_frames(spark, sf), by="device")


def q_truncate_frames(spark, sf):
    t = decode.truncate_frames(_frames(spark, sf), TRUNC_SNAPLEN)
    return t.select("device", "seq", "cap_len", "wire_len", F.hex("frame").alias("frame_hex"))


def q_mac_text(spark, sf):
    fr = _frames(spark, sf)
    return fr.select("device", "seq", addr.mac_to_string(F.substring("frame", 1, 6)).alias("dst_mac"),
                     addr.mac_to_string(F.substring("frame", 7, 6)).alias("src_mac"))


# ------------------------------------------------------------------ E9 / E11 / F3 / F4
def _totals(spark, sf, by_device=True):
    """The totals as a written table (one row per interval): the rates read it more than once."""
    path = scratch_path(spark, "totals")
    summary.traffic_totals(_all_packets(spark, sf), TOTALS_WINDOW, by_device).write.parquet(path)
    return spark.read.parquet(path)


def q_traffic_totals(spark, sf):
    return summary.traffic_totals(_all_packets(spark, sf), TOTALS_WINDOW)


def q_global_rates(spark, sf):
    """Rates of the whole monitor, over all devices."""
    return rates.cumulative_rates(_totals(spark, sf, by_device=False), keys=())


def q_capture_totals(spark, sf):
    return summary.capture_totals(derived.capture_stats_from_events(read_table(spark, sf, "events")))


def q_cumulative_rates(spark, sf):
    return rates.cumulative_rates(_totals(spark, sf))


def q_interval_rates(spark, sf):
    return rates.interval_rates(rates.cumulative_rates(_totals(spark, sf)))


# ------------------------------------------------------------------ documents and view
def _docs(spark, sf):
    return _summary(spark, sf).documents


def q_stored_bricks(spark, sf):
    path = scratch_path(spark, "bricks")
    store.write_bricks(_docs(spark, sf), path)
    return store.read_bricks(spark, path).select("ts", "data", "hitters")


def _store(spark, sf):
    path = scratch_path(spark, "bricks")
    store.write_bricks(_docs(spark, sf), path)
    return store.read_bricks(spark, path)


def q_latest_brick(spark, sf):
    return store.latest_brick(_store(spark, sf)).select("ts", "data", "hitters")


def q_retain_bricks(spark, sf):
    return store.retain_bricks(_store(spark, sf), RETAIN_BYTES).select("ts", "size_bytes", "data", "hitters")


def q_evict_bricks(spark, sf):
    """The store after its oldest documents were dropped to fit the cap; what is read is what is left on disk."""
    path = scratch_path(spark, "bricks")
    store.write_bricks(_docs(spark, sf), path)
    store.evict_bricks(spark, path, RETAIN_BYTES)
    return store.read_bricks(spark, path).select("ts", "size_bytes", "data", "hitters")


def q_dashboard(spark, sf):
    """The dashboard read: the newest stored document as one JSON payload."""
    newest = store.latest_brick(_store(spark, sf)).select("ts", "data", "hitters")
    return view.cells_payload(view.with_hitter_label(view.with_category(view.brick_to_cells(newest))))


def q_brick_cells(spark, sf):
    return view.brick_to_cells(_docs(spark, sf))


def q_categories(spark, sf):
    cells = view.brick_to_cells(_docs(spark, sf))
    return view.with_category(cells).select("ts", "x", "y", "traffic", "category", "color")


def q_hitter_default(spark, sf):
    cells = view.brick_to_cells(_docs(spark, sf))
    return view.with_hitter_label(cells).select("ts", "x", "y", "hitters")


def q_payload(spark, sf):
    cells = view.with_hitter_label(view.with_category(view.brick_to_cells(_docs(spark, sf))))
    return view.cells_payload(cells)


QUERIES.update({
    "union_devices": q_union_devices,
    "decode_frames": q_decode_frames,
    "packet_weight": q_packet_weight,
    "line_bytes": q_line_bytes,
    "filter_packets": q_filter_packets,
    "first_seen": q_first_seen,
    "truncate_frames": q_truncate_frames,
    "mac_text": q_mac_text,
    "traffic_totals": q_traffic_totals,
    "capture_totals": q_capture_totals,
    "cumulative_rates": q_cumulative_rates,
    "interval_rates": q_interval_rates,
    "global_rates": q_global_rates,
    "dashboard": q_dashboard,
    "stored_bricks": q_stored_bricks,
    "latest_brick": q_latest_brick,
    "retain_bricks": q_retain_bricks,
    "evict_bricks": q_evict_bricks,
    "brick_cells": q_brick_cells,
    "categories": q_categories,
    "hitter_default": q_hitter_default,
    "payload": q_payload,
})


# ------------------------------------------------------------------ A1 capture files
from ..sources import captures  # noqa: E402


def q_read_captures(spark, sf):
    """Frames -> pcap files (written by the executors) -> read back -> decode."""
    path = scratch_path(spark, "captures")
    captures.write_captures(_frames(spark, sf), path).write.format("noop").mode("overwrite").save()
    d = decode.decode_frames(captures.read_captures(spark, path))
    return d.select("ts", "eth_type", "vlan_id", "ip_proto", "src_ip", "dst_ip", "sport", "dport", "wire_len")


SPLIT_BYTES = 256 << 10


def q_read_captures_split(spark, sf):
    """The same with capture files read in splits, each by a task of its own."""
    path = scratch_path(spark, "captures")
    captures.write_captures(_frames(spark, sf), path).write.format("noop").mode("overwrite").save()
    d = decode.decode_frames(captures.read_captures(spark, path, split_bytes=SPLIT_BYTES))
    return d.select("ts", "eth_type", "vlan_id", "ip_proto", "src_ip", "dst_ip", "sport", "dport", "wire_len")


def q_capture_report(spark, sf):
    """Sound records and lost bytes of the capture files, over all of them."""
    path = scratch_path(spark, "captures")
    captures.write_captures(_frames(spark, sf), path).write.format("noop").mode("overwrite").save()
    return captures.capture_report(spark, path, split_bytes=SPLIT_BYTES).agg(
        F.sum("records").alias("records"), F.sum("lost_bytes").alias("lost_bytes"))


QUERIES.update({"read_captures": q_read_captures, "read_captures_split": q_read_captures_split, "capture_report": q_capture_report})


def q_read_strata_file(spark, sf):
    """Strata lines written as a text file and read back with the last line of a prefix winning."""
    path = scratch_path(spark, "strata")
    lines = derived.strata_lines_from_supplier(read_table(spark, sf, "supplier"))
    # a strata file is one ordered file: of each 17-bit prefix its last line alone goes in, 131,072 lines at most
    last = (lines.withColumn("prefix17", addr.prefix17("ip")).groupBy("prefix17")
                 .agg(F.max("line_no").alias("line_no"), F.max_by("ip", "line_no").alias("ip"), F.max_by("bin", "line_no").alias("bin")))
    (last.orderBy("line_no").select(F.concat_ws(" ", "ip", "bin").alias("value")).coalesce(1).write.text(path))
    return read_strata(spark, path)


QUERIES["read_strata_file"] = q_read_strata_file


# ------------------------------------------------------------------ F5 / F6 / A2 streaming
from ..schemas import PACKET_COLUMNS  # noqa: E402
from ..streaming import bricks as sbricks, fixtures as sfix, rates as srates, vote as svote  # noqa: E402
from ..streaming.start import start  # noqa: E402


# the files of a stream source are listed by the time they were written, which need not
# be the packets' time: a delay longer than any disorder keeps every row on time
DELAY = "3650 days"
TURNS = 6               # micro-batches of a stream whose files are written in time order
TURN_ROWS = 4_000_000   # and as many more as keep each to so many packets
FILE_ROWS = 100_000     # a micro-batch is as many files as hold so many packets each, one a core at most


def _state_partitions(spark):
    return max(8, spark.sparkContext.defaultParallelism)


def _stream_source(spark, sf):
    path = scratch_path(spark, "packet-stream")
    sfix.write_packet_stream(_packets(spark, sf), path)
    return path


def _ordered_stream(spark, packets, closing=sfix.SENTINEL_TS):
    """A stream of ``packets`` in time order, one turn a micro-batch."""
    path = scratch_path(spark, "ordered-stream")
    rows = packets.count()
    turns = max(TURNS, -(-rows // TURN_ROWS))
    files = max(1, min(spark.sparkContext.defaultParallelism, rows // turns // FILE_ROWS))
    sfix.write_ordered_stream(packets, path, turns, closing, files)
    return sfix.read_packet_stream(spark, path, files)


def _run_to_table(spark, stream, name):
    """Run ``stream`` to its end; what it put out."""
    out = scratch_path(spark, name)
    w = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
               .option("checkpointLocation", scratch_path(spark, f"{name}-ckpt")).trigger(availableNow=True))
    start(spark, w, _state_partitions(spark)).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def q_stream_bricks(spark, sf):
    """Packets as a file stream -> windowed flow state -> closed windows rolled up per micro-batch."""
    src = _stream_source(spark, sf)
    out = scratch_path(spark, "stream-bricks")
    q = sbricks.stream_bricks(sfix.read_packet_stream(spark, src), out, scratch_path(spark, "stream-bricks-ckpt"),
                              duration=WINDOW, watermark=DELAY, state_partitions=_state_partitions(spark))
    q.awaitTermination()
    c = sbricks.read_stream_output(spark, out, "cells")
    return c.select(*summary.WINDOW_COLS, "cell", "src_bin", "dst_bin", "bytes", "est", "src_ip", "dst_ip",
                    "sport", "dport")


def q_stream_vote(spark, sf):
    """Ordered vote with per-cell state over several micro-batches in time order, emitted on window close."""
    return _run_to_table(spark, svote.stream_vote(_ordered_stream(spark, _packets(spark, sf)), WINDOW), "stream-vote")


def _live(spark, stream, name, **kw):
    out = scratch_path(spark, name)
    sbricks.stream_bricks(stream, out, scratch_path(spark, f"{name}-ckpt"), state_partitions=_state_partitions(spark),
                          **kw).awaitTermination()
    return out


def q_stream_vote_report(spark, sf):
    """The live native pipeline: votes and estimates joined as windows close, ranked and reported."""
    lines = derived.strata_lines_from_supplier(read_table(spark, sf, "supplier"))
    out = _live(spark, _ordered_stream(spark, _packets(spark, sf)), "stream-vote-report", duration=WINDOW, hitters_by="vote",
                strata=strata_from_lines(lines), reserved=reserved_bins(lines))
    return sbricks.read_stream_output(spark, out, "report").select(*summary.WINDOW_COLS, "rank", "line")


def q_stream_dense_filled(spark, sf):
    """Hourly documents of the second device as they close, silent hours included."""
    packets = derived.load_event_packets(spark, sf)
    # the closing packet comes at the end of the last window with IPv4 traffic, so no silent one follows
    last = summary.with_window(decode.ipv4_only(packets), FILL_WINDOW).agg(F.max("window_end")).first()[0]
    stream = _ordered_stream(spark, packets.where(F.col("ts") < F.lit(last)), str(last))
    out = _live(spark, stream, "stream-filled", duration=FILL_WINDOW, fill=True)
    return sbricks.read_stream_output(spark, out, "documents").select("ts", "data", "hitters")


def q_stream_interval_rates(spark, sf):
    """Rates since the last sample of each device, one row a tick."""
    stream = _ordered_stream(spark, _all_packets(spark, sf))
    return _run_to_table(spark, srates.stream_rates(stream, TOTALS_WINDOW, since="last"), "stream-rates").where("device <> 'sentinel'")


def q_stream_global_rates(spark, sf):
    """Counters and rates of the whole monitor since its start, one row a tick."""
    stream = _ordered_stream(spark, _all_packets(spark, sf))
    return _run_to_table(spark, srates.stream_rates(stream, TOTALS_WINDOW, by_device=False), "stream-global-rates")


def q_stream_capture_totals(spark, sf):
    """Drop figures of capture counters that arrive as a stream; a later sample without counts closes the last one."""
    path = scratch_path(spark, "capture-stats")
    stats = derived.capture_stats_from_events(read_table(spark, sf, "events"))
    stats.repartitionByRange("ts").write.parquet(path)
    (spark.range(1).select(F.lit(sfix.SENTINEL_TS).cast("timestamp_ntz").alias("ts"), F.lit("").alias("device"),
                           F.lit(0).cast("bigint").alias("recv"), F.lit(0).cast("bigint").alias("drop")).write.mode("append").parquet(path))
    stream = spark.readStream.schema(stats.schema).parquet(path)
    return _run_to_table(spark, srates.stream_capture_totals(stream, DELAY), "stream-capture-totals")


def q_stream_captures(spark, sf):
    """Capture files picked up by a file stream (A2), decoded and summarised."""
    path = scratch_path(spark, "stream-captures")
    frames = derived.frames_from_packets(_packets(spark, sf))
    captures.write_captures(frames, path).write.format("noop").mode("overwrite").save()
    sfix_path = scratch_path(spark, "stream-captures-sentinel")
    sfix.write_packet_stream(_packets(spark, sf).limit(0), sfix_path)  # sentinel only
    captures.write_captures(derived.frames_from_packets(spark.read.parquet(sfix_path)), path + "/sentinel", 1) \
        .write.format("noop").mode("overwrite").save()
    packets = decode.decode_frames(captures.stream_captures(spark, path))
    out = scratch_path(spark, "stream-captures-out")
    q = sbricks.stream_bricks(packets, out, scratch_path(spark, "stream-captures-ckpt"), duration=WINDOW,
                              watermark=DELAY, state_partitions=_state_partitions(spark))
    q.awaitTermination()
    return sbricks.read_stream_output(spark, out, "cells").select(
        *summary.WINDOW_COLS, "cell", "src_bin", "dst_bin", "bytes", "est")


def q_stream_late(spark, sf):
    """Every eighth packet arrives only after its window has closed, and is not counted."""
    packets = _packets(spark, sf)
    late = F.col("seq") % 8 == 7
    src, out, ckpt = (scratch_path(spark, f"stream-late-{n}") for n in ("in", "out", "ckpt"))

    def run():
        sbricks.stream_bricks(sfix.read_packet_stream(spark, src), out, ckpt, duration=WINDOW, watermark=DELAY,
                              state_partitions=_state_partitions(spark)).awaitTermination()

    sfix.write_packet_stream(packets.where(~late), src)
    run()
    packets.where(late).select(*PACKET_COLUMNS).write.mode("append").parquet(src)
    run()
    return sbricks.read_stream_output(spark, out, "cells").select(*summary.WINDOW_COLS, "cell", "bytes", "est")


QUERIES.update({"stream_late": q_stream_late, "stream_bricks": q_stream_bricks, "stream_vote": q_stream_vote, "stream_captures": q_stream_captures,
                "stream_vote_report": q_stream_vote_report, "stream_dense_filled": q_stream_dense_filled,
                "stream_interval_rates": q_stream_interval_rates, "stream_global_rates": q_stream_global_rates,
                "stream_capture_totals": q_stream_capture_totals})


# ------------------------------------------------------------------ D1/D2 seeded tables at scale
from ..functions.parity import parity_tables  # noqa: E402

PARITY_SEED = 134


def q_brick_parity(spark, sf):
    """The brick with the seeded table hash and pinned strata (bins as a native
    monitor seeded the same way would draw them)."""
    lines = derived.strata_lines_from_supplier(read_table(spark, sf, "supplier"))
    reserved = reserved_bins(lines)
    p = summary.binned_packets(_packets(spark, sf), WINDOW, strata_from_lines(lines), reserved,
                               parity=parity_tables(PARITY_SEED, reserved))
    return summary.brick(p).select(*summary.WINDOW_COLS, "src_bin", "dst_bin", "cell",
                                   F.col("bytes").cast("bigint").alias("bytes"))


QUERIES["brick_parity"] = q_brick_parity


# ------------------------------------------------------------------ offline job (captures -> stored summaries)
from . import offline  # noqa: E402


def q_offline_summary(spark, sf):
    """pcap files written from the packets -> the offline job -> stored top-20 report."""
    path = scratch_path(spark, "offline-captures")
    captures.write_captures(derived.frames_from_packets(_packets(spark, sf)), path) \
        .write.format("noop").mode("overwrite").save()
    out = offline.summarize_captures(spark, path, scratch_path(spark, "offline-out"), duration=WINDOW)
    return spark.read.parquet(out["top"]).select(*summary.WINDOW_COLS, "rank", "cell", "src_ip", "dst_ip", "est")


QUERIES["offline_summary"] = q_offline_summary
