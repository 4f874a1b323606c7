"""Stream = batch over several micro-batches."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trafficbrick.functions.parity import parity_tables
from trafficbrick.operators import decode, hitters, rates, summary
from trafficbrick.plans import catalog
from trafficbrick.plans import summary as plan
from trafficbrick.schemas import PACKETS
from trafficbrick.session import scratch_path, ship_package
from trafficbrick.sources.derived import load_event_packets, load_packets
from trafficbrick.streaming import bricks, fixtures, vote
from trafficbrick.streaming import rates as srates
from trafficbrick.streaming.start import COUNT_ROWS, start

T0 = dt.datetime(2024, 1, 1)


def run_to_table(spark, stream):
    ship_package(spark)
    out = scratch_path(spark, "t-out")
    q = start(spark, stream.writeStream.outputMode("append").format("parquet").option("path", out)
              .option("checkpointLocation", scratch_path(spark, "t-ckpt")).trigger(availableNow=True), 4)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), [p.numInputRows for p in q.recentProgress]


def same(got, want):
    got = got.select(want.columns)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def packet(seconds, seq, w=100, src=167772161, dst=134744072, eth=2048):
    return (T0 + dt.timedelta(seconds=seconds), "eth0", seq, eth, 0, 6, src, dst, 1000 + seq, 80, w)


def test_stream_bricks_equals_batch(spark, sf_small):
    p = load_packets(spark, sf_small)
    src = scratch_path(spark, "t-stream")
    fixtures.write_packet_stream(p, src, files=5)
    out = scratch_path(spark, "t-stream-out")
    # a watermark delay longer than any file disorder: nothing is late, the sentinel closes all windows
    q = bricks.stream_bricks(fixtures.read_packet_stream(spark, src, max_files_per_trigger=2), out,
                             scratch_path(spark, "t-ckpt"), duration="30 days", watermark="3650 days")
    q.awaitTermination()
    cells = bricks.read_stream_output(spark, out, "cells").drop("batch_id")
    batch = plan.window_summary(p, "30 days").cells.drop("flow_bytes")
    assert cells.count() == batch.count()
    assert cells.select(batch.columns).exceptAll(batch).count() == 0
    docs = bricks.read_stream_output(spark, out, "documents")
    assert docs.count() == batch.select("window_start").distinct().count()
    # filed by date: a reader of one day lists that day alone
    assert "date" in docs.columns and docs.where(F.col("date") != F.to_date("ts")).count() == 0


def test_stream_vote_equals_batch_over_micro_batches(spark, sf_small):
    p = load_packets(spark, sf_small)
    src = scratch_path(spark, "t-vote")
    fixtures.write_ordered_stream(p, src, 6)
    v, rows = run_to_table(spark, vote.stream_vote(fixtures.read_packet_stream(spark, src, 1), "30 days", slices=8))
    assert sum(n > 1 for n in rows) >= 5
    same(v, hitters.vote_hitters(summary.binned_packets(p, "30 days")).select(v.columns))


def test_stream_vote_drops_late_rows(spark):
    """Rows of a closed window are dropped, whether its state is gone or never was; rows of an
    open window behind the watermark count."""
    src = scratch_path(spark, "t-vote-late")
    batches = [[packet(s, s) for s in range(10)],
               [packet(9.5, 20, 5000, src=7), packet(1, 21, 9000, src=8), packet(20, 22)],
               [packet(2, 23, 9000, src=9), packet(10.5, 24, 9000, src=9), packet(3600, 25)]]
    for rows in batches:
        spark.createDataFrame(rows, PACKETS).coalesce(1).write.mode("append").parquet(src)
    v, _ = run_to_table(spark, vote.stream_vote(fixtures.read_packet_stream(spark, src, 1), "10 seconds", "3 seconds", slices=2))
    got = {(r.window_start, r.src_ip): r["count"] for r in v.collect()}
    # the second batch meets a watermark of 6 s: its rows are in time, in touched cells and new ones; the third
    # meets 17 s: the row at 2 s is late, that at 10.5 s belongs to a window that is still open
    assert got == {(T0, 167772161): 1000, (T0, 7): 5000, (T0, 8): 9000, (T0 + dt.timedelta(seconds=10), 9): 9000,
                   (T0 + dt.timedelta(seconds=20), 167772161): 100}


def test_votes_and_estimates_join_live(spark, sf_small):
    p = load_packets(spark, sf_small)
    src, out = scratch_path(spark, "t-join"), scratch_path(spark, "t-join-out")
    fixtures.write_ordered_stream(p, src, 5)
    ship_package(spark)
    bricks.stream_bricks(fixtures.read_packet_stream(spark, src, 1), out, scratch_path(spark, "t-join-ckpt"), duration="30 days",
                         hitters_by="vote", state_partitions=4, slices=8).awaitTermination()
    want = plan.window_summary(p, "30 days", hitters_by="vote")
    same(bricks.read_stream_output(spark, out, "cells"), want.cells.drop("flow_bytes"))
    same(bricks.read_stream_output(spark, out, "report"), want.report)
    same(bricks.read_stream_output(spark, out, "documents"), want.documents)
    with pytest.raises(ValueError):
        bricks.closed_windows(p, "30 days", "0 seconds", hitters_by="other")


def test_silent_windows_get_documents(spark):
    """A gap of several windows, one with traffic that is not IPv4 only, and silent windows at the end."""
    rows = [packet(1, 1), packet(2, 2), packet(16, 3), packet(17, 4, eth=34525), packet(22, 5, eth=34525), packet(31, 6)]
    src, out = scratch_path(spark, "t-fill"), scratch_path(spark, "t-fill-out")
    for r in (rows[:2], rows[2:4], rows[4:5], rows[5:], [packet(39, 7, eth=34525)]):
        spark.createDataFrame(r, PACKETS).coalesce(1).write.mode("append").parquet(src)
    ship_package(spark)
    q = bricks.stream_bricks(fixtures.read_packet_stream(spark, src, 1), out, scratch_path(spark, "t-fill-ckpt"),
                             duration="3 seconds", fill=True, state_partitions=4)
    q.awaitTermination()
    docs = bricks.read_stream_output(spark, out, "documents").select("ts", "data", "hitters")
    batch = plan.window_summary(spark.createDataFrame(rows, PACKETS), "3 seconds", fill=True).documents
    live = docs.where(F.col("ts") <= F.lit(T0 + dt.timedelta(seconds=33)))
    same(live, batch)
    later = sorted((r.ts, sum(r.data)) for r in docs.where(F.col("ts") > F.lit(T0 + dt.timedelta(seconds=33))).collect())
    assert later == [(T0 + dt.timedelta(seconds=36), 0), (T0 + dt.timedelta(seconds=39), 0)]
    # the same windows again from a replayed batch: nothing is added
    n = bricks.read_stream_output(spark, out, "cells").count()
    rows_of = plan.flows_of(spark.createDataFrame(rows[:2], PACKETS), "3 seconds")
    batch_id = bricks.read_stream_output(spark, out, "cells").agg(F.min("batch_id")).first()[0]
    bricks.write_closed(rows_of, out, batch_id)
    assert bricks.read_stream_output(spark, out, "cells").count() == n


def test_live_rates_equal_batch(spark, sf_small):
    p = load_event_packets(spark, sf_small).unionByName(load_packets(spark, sf_small).where("seq % 3 = 0"))
    src = scratch_path(spark, "t-rates")
    fixtures.write_ordered_stream(p, src, 5)
    stream = fixtures.read_packet_stream(spark, src, 1)
    totals = summary.traffic_totals(p, "1 day")
    cumulative = rates.cumulative_rates(totals)
    live, _ = run_to_table(spark, srates.stream_rates(stream, "1 day"))
    same(live.where("device <> 'sentinel'"), cumulative)
    last, _ = run_to_table(spark, srates.stream_rates(stream, "1 day", since="last"))
    same(last.where("device <> 'sentinel'"), rates.interval_rates(cumulative))
    with pytest.raises(ValueError):
        srates.stream_rates(stream, "1 day", since="never")


def test_late_rows_are_dropped(spark):
    """a row older than the watermark, arriving in a later micro-batch, is not counted."""
    src = scratch_path(spark, "t-late")
    first = [packet(s, s) for s in range(0, 10)]
    spark.createDataFrame(first, PACKETS).coalesce(1).write.parquet(src + "/b1")
    out = scratch_path(spark, "t-late-out")
    ck = scratch_path(spark, "t-late-ckpt")

    def run():
        q = bricks.stream_bricks(spark.readStream.schema(PACKETS).option("recursiveFileLookup", "true").parquet(src),
                                 out, ck, duration="3 seconds", watermark="2 seconds")
        q.awaitTermination()

    run()  # watermark is now 9 s - 2 s = 7 s: windows [0,3) and [3,6) are closed
    late_and_sentinel = [packet(1, 100, 5000), packet(3600, 101, 1)]
    spark.createDataFrame(late_and_sentinel, PACKETS).coalesce(1).write.parquet(src + "/b2")
    run()
    cells = bricks.read_stream_output(spark, out, "cells")
    got = {r.window_start.second: r.bytes for r in cells.collect() if r.window_start.hour == 0}
    assert got == {0: 300, 3: 300, 6: 300, 9: 100}


@pytest.mark.parametrize("fill", [False, True])
@pytest.mark.parametrize("seeded", [False, True])
def test_closed_rows_are_read_once(spark, fill, seeded):
    """A second reading would run the state of the micro-batch again; ticks go through the roll-up beside the flows."""
    packets = spark.createDataFrame([packet(s, s, 100 + s, 167772161 + s % 3) for s in range(9)], PACKETS)
    at = scratch_path(spark, "t-closed")
    flows = plan.flows_of(packets, "3 seconds").select(*summary.WINDOW_COLS, "src_ip", "dst_ip", F.col("bytes").cast("bigint").alias("bytes"), "packets", "pp")
    ticks = spark.createDataFrame([(T0 + dt.timedelta(seconds=s), T0 + dt.timedelta(seconds=s + 3)) for s in (0, 3, 6, 9)],
                                  "window_start timestamp_ntz, window_end timestamp_ntz")
    (flows.unionByName(ticks, allowMissingColumns=True) if fill else flows).write.parquet(at)
    kw, more = {"parity": parity_tables(134, 1)} if seeded else {}, {"fill": True} if fill else {}
    cells = bricks.cells_of_closed(spark.read.parquet(at), "flow", **more, **kw)
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    same(cells.where("cell IS NOT NULL"), plan.window_summary(packets, "3 seconds", **kw).cells.drop("flow_bytes"))
    assert cells.where("cell IS NULL").count() == (4 if fill else 0)


def test_store_does_not_count_rows_unless_asked(spark):
    seen = []

    class Writer:
        def start(self):
            seen.append(spark.conf.get(COUNT_ROWS))

    start(spark, Writer())
    assert spark.conf.get(COUNT_ROWS, None) is None
    spark.conf.set(COUNT_ROWS, "true")
    start(spark, Writer())
    assert seen == ["false", "true"] and spark.conf.get(COUNT_ROWS) == "true"
    spark.conf.unset(COUNT_ROWS)


def test_decode_is_used_by_the_clock(spark):
    """Frames that are not IPv4 move the watermark but are not in the windows."""
    p = spark.createDataFrame([packet(1, 1), packet(2, 2, eth=34525)], PACKETS)
    assert vote.clocked(p, "3 seconds", "0 seconds").count() == decode.ipv4_only(p).count() == 1


def test_turns_of_several_files(spark, sf_small, monkeypatch):
    """Files as short as those of a large table's turns: all files of a turn belong to one micro-batch."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    monkeypatch.setattr(catalog, "FILE_ROWS", 300, raising=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, batch in (("stream_vote_report", "vote_hitter_report"), ("stream_vote", "vote_hitters")):
            got = catalog.QUERIES[name](spark, sf_small)
            want = catalog.QUERIES[batch](spark, sf_small).select(*got.columns)
            assert want.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, name
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_ordered_turns_have_as_many_files(spark, tmp_path):
    import os
    p = spark.range(0, 4000, 1, 7).selectExpr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts", "'e' as device", "id as seq", "2048 as eth_type",
                                              "0 as vlan_id", "6 as ip_proto", "id + 1 as src_ip", "id + 2 as dst_ip", "1 as sport", "2 as dport", "100 as wire_len")
    path = str(tmp_path / "s")
    cuts = fixtures.write_ordered_stream(p, path, 3, files=4)
    files = sorted((os.stat(f"{path}/{f}").st_mtime_ns, f) for f in os.listdir(path) if f.startswith("part-"))
    assert len(cuts) == 2 and len(files) == 13
    turns = [[t.as_py() for _, f in files[k:k + 4] for t in pq.read_table(f"{path}/{f}").column("ts")] for k in (0, 4, 8)]
    assert sum(map(len, turns)) == 4000 and max(turns[0]) < min(turns[1]) and max(turns[1]) < min(turns[2])


def test_packets_reach_the_state_in_packed_rows():
    rnd = np.random.default_rng(5)
    cols = {c: rnd.integers(0, 3, 500) for c in (*vote.KEY, "cell", *vote.ORDER)}
    out = pa.Table.from_batches(vote.pack_batches([pa.record_batch({c: v.astype(np.int64) for c, v in cols.items()})])).to_pylist()
    assert len(out) == len({k for k in zip(*[cols[c].tolist() for c in vote.KEY])}) <= 27
    got = [(r["start"], r["end"], r["slice"], *p) for r in out for p in np.frombuffer(r["packets"], dtype=np.int64).reshape(8, -1).T.tolist()]
    assert sorted(got) == sorted(zip(*[v.tolist() for v in cols.values()]))
