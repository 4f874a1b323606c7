"""Hitter operators on the worked vote and invariants."""

import datetime as dt

from pyspark.sql import functions as F

from trafficbrick.operators import hitters, summary

T0 = dt.datetime(2024, 1, 1)

# The worked trace (seq, src, dst, weight) of one cell.
TRACE = [(1, 10, 20, 100), (2, 10, 20, 50), (3, 11, 20, 200), (4, 10, 20, 50), (5, 12, 20, 50), (6, 13, 20, 7),
         (7, 13, 20, 7)]


def _cell_rows(spark, trace, cell=5):
    rows = [(T0, T0 + dt.timedelta(seconds=3), cell, T0 + dt.timedelta(milliseconds=s), s, a, b, w, 1000 + s, 80)
            for s, a, b, w in trace]
    return spark.createDataFrame(rows, "window_start timestamp_ntz, window_end timestamp_ntz, cell int, "
                                       "ts timestamp_ntz, seq bigint, src_ip bigint, dst_ip bigint, w bigint, "
                                       "sport int, dport int")


def test_worked_vote(spark):
    r = hitters.vote_hitters(_cell_rows(spark, TRACE)).collect()
    assert len(r) == 1
    assert (r[0].src_ip, r[0].dst_ip, r[0]["count"], r[0].sport) == (12, 20, 36, 1005)


def test_native_pipeline_on_the_worked_trace(spark):
    """The candidate is the vote's, its rank and report the cell estimate's."""
    from trafficbrick.plans.summary import with_candidates, window_summary
    rows = [(T0 + dt.timedelta(milliseconds=s), "eth0", s, 2048, 0, 6, a, b, 1000 + s, 80, w) for s, a, b, w in TRACE]
    packets = spark.createDataFrame(rows, "ts timestamp_ntz, device string, seq bigint, eth_type int, vlan_id int, ip_proto int, "
                                          "src_ip bigint, dst_ip bigint, sport int, dport int, wire_len int")
    top = {(r.src_ip, r.dst_ip): r for r in window_summary(packets, "3 seconds", hitters_by="vote").top.collect()}
    cells = {r.src_ip for r in hitters.vote_hitters(summary.binned_packets(packets, "3 seconds")).collect()}
    assert {s for s, _ in top} == cells
    df = _cell_rows(spark, TRACE)
    subs = df.withColumn("sub", F.col("src_ip").cast("int"))
    est = summary.cell_estimate(summary.sub_buckets(subs)).withColumnRenamed("cell_bytes", "bytes")
    r = hitters.top_hitters(with_candidates(est, hitters.vote_hitters(df)).where("src_ip != 0")).first()
    assert (r["rank"], r.src_ip, r.dst_ip, r.est) == (1, 12, 20, 200)
    line = hitters.hitter_report(hitters.top_hitters(with_candidates(est, hitters.vote_hitters(df))), "packets").first().line
    assert line == "Hitter Flow #1: [0.0.0.12] -> [0.0.0.20]: 200 packets."


def test_vote_zero_source_is_empty(spark):
    # a candidate from source 0 is overwritten by the next packet and never reported
    df = _cell_rows(spark, [(1, 0, 20, 100), (2, 11, 20, 10)])
    r = hitters.vote_hitters(df).collect()
    assert [(x.src_ip, x["count"]) for x in r] == [(11, 10)]
    only_zero = _cell_rows(spark, [(1, 0, 20, 100)])
    assert hitters.vote_hitters(only_zero).count() == 0


def test_exact_dominant_tie(spark):
    r = hitters.dominant_flow(_cell_rows(spark, TRACE)).collect()
    assert (r[0].src_ip, r[0].flow_bytes, r[0].cell_bytes, r[0].sport) == (10, 200, 464, 1001)


def test_merged_vote_finds_majority(spark):
    # flow 10->20 holds 60% of the weight; spread across many partitions and batches
    rows = [(i, 10 if i % 5 < 3 else 11 + i % 7, 20, 10) for i in range(1, 2001)]
    df = _cell_rows(spark, rows).repartition(7)
    r = hitters.vote_merged(df).collect()
    assert (r[0].src_ip, r[0].dst_ip) == (10, 20)
    assert r[0]["count"] > 0


def test_invariants(spark, sf_small):
    from trafficbrick.sources.derived import load_packets
    b = summary.binned_packets(load_packets(spark, sf_small), "30 days").cache()
    total = b.agg(F.sum("w")).first()[0]
    brick = summary.brick(b)
    assert brick.agg(F.sum("bytes")).first()[0] == total
    subs = summary.sub_buckets(b)
    est = summary.cell_estimate(subs)
    dom = hitters.dominant_flow(b)
    j = dom.join(est.drop("cell_bytes"), summary.WINDOW_COLS + ["cell"])
    bad = j.where((F.col("flow_bytes") > F.col("est")) | (F.col("est") > F.col("cell_bytes"))).count()
    assert bad == 0
    vote = hitters.vote_hitters(b)
    merged = hitters.vote_merged(b)
    maj = dom.where(F.col("flow_bytes") * 2 > F.col("cell_bytes"))
    for cand in (vote, merged):
        miss = maj.join(cand, summary.WINDOW_COLS + ["cell", "src_ip", "dst_ip"], "left_anti").count()
        assert miss == 0
    assert vote.where(F.col("count") < 0).count() == 0
    assert b.where((F.col("src_bin") < 1) | (F.col("src_bin") > 127)).count() == 0
    # a (src, dst) pair maps to one cell: candidates are unique per window
    assert vote.groupBy(*summary.WINDOW_COLS, "src_ip", "dst_ip").count().where("count > 1").count() == 0
    b.unpersist()
