"""Rates, capture totals, view: worked values."""

import datetime as dt

from trafficbrick.operators import rates, summary, view

T0 = dt.datetime(2024, 1, 1)


def test_cumulative_and_interval(spark):
    one = dt.timedelta(seconds=1)
    totals = spark.createDataFrame(
        [(T0, T0 + one, "eth0", 1000, 1_000_000), (T0 + one, T0 + 2 * one, "eth0", 10, 300_000_000)],
        "window_start timestamp_ntz, window_end timestamp_ntz, device string, packets bigint, line_bytes bigint")
    cum = {r.window_end: r for r in rates.cumulative_rates(totals).collect()}
    first = cum[T0 + one]
    assert (first.packets, first.bytes, first.ms, first.pps, first.mbps) == (1000, 1_000_000, 1000.0, 1000.0, 8.0)
    iv = rates.interval_rates(rates.cumulative_rates(totals)).collect()
    assert len(iv) == 1
    assert (iv[0].bytes, iv[0].ms, iv[0].gbps, iv[0].gbps_trunc) == (300_000_000, 1000.0, 2.4, 2.0)


def test_drop_pct(spark):
    stats = spark.createDataFrame([(T0, "a", 900, 100), (T0 + dt.timedelta(hours=1), "a", 0, 5)],
                                  "ts timestamp_ntz, device string, recv bigint, drop bigint")
    got = {r.ts: r.drop_pct for r in summary.capture_totals(stats).collect()}
    assert got[T0] == 10.0 and got[T0 + dt.timedelta(hours=1)] == 0.0


def test_view_categories_and_positions(spark):
    data = [0] * 16384
    hits = [""] * 16384
    data[300], data[301], data[302], data[303], data[304] = 1_000_000, 999_999, 500_000, 499_999, 0
    hits[301] = "[1.2.3.4:1, 5.6.7.8:2]"
    docs = spark.createDataFrame([(T0, data, hits)], "ts timestamp_ntz, data array<bigint>, hitters array<string>")
    cells = view.with_hitter_label(view.with_category(view.brick_to_cells(docs)))
    got = {(r.x, r.y): r for r in cells.where("x = 2 AND y BETWEEN 44 AND 48").collect()}
    assert [got[(2, y)].category for y in range(44, 49)] == ["10", "5", "5", "1", "1"]
    assert got[(2, 44)].traffic == 1_000_000
    assert got[(2, 44)].hitters == "No Top Hitters" and got[(2, 45)].hitters == "[1.2.3.4:1, 5.6.7.8:2]"
    assert got[(2, 44)].color == "#b2282f"
    payload = view.dashboard(docs).first().payload
    assert payload.startswith('{"x":[0,0,')


def test_line_bytes(spark):
    from trafficbrick.operators.decode import with_line_bytes
    r = with_line_bytes(spark.createDataFrame([(60,)], "wire_len int")).first()
    assert r.line_bytes == 84
