"""Property checks: the Spark vote folds equal a direct reading of the rules."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trafficbrick.operators import hitters

T0 = dt.datetime(2024, 1, 1)


def reference_vote(packets):
    """Sequential weighted vote over (src, dst, w, sport) in the given order."""
    cand, cnt = None, 0
    for src, dst, w, sport in packets:
        if cand is None or cand[0] == 0:
            cand, cnt = (src, dst, sport), w
        elif (cand[0], cand[1]) == (src, dst):
            cnt += w
        elif cnt - w < 0:
            cand, cnt = (src, dst, sport), w - cnt
        else:
            cnt -= w
    return cand, cnt


cells = st.lists(st.tuples(st.integers(0, 3), st.integers(20, 21), st.integers(1, 60)), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(groups=st.lists(cells, min_size=1, max_size=4))
def test_vote_matches_reference(spark, groups):
    rows, want = [], {}
    for c, trace in enumerate(groups):
        pk = [(src, dst, w, 1000 + i) for i, (src, dst, w) in enumerate(trace)]
        cand, cnt = reference_vote(pk)
        if cand[0] != 0:
            want[c] = (cand[0], cand[1], cand[2], cnt)
        for i, (src, dst, w, sport) in enumerate(pk):
            rows.append((T0, T0 + dt.timedelta(seconds=3), c, T0 + dt.timedelta(microseconds=i), i, src, dst, w,
                         sport, 80))
    df = spark.createDataFrame(rows, "window_start timestamp_ntz, window_end timestamp_ntz, cell int, "
                                     "ts timestamp_ntz, seq bigint, src_ip bigint, dst_ip bigint, w bigint, "
                                     "sport int, dport int").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows_per_batch in (size, "3"):      # runs within a batch, and runs across batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)
        got = {r.cell: (r.src_ip, r.dst_ip, r.sport, r["count"]) for r in hitters.vote_hitters(df).collect()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert got == want, rows_per_batch
    # the mergeable vote always returns a strict-majority flow
    merged = {r.cell: (r.src_ip, r.dst_ip) for r in hitters.vote_merged(df).collect()}
    for c, trace in enumerate(groups):
        tot = {}
        for src, dst, w in trace:
            if src:
                tot[(src, dst)] = tot.get((src, dst), 0) + w
        all_w = sum(w for src, _, w in trace if src)
        for flow, w in tot.items():
            if 2 * w > all_w:
                assert merged[c] == flow


def as_rows(traces, gap=1):
    """Packets of (src, dst, w) traces, one cell each, ``gap`` microseconds apart."""
    rows = []
    for c, trace in enumerate(traces):
        for i, (src, dst, w) in enumerate(trace):
            rows.append((T0, T0 + dt.timedelta(seconds=3), c, T0 + dt.timedelta(microseconds=i * gap), i, src, dst, w, 1000 + i, 80))
    return rows


SCHEMA = ("window_start timestamp_ntz, window_end timestamp_ntz, cell int, ts timestamp_ntz, seq bigint, src_ip bigint, "
          "dst_ip bigint, w bigint, sport int, dport int")


def wanted(traces):
    out = {}
    for c, trace in enumerate(traces):
        cand, cnt = reference_vote([(s, d, w, 1000 + i) for i, (s, d, w) in enumerate(trace)])
        if cand is not None and cand[0] != 0:
            out[c] = (*cand, cnt)
    return out


def voted(df, **kw):
    return {r.cell: (r.src_ip, r.dst_ip, r.sport, r["count"]) for r in hitters.vote_hitters(df, **kw).collect()}


def test_chunks_of_a_hot_cell_are_stitched(spark):
    """Cells cut into chunks: a heavy flow throughout, none at all, one that takes over late, ties and source 0."""
    import random
    rnd = random.Random(4)
    any_flow = lambda: (rnd.randrange(0, 5), 20, rnd.randrange(1, 60))
    traces = [[(1, 20, 50) if rnd.random() < 0.6 else any_flow() for _ in range(400)],
              [any_flow() for _ in range(400)],
              [(7, 20, 90)] * 150 + [(8, 21, 91)] * 250,
              [(i % 2 + 1, 20, 10) for i in range(300)],
              [any_flow() for _ in range(15)],
              [(0, 20, 5)] * 100 + [(3, 20, 1)] * 3]
    df = spark.createDataFrame(as_rows(traces), SCHEMA).repartition(4).cache()
    for rows in (40, 7, 1000):
        assert voted(df, chunk_rows=rows) == wanted(traces), rows
    # one cell with half of the packets is cut, and its chunks lie in several tasks
    hot = hitters.hot_cells(df, 40).collect()
    assert {r.cell for r in hot} == {0, 1, 2, 3, 5} and all(len(r.bounds) >= 2 for r in hot)
    df.unpersist()


def test_stitching_falls_back_to_one_chunk(spark, monkeypatch):
    import random
    rnd = random.Random(9)
    traces = [[(rnd.randrange(1, 4), 20, rnd.randrange(1, 9)) for _ in range(200)] for _ in range(2)]
    df = spark.createDataFrame(as_rows(traces), SCHEMA)
    monkeypatch.setattr(hitters, "ROUNDS", 1)
    assert voted(df, chunk_rows=10) == wanted(traces)


def test_equal_times_stay_in_one_chunk(spark):
    traces = [[(i % 3 + 1, 20, i % 7 + 1) for i in range(120)]]
    df = spark.createDataFrame(as_rows(traces, gap=0), SCHEMA)
    assert voted(df, chunk_rows=10) == wanted(traces)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(groups=st.lists(cells, min_size=1, max_size=4), tasks=st.integers(1, 6), batch=st.sampled_from(["2", "10000"]))
def test_merged_vote_keeps_majorities(spark, groups, tasks, batch):
    """Whatever way packets lie in tasks and batches; and no task puts out more than a row a cell."""
    df = spark.createDataFrame(as_rows(groups), SCHEMA).repartition(tasks)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        rows = df.where("src_ip <> 0").select(*hitters.GROUP[:3], *hitters.PACKET)
        assert rows.mapInArrow(hitters.partial_votes, hitters.PARTIAL).count() <= tasks * len(groups)
        merged = {r.cell: (r.src_ip, r.dst_ip, r["count"]) for r in hitters.vote_merged(df).collect()}
        flagged = {r.cell: (r.src_ip, r.dst_ip, r.flow_bytes) for r in hitters.merged_majority(df).where("is_majority").collect()}
    finally:
        spark.conf.set(key, old)
    for c, trace in enumerate(groups):
        totals = {}
        for src, dst, w in trace:
            totals[src, dst] = totals.get((src, dst), 0) + w
        known = sum(w for (src, _), w in totals.items() if src)
        for (src, dst), w in totals.items():
            if src and 2 * w > known:
                assert merged[c][:2] == (src, dst) and 0 < merged[c][2]
        major = [(s, d, w) for (s, d), w in totals.items() if s and 2 * w > sum(totals.values())]
        assert ([flagged[c]] if c in flagged else []) == major
