"""The capped store: what is on disk after an eviction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trafficbrick.operators import store
from trafficbrick.session import file_system, scratch_path

T0 = dt.datetime(2024, 1, 1, 12)


def documents(spark, hours, label="x"):
    rows = [(T0 + dt.timedelta(hours=h), [h] * 10, [label * (h % 7)] * 10) for h in hours]
    return spark.createDataFrame(rows, "ts timestamp_ntz, data array<bigint>, hitters array<string>")


def sizes(hours):
    return {T0 + dt.timedelta(hours=h): 80 + 10 * (h % 7) for h in hours}


def stored(spark, path):
    return {r.ts: r.size_bytes for r in store.read_bricks(spark, path).collect()}


@pytest.mark.parametrize("cap", [0, 79, 500, 3000, 5555, 10 ** 9])
def test_newest_stay_within_the_cap(spark, cap):
    hours = range(0, 72, 2)
    path = scratch_path(spark, "t-store")
    store.write_bricks(documents(spark, hours), path)
    newest, total = {}, 0
    for ts, n in sorted(sizes(hours).items(), reverse=True):
        total += n
        if total > cap:
            break
        newest[ts] = n
    assert store.evict_bricks(spark, path, cap) == sum(newest.values()) <= cap
    fs, root = file_system(spark, path)
    left = {s.getPath().getName() for s in fs.listStatus(root)} - {"_SUCCESS"}
    assert left == {f"date={ts.date()}" for ts in newest}
    assert (stored(spark, path) if newest else {}) == newest
    assert store.evict_bricks(spark, path, cap) == sum(newest.values())         # again: nothing changes
    assert (stored(spark, path) if newest else {}) == newest


def test_documents_of_one_time_go_together(spark):
    path = scratch_path(spark, "t-store")
    store.write_bricks(documents(spark, [0, 1, 2]).unionByName(documents(spark, [1])), path)
    one = sizes([0, 1, 2])
    cap = one[T0 + dt.timedelta(hours=2)] + one[T0 + dt.timedelta(hours=1)]
    assert store.evict_bricks(spark, path, cap) == one[T0 + dt.timedelta(hours=2)]
    assert store.retain_bricks(documents(spark, [0, 1, 2]).unionByName(documents(spark, [1])), cap).count() == 1


@pytest.mark.parametrize("crash", ["before", "between", "half written"])
def test_interrupted_evictions_are_finished(spark, crash):
    """The folder of the date in between is the old one or the new one, whole."""
    hours = range(0, 12)
    path = scratch_path(spark, "t-store")
    store.write_bricks(documents(spark, hours), path)
    day = f"date={T0.date()}"
    fs, _ = file_system(spark, path)
    at = lambda *n: file_system(spark, "/".join((path, *n)))[1]
    new = store.read_bricks(spark, path).where(F.col("date") == F.lit(T0.date())).where("hour(ts) >= 20").drop("date")
    new.write.parquet(f"{path}/_evict_new/{day}")
    if crash == "half written":
        fs.delete(at("_evict_new", day, "_SUCCESS"), False)
    if crash != "before":
        fs.mkdirs(at("_evict_old"))
        fs.rename(at(day), at("_evict_old", day))
    cap = sum(sizes(range(8, 12)).values())
    assert store.evict_bricks(spark, path, cap) == cap
    assert stored(spark, path) == sizes(range(8, 12))


def test_empty_stores(spark):
    assert store.evict_bricks(spark, scratch_path(spark, "t-none"), 10) == 0


def test_stores_of_the_stream_sink(spark):
    """Filed by date and batch: batches keep their folders."""
    path = scratch_path(spark, "t-sink")
    for n, hours in enumerate((range(0, 20), range(20, 40))):
        d = store.document_bytes(documents(spark, hours)).withColumn("date", F.to_date("ts")).withColumn("batch_id", F.lit(n))
        d.write.mode("append").partitionBy("date", "batch_id").parquet(path)
    cap = sum(sizes(range(25, 40)).values())
    assert store.evict_bricks(spark, path, cap) == cap
    assert stored(spark, path) == sizes(range(25, 40))
    assert {r.batch_id for r in store.read_bricks(spark, path).collect()} == {1}
    newest = store.latest_brick(store.read_bricks(spark, path)).collect()
    assert [r.ts for r in newest] == [T0 + dt.timedelta(hours=39)]
