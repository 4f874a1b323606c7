"""Wall-clock windows in session zones with clock changes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trafficbrick.functions.timecols import instant_to_wallclock, wallclock_micros, wallclock_to_instant
from trafficbrick.operators.summary import dense_brick
from trafficbrick.plans.summary import window_summary
from trafficbrick.schemas import PACKETS

#: days around both changes of a year: a missing hour and a repeated one (half an hour on Lord Howe)
ZONES = {"America/New_York": ["2023-03-10", "2023-11-03"], "Australia/Lord_Howe": ["2023-09-29", "2023-03-31"], "UTC": ["2023-03-10"]}


@pytest.fixture
def zone(spark, request):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("zone", ZONES, indirect=True)
def test_conversions(spark, zone):
    start = dt.datetime(2023, 1, 1)
    times = [start + dt.timedelta(minutes=10 * k, microseconds=k) for k in range(0, 365 * 144, 37)] + [dt.datetime(1950, 7, 1, 2, 30, 0, 1)]
    rows = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    got = rows.select("t", wallclock_micros(F.col("t")).alias("us"), instant_to_wallclock(wallclock_to_instant(F.col("t"))).alias("back")).collect()
    for r in got:
        assert r.us == (r.t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) and r.back == r.t


@pytest.mark.parametrize("zone", ZONES, indirect=True)
def test_filled_documents(spark, zone):
    for day in ZONES[zone]:
        first = dt.datetime.fromisoformat(day)
        for hours, total in ((24, 5), (1, 120)):
            some = sorted({0, total - 1, *range(3, total, 7)})
            rows = [(first + dt.timedelta(hours=hours * k, minutes=30), "eth0", k, 2048, 0, 6, 167772161, 134744072, 1, 2, 100) for k in some]
            got = window_summary(spark.createDataFrame(rows, PACKETS), f"{hours} hours", fill=True).documents.collect()
            want = {first + dt.timedelta(hours=hours * (k + 1)): 100 * (k in some) for k in range(total)}
            assert {r.ts: sum(r.data) for r in got} == want and len(got) == total


def test_no_cells_no_documents(spark):
    none = window_summary(spark.createDataFrame([], PACKETS), "1 hour").cells
    assert dense_brick(none, fill=True).count() == 0
