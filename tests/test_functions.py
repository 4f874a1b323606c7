"""Scalar columns: worked values."""

import datetime as dt

from pyspark.sql import functions as F

from trafficbrick.functions import addr, hashing, timefmt


def _one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_ip_text_and_back(spark):
    r = _one(spark, addr.ip_to_string(F.lit(167772161)).alias("a"), addr.ip_to_string(F.lit(4294967295)).alias("b"),
             addr.ip_from_string(F.lit("8.8.8.8")).alias("c"))
    assert (r.a, r.b, r.c) == ("10.0.0.1", "255.255.255.255", 134744072)


def test_octets_halves_prefix(spark):
    ip = F.lit(3232235786)  # 192.168.1.10
    r = _one(spark, *[addr.octet(ip, i).alias(f"o{i}") for i in (1, 2, 3, 4)],
             addr.low16(ip).alias("lo"), addr.high16(ip).alias("hi"), addr.prefix17(ip).alias("p"))
    assert (r.o1, r.o2, r.o3, r.o4) == (192, 168, 1, 10)
    assert (r.lo, r.hi, r.p) == (266, 49320, 98640)


def test_flow_label(spark):
    r = _one(spark, addr.flow_label(F.lit(167772161), F.lit(50000), F.lit(134744072), F.lit(80)).alias("l"),
             addr.flow_label(F.lit(0), F.lit(1), F.lit(2), F.lit(3)).alias("e"))
    assert r.l == "[10.0.0.1:50000, 8.8.8.8:80]"
    assert r.e == ""


def test_mac_text(spark):
    r = _one(spark, addr.mac_to_string(F.unhex(F.lit("AABBCCDDEEFF"))).alias("m"),
             addr.mac_to_string(F.unhex(F.lit("0200ab0c0001"))).alias("n"))
    assert r.m == "AA:BB:CC:DD:EE:FF"
    assert r.n == "02:00:AB:0C:00:01"


def test_delta_and_duration(spark):
    t0 = F.lit("2024-01-01 00:00:00.500000").cast("timestamp_ntz")
    t1 = F.lit("2024-01-01 00:00:02.250500").cast("timestamp_ntz")
    ms = 90061001  # 1 d 1 h 1 min 1 s 1 ms
    r = _one(spark, timefmt.delta_ms(t1, t0).alias("d"), timefmt.duration_string(F.lit(ms)).alias("s"),
             timefmt.format_count(F.lit(1234567), 0).alias("c"))
    assert r.d == 1750.5
    assert r.s == "1:01:01:01:001"
    assert r.c == "1,234,567"


def test_portable_hash_ranges(spark):
    df = spark.range(0, 200000).select((F.col("id") * 21474).alias("ip"))
    h = df.select(hashing.hash17("ip").alias("h")).select(
        F.min("h").alias("lo"), F.max("h").alias("hi"),
        F.min(hashing.sub_bucket(F.col("h"))).alias("slo"), F.max(hashing.sub_bucket(F.col("h"))).alias("shi"),
        F.min(hashing.hash_bin(F.col("h"), 7)).alias("blo"), F.max(hashing.hash_bin(F.col("h"), 7)).alias("bhi")).first()
    assert 0 <= h.lo and h.hi < 131072
    assert 0 <= h.slo and h.shi <= 255
    assert h.blo >= 7 and h.bhi <= 127
