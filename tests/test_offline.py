"""Offline job with pinned strata and the seeded table hash."""

from pyspark.sql import functions as F

from trafficbrick.functions.hashing import BRICK_DIM
from trafficbrick.operators.decode import ipv4_only
from trafficbrick.plans import offline
from trafficbrick.session import scratch_path
from trafficbrick.sources import captures, derived


def test_summarize_captures_with_strata_and_parity(spark, sf_small, tmp_path):
    packets = derived.load_packets(spark, sf_small)
    cap = scratch_path(spark, "t-offline-cap")
    captures.write_captures(derived.frames_from_packets(packets), cap, 2).write.format("noop").mode("overwrite").save()
    # pin supplier 0's address (src of every l_suppkey = 0 row) to bin 3
    ip0 = derived.SRC_MULT % derived.U32
    strata = tmp_path / "strata.txt"
    strata.write_text(f"{ip0} 1\n{ip0} 3\n")
    out = offline.summarize_captures(spark, cap, scratch_path(spark, "t-offline-out"), duration="30 days",
                                     strata_path=str(strata), parity_seed=134)
    cells = spark.read.parquet(out["cells"])
    total = ipv4_only(packets).agg(F.sum("wire_len")).first()[0]
    assert cells.agg(F.sum("bytes")).first()[0] == total
    # reserved = 4: hashed bins avoid 0..3, the pinned source lands in bin 3 only
    assert cells.where(F.col("src_bin") < 4).select("src_bin").distinct().collect() == [(3,)]
    pinned = cells.where(F.col("src_bin") == 3).agg(F.sum("bytes")).first()[0]
    want = ipv4_only(packets).where(F.col("src_ip") == ip0).agg(F.sum("wire_len")).first()[0]
    assert pinned == want
    assert cells.agg(F.max("src_bin")).first()[0] < BRICK_DIM
    top = spark.read.parquet(out["top"])
    assert top.groupBy("window_start").count().agg(F.max("count")).first()[0] <= 20
    docs = spark.read.parquet(out["documents"])
    assert docs.select(F.size("data").alias("n")).distinct().collect() == [(16384,)]
    assert spark.read.parquet(out["report"]).count() == top.count()
