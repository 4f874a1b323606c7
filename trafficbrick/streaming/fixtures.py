"""Stream inputs derived from batch tables (for tests and registered queries)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PACKETS, PACKET_COLUMNS
from ..session import drop_path, file_system, scratch_path

# Fixed value: a far-future event that moves the watermark past every real window.
SENTINEL_TS = "2100-01-01 00:00:00"


def sentinel(spark, at: str = SENTINEL_TS) -> DataFrame:
    """One packet at ``at``, whose event time closes every window before."""
    return spark.range(1).select(
        F.lit(at).cast("timestamp_ntz").alias("ts"), F.lit("sentinel").alias("device"),
        F.lit(0).cast("bigint").alias("seq"), F.lit(2048).alias("eth_type"), F.lit(0).alias("vlan_id"),
        F.lit(6).alias("ip_proto"), F.lit(1).cast("bigint").alias("src_ip"), F.lit(1).cast("bigint").alias("dst_ip"),
        F.lit(1).alias("sport"), F.lit(1).alias("dport"), F.lit(64).alias("wire_len"))


def write_packet_stream(packets: DataFrame, path: str, files: int | None = None, closing: bool = True) -> None:
    """Write ``packets`` as ``files`` time-ranged parquet files (default: as many as
    ``packets`` has partitions), plus a one-row sentinel file whose event time
    closes every real window."""
    (packets.select(*PACKET_COLUMNS).repartitionByRange(files or max(1, packets.rdd.getNumPartitions()), "ts")
            .sortWithinPartitions("ts", "seq").write.mode("overwrite").parquet(path))
    if closing:
        sentinel(packets.sparkSession).write.mode("append").parquet(path)


def write_ordered_stream(packets: DataFrame, path: str, turns: int, closing: str | None = SENTINEL_TS, files: int = 1) -> list:
    """Write ``packets`` in ``turns`` turns of rising event time, one after the other, so that a
    file source (which lists files by the time they were written) sees them in time
    order; then, with ``closing``, a packet at that time. Returns the times between the turns.

    Every turn is ``files`` files, some of them without rows if need be: a reader that takes as many for a
    micro-batch has a whole turn in each. With parts of a turn in several, the first would move the watermark past the rest.
    """
    spark = packets.sparkSession
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    cuts = sorted(set(packets.agg(F.percentile_approx(us, [k / turns for k in range(1, turns)], F.lit(100_000)).alias("q")).first().q or [])) \
        if turns > 1 else []
    turn = sum((F.when(us > c, 1).otherwise(0) for c in cuts), F.lit(0))
    staged = scratch_path(spark, "stream-turns")
    packets.select(*PACKET_COLUMNS, turn.alias("turn")).write.partitionBy("turn").parquet(staged)
    for n in range(len(cuts) + 1):
        part = spark.read.parquet(staged).where(F.col("turn") == n).select(*PACKET_COLUMNS)
        part.coalesce(files).write.mode("append").parquet(path)
        for _ in range((n + 1) * files - _written_files(spark, path)):
            part.limit(0).coalesce(1).write.mode("append").parquet(path)
    if closing:
        sentinel(spark, closing).coalesce(1).write.mode("append").parquet(path)
    drop_path(spark, staged)
    return cuts


def _written_files(spark, path: str) -> int:
    fs, p = file_system(spark, path)
    return sum(f.getPath().getName().startswith("part-") for f in fs.listStatus(p))


def read_packet_stream(spark, path: str, max_files_per_trigger: int | None = 64) -> DataFrame:
    """A packet stream from parquet files; ``max_files_per_trigger`` bounds a micro-batch."""
    r = spark.readStream.schema(PACKETS)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)
