"""Frame decoding, packet projection and predicates.

Everything is a column expression over the ``frame`` binary, so decoding is a
single code-generated projection fused with the scan; no Python per packet.
Byte positions below are 1-based (Spark ``substring`` on binary).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PACKET_COLUMNS

# Ethernet type codes and header offsets.
ETH_VLAN = 0x8100
ETH_IPV4 = 0x0800
ETH_HEADER = 14
VLAN_TAG = 4
PROTO_TCP = 6
PROTO_UDP = 17
LINE_OVERHEAD = 24  # preamble 8 + CRC 4 + inter-frame gap 12


def _substr(frame: Column, pos: Column, n: int) -> Column:
    return F.substr(frame, pos, F.lit(n))


def _uint_at(frame: Column, pos, n: int) -> Column:
    p = pos if isinstance(pos, Column) else F.lit(pos)
    return F.when(F.octet_length(frame) >= p + (n - 1),
                  F.conv(F.hex(_substr(frame, p, n)), 16, 10).cast("bigint"))


def decode_frames(frames: DataFrame, frame_col: str = "frame") -> DataFrame:
    """``frames`` -> ``packets``: Ethernet type with one VLAN tag stripped (B1, B2),
    IPv4 addresses (B4) and TCP/UDP ports of first fragments (B5)."""
    fr = F.col(frame_col)
    outer = _uint_at(fr, 13, 2)
    tagged = outer == ETH_VLAN
    off = F.when(tagged, F.lit(VLAN_TAG)).otherwise(F.lit(0))
    eth_type = F.when(tagged, _uint_at(fr, 17, 2)).otherwise(outer).cast("int")
    vlan_id = F.when(tagged, _uint_at(fr, 15, 2).bitwiseAND(4095)).otherwise(F.lit(0)).cast("int")
    base = frames.select("*", off.alias("_off"), eth_type.alias("eth_type"), vlan_id.alias("vlan_id"))

    o = F.col("_off")
    is_ip = F.col("eth_type") == ETH_IPV4
    ihl = _uint_at(fr, o + 15, 1).bitwiseAND(15)
    proto = _uint_at(fr, o + 24, 1)
    frag = _uint_at(fr, o + 21, 2).bitwiseAND(8191)
    src = _uint_at(fr, o + 27, 4)
    dst = _uint_at(fr, o + 31, 4)
    l4 = o + 15 + ihl * 4
    has_ports = is_ip & proto.isin(PROTO_TCP, PROTO_UDP) & (frag == 0)
    sport = F.when(has_ports, F.coalesce(_uint_at(fr, l4, 2), F.lit(0))).otherwise(F.lit(0))
    dport = F.when(has_ports, F.coalesce(_uint_at(fr, l4 + 2, 2), F.lit(0))).otherwise(F.lit(0))
    return base.select(
        "ts", "device", "seq", "eth_type", "vlan_id",
        F.when(is_ip, proto).cast("int").alias("ip_proto"),
        F.when(is_ip, src).alias("src_ip"),
        F.when(is_ip, dst).alias("dst_ip"),
        sport.cast("int").alias("sport"),
        dport.cast("int").alias("dport"),
        F.col("wire_len").cast("int").alias("wire_len"),
    )


def is_ipv4() -> Column:
    """Whether a packet is a decodable IPv4 packet."""
    return (F.col("eth_type") == ETH_IPV4) & F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()


def ipv4_only(packets: DataFrame) -> DataFrame:
    """Keep decodable IPv4 packets (B3); a plain filter, pushed into parquet scans."""
    return packets.where(is_ipv4())


def with_weight(df: DataFrame, weight: str = "bytes", name: str = "w") -> DataFrame:
    """Per-packet weight (B6): wire length for ``bytes``, 1 for ``packets``."""
    if weight == "bytes":
        return df.withColumn(name, F.col("wire_len").cast("bigint"))
    if weight == "packets":
        return df.withColumn(name, F.lit(1).cast("bigint"))
    raise ValueError("weight must be 'bytes' or 'packets'")


def with_line_bytes(df: DataFrame, name: str = "line_bytes") -> DataFrame:
    """Bytes on the wire including preamble, CRC and gap."""
    return df.withColumn(name, (F.col("wire_len") + LINE_OVERHEAD).cast("bigint"))


def filter_packets(df: DataFrame, predicate) -> DataFrame:
    """User packet filter (B8) -- a SQL predicate string or a Column.

    Catalyst pushes the supported parts into the parquet scan.
    """
    return df.where(F.expr(predicate) if isinstance(predicate, str) else predicate)


def first_seen(frames: DataFrame, by: str = "file") -> DataFrame:
    """First packet timestamp per capture file."""
    return frames.groupBy(by).agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("frames"))


def truncate_frames(frames: DataFrame, snaplen: int = 128) -> DataFrame:
    """Capture-length cap (A4): keep the first ``snaplen`` bytes, wire length intact."""
    return frames.withColumn("frame", F.substring("frame", 1, snaplen)) \
                 .withColumn("cap_len", F.least(F.col("cap_len"), F.lit(snaplen)).cast("int"))


__all__ = ["decode_frames", "ipv4_only", "with_weight", "with_line_bytes", "filter_packets",
           "first_seen", "truncate_frames", "PACKET_COLUMNS"]
