"""Packet-shaped tables derived from the generic test tables.

The library consumes ``packets`` / ``frames`` / ``capture_stats`` tables. The
test data ships TPC-H-style tables instead, so these functions map them onto
the packet schema with pure column arithmetic (one narrow projection, no
shuffle). The same mapping is written in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

# Fixed values of the mapping: odd multipliers that spread keys over the
# 32-bit address space, and the port/protocol assignment.
SRC_MULT = 2654435761
DST_MULT = 2246822519
DST_PARTS = 37
PINNED_BINS = 7
LATER_LINES = 1_000_000_000_000
U32 = 4294967296


def packets_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """``lineitem`` -> ``packets`` (every row an IPv4 packet)."""
    seq = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    dport = (F.when(F.col("l_linenumber") % 4 == 0, 53)
             .when(F.col("l_linenumber") % 4 == 1, 80)
             .when(F.col("l_linenumber") % 4 == 2, 443)
             .otherwise(22)).cast("int")
    return lineitem.select(
        F.timestamp_add("SECOND", (seq % 86400).cast("int"), F.col("l_shipdate")).alias("ts"),
        F.lit("eth0").alias("device"),
        seq.alias("seq"),
        F.lit(2048).alias("eth_type"),
        F.lit(0).alias("vlan_id"),
        F.when(dport == 53, 17).otherwise(6).alias("ip_proto"),
        (((F.col("l_suppkey") + 1) * SRC_MULT) % U32).alias("src_ip"),
        (((F.col("l_partkey") % DST_PARTS + 1) * DST_MULT) % U32).alias("dst_ip"),
        (F.lit(1024) + F.col("l_orderkey") % 64512).cast("int").alias("sport"),
        dport.alias("dport"),
        (F.lit(64) + F.col("l_quantity").cast("bigint") * 29).cast("int").alias("wire_len"),
    )


def load_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_lineitem(read_table(spark, sf_dir, "lineitem"))


def strata_lines_from_supplier(supplier: DataFrame) -> DataFrame:
    """Strata lines ``(line_no, ip, bin)``: one line per supplier pins its address
    to bin ``s_suppkey % 7``; after those, one more line for every tenth supplier
    moves it to the next bin (exercises last-line-wins)."""
    ip = (((F.col("s_suppkey") + 1) * SRC_MULT) % U32).alias("ip")
    base = supplier.select(F.col("s_suppkey").alias("line_no"), ip, (F.col("s_suppkey") % PINNED_BINS).cast("int").alias("bin"))
    again = supplier.where(F.col("s_suppkey") % 10 == 0).select(
        (F.col("s_suppkey") + LATER_LINES).alias("line_no"), ip,
        ((F.col("s_suppkey") + 1) % PINNED_BINS).cast("int").alias("bin"))
    return base.unionByName(again)


def capture_stats_from_events(events: DataFrame) -> DataFrame:
    """Cumulative per-device receive/drop counters, one sample per hour.

    device = event type; recv = events, drop = events of users divisible by 7.
    """
    from ..operators.scan import running_sums
    hourly = (events
              .groupBy(F.date_trunc("hour", F.col("ts")).alias("ts"), F.col("event_type").alias("device"))
              .agg(F.count(F.lit(1)).alias("recv_h"),
                   F.count(F.when(F.col("user_id") % 7 == 0, 1)).alias("drop_h")))
    cum = running_sums(hourly, ["device"], ["ts"], ["recv_h", "drop_h"], F.date_trunc("day", F.col("ts")))
    return cum.select("ts", "device", F.col("recv_h_cum").cast("bigint").alias("recv"),
                      F.col("drop_h_cum").cast("bigint").alias("drop"))


def frames_from_packets(packets: DataFrame) -> DataFrame:
    """Encode ``packets`` as Ethernet/IPv4/L4 frames (``frames`` schema).

    MACs are ``02:00:<ip bytes>``; a VLAN tag (0x8100) is inserted when
    ``vlan_id`` is non-zero; the IPv4 header is 20 bytes (IHL 5); only TCP/UDP
    frames carry ports.
    """
    def hx(c, n):
        return F.lpad(F.hex(c), 2 * n, "0")

    vlan = F.when(F.col("vlan_id") != 0, F.concat(F.lit("8100"), hx(F.col("vlan_id"), 2))).otherwise(F.lit(""))
    ports = F.when(F.col("ip_proto").isin(6, 17),
                   F.concat(hx(F.col("sport"), 2), hx(F.col("dport"), 2))).otherwise(F.lit(""))
    hexframe = F.concat(
        F.lit("0200"), hx(F.col("dst_ip"), 4),
        F.lit("0200"), hx(F.col("src_ip"), 4),
        vlan, hx(F.col("eth_type"), 2),
        F.lit("4500"), hx(F.greatest(F.col("wire_len") - 14, F.lit(40)), 2),
        F.lit("000100004"), F.lit("0"),  # ttl nibble pair 0x40
        hx(F.col("ip_proto"), 1), F.lit("0000"),
        hx(F.col("src_ip"), 4), hx(F.col("dst_ip"), 4),
        ports,
    )
    frame = F.unhex(hexframe)
    return packets.select(
        "ts", "device", F.lit("derived").alias("file"), "seq",
        F.octet_length(frame).cast("int").alias("cap_len"),
        F.col("wire_len"),
        frame.alias("frame"),
    )


# Fixed values of the events mapping: IPv6 ether type for error events, ICMP
# for views, UDP for clicks, TCP otherwise; VLAN tags 0/100/200 by user.
ETH_IPV6 = 0x86DD
DST_HOSTS = 11


def packets_from_events(events: DataFrame, device: str = "eth1") -> DataFrame:
    """``events`` -> ``packets`` of a second device: VLAN tags, an IPv6 share,
    ICMP (no ports), UDP and TCP."""
    proto = (F.when(F.col("event_type") == "view", 1)
              .when(F.col("event_type") == "click", 17).otherwise(6))
    has_ports = proto.isin(6, 17)
    return events.select(
        F.col("ts"),
        F.lit(device).alias("device"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", ETH_IPV6).otherwise(2048).alias("eth_type"),
        ((F.col("user_id") % 3) * 100).cast("int").alias("vlan_id"),
        proto.cast("int").alias("ip_proto"),
        (((F.col("user_id") + 1) * SRC_MULT) % U32).alias("src_ip"),
        (((F.col("event_id") % DST_HOSTS + 1) * DST_MULT) % U32).alias("dst_ip"),
        F.when(has_ports, F.lit(1024) + F.col("event_id") % 64512).otherwise(0).cast("int").alias("sport"),
        F.when(has_ports, 443).otherwise(0).cast("int").alias("dport"),
        (F.lit(64) + F.floor("value").cast("int") * 3).cast("int").alias("wire_len"),
    )


def load_event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(read_table(spark, sf_dir, "events"))
