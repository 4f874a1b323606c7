"""Fixed schemas of the library's tables."""

from pyspark.sql import types as T

FRAMES = T.StructType([
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("device", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("cap_len", T.IntegerType()),
    T.StructField("wire_len", T.IntegerType()),
    T.StructField("frame", T.BinaryType()),
])

PACKETS = T.StructType([
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("device", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("eth_type", T.IntegerType()),
    T.StructField("vlan_id", T.IntegerType()),
    T.StructField("ip_proto", T.IntegerType()),
    T.StructField("src_ip", T.LongType()),
    T.StructField("dst_ip", T.LongType()),
    T.StructField("sport", T.IntegerType()),
    T.StructField("dport", T.IntegerType()),
    T.StructField("wire_len", T.IntegerType()),
])

PACKET_COLUMNS = [f.name for f in PACKETS.fields]
