"""Packed ordering keys for ``min_by`` / ``max_by``.

``max_by(struct, struct)`` has a struct aggregation buffer, which Spark cannot
update in place, so the aggregate falls back to a sort-based plan that sorts
every input row of the map side. Packing the ordering into one
``decimal(38,0)`` and the value into primitives keeps these aggregates in the
hash-based, code-generated path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(38,0)"
TWO32 = 1 << 32
TWO63 = 1 << 63
TWO64 = 1 << 64
SEQ_SPAN = 10 ** 20  # > 2^64: room for any shifted bigint sequence number


def dlit(v: int) -> Column:
    return F.lit(str(v)).cast(DEC)


def first_packet_key(us: Column, seq: Column) -> Column:
    """Smaller = earlier: (microseconds from 1970, seq).

    Packets tied on both carry the same capture position, so any of them is
    "the first".
    """
    return (us.cast(DEC) * dlit(SEQ_SPAN) + (seq.cast(DEC) + dlit(TWO63))).cast(DEC)


def pack_ports(sport: Column, dport: Column) -> Column:
    return sport.cast("bigint") * 65536 + dport.cast("bigint")


def sport_of(pp: Column) -> Column:
    return F.shiftright(pp, 16).cast("int")


def dport_of(pp: Column) -> Column:
    return pp.bitwiseAND(65535).cast("int")


def heavy_key(weight: Column, src: Column, dst: Column) -> Column:
    """Larger = heavier; ties go to the smaller (src, dst). Unique per flow."""
    pair = src.cast(DEC) * dlit(TWO32) + dst.cast(DEC)
    return (weight.cast(DEC) * dlit(TWO64) + (dlit(TWO64 - 1) - pair)).cast(DEC)
