"""Column functions on IPv4 addresses, flows and MAC addresses.

Addresses are unsigned 32-bit values held in ``bigint`` columns (Spark has no
unsigned int); every function here is a plain Catalyst expression, so it is
code-generated and pushed wherever the optimizer moves it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col


def octet(c, n: int) -> Column:
    """Octet ``n`` (1 = most significant) of an IPv4 address."""
    if n not in (1, 2, 3, 4):
        raise ValueError("octet index must be 1..4")
    return F.shiftright(as_col(c).cast("bigint"), 8 * (4 - n)).bitwiseAND(255).cast("int")


def low16(c) -> Column:
    return as_col(c).cast("bigint").bitwiseAND(65535).cast("int")


def high16(c) -> Column:
    return F.shiftright(as_col(c).cast("bigint"), 16).cast("int")


def prefix17(c) -> Column:
    """Top 17 bits of the address (``ip >> 15``): the pinning key of the strata table."""
    return F.shiftright(as_col(c).cast("bigint"), 15).cast("int")


def ip_to_string(c) -> Column:
    """Dotted-quad text of a uint32 address held in a bigint."""
    a = as_col(c).cast("bigint")
    return F.concat_ws(".", *[F.shiftright(a, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def ip_from_string(c) -> Column:
    """Inverse of :func:`ip_to_string` (NULL for malformed text or octets above 255)."""
    parts = F.split(as_col(c), r"\.")
    v, ok = F.lit(0).cast("bigint"), F.size(parts) == 4
    for i in range(4):
        o = F.get(parts, i).try_cast("bigint")
        v, ok = F.shiftleft(v, 8) + o, ok & o.between(0, 255)
    return F.when(ok, v)


def flow_label(src, sport, dst, dport) -> Column:
    """``[a.b.c.d:sport, e.f.g.h:dport]``; empty text when there is no candidate (src 0 / NULL)."""
    s = as_col(src)
    label = F.format_string("[%s:%d, %s:%d]", ip_to_string(s), as_col(sport).cast("int"),
                            ip_to_string(dst), as_col(dport).cast("int"))
    return F.when(s.isNull() | (s == 0), F.lit("")).otherwise(label)


def mac_to_string(c) -> Column:
    """``AA:BB:CC:DD:EE:FF`` (upper-case hex) of a 6-byte binary value."""
    h = F.hex(as_col(c))
    return F.regexp_replace(h, "(..)(?!$)", "$1:")
