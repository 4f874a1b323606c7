"""Address hashing and bin assignment columns.

Two interchangeable hash families map a uint32 address to 17 bits:

* ``portable`` (default) -- a closed-form tabulation-style hash made of three
  quadratic residues, one per 16-bit half and one for their sum. It is a pure
  Catalyst expression: no lookup table, no join, code-generated, and the same
  arithmetic runs in any SQL engine (used by the DuckDB oracle).
* ``parity`` -- the classic seeded table hash: three random tables filled from
  the C library's ``rand()`` stream (see :mod:`trafficbrick.functions.parity`)
  and looked up by broadcast joins. Use it to reproduce bricks produced by a
  seeded native monitor bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

# Fixed values of the portable hash: modulus of the residues, 17-bit range,
# and the (a, b, c) coefficients of f(x) = ((a*x + b) % P * x + c) % R for the
# low half, the high half and the folded sum.
P31 = 2147483647
R17 = 131071
LO_COEF = (48271, 11, 101)
HI_COEF = (69621, 13, 103)
MIX_COEF = (39373, 17, 107)

BRICK_DIM = 128
SUB_BUCKETS = 256
SUB_SHIFT = 9  # 17-bit hash >> 9 -> 0..255


def _residue(x: Column, coef) -> Column:
    a, b, c = coef
    return ((((x * a) + b) % P31) * x + c) % R17


def hash17(c) -> Column:
    """Portable 17-bit hash of a uint32 address (bigint in, bigint out)."""
    a = as_col(c).cast("bigint")
    lo = a.bitwiseAND(65535)
    hi = F.shiftright(a, 16)
    mix = (lo + hi).bitwiseAND(R17)
    return _residue(lo, LO_COEF).bitwiseXOR(_residue(hi, HI_COEF)).bitwiseXOR(_residue(mix, MIX_COEF))


def hash_bin(h, reserved, dim: int = BRICK_DIM) -> Column:
    """Bin of a hashed address: ``reserved + h % (dim - reserved)`` (bins below ``reserved`` are pinned-only)."""
    r = as_col(reserved) if isinstance(reserved, Column) else F.lit(int(reserved))
    return (r + as_col(h) % (F.lit(dim) - r)).cast("int")


def sub_bucket(h) -> Column:
    """Sub-bucket (0..255) of a hashed source address."""
    return F.shiftright(as_col(h), SUB_SHIFT).cast("int")
