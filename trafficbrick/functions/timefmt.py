"""Time and number formatting columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

MS_PER_DAY = 86_400_000
MS_PER_HOUR = 3_600_000
MS_PER_MINUTE = 60_000
MS_PER_SECOND = 1_000


def delta_ms(t1, t0) -> Column:
    """Milliseconds from ``t0`` to ``t1`` as a double (microsecond precision).

    Works for both ``timestamp`` and ``timestamp_ntz`` columns.
    """
    return F.timestamp_diff("MICROSECOND", as_col(t0), as_col(t1)) / F.lit(1000.0)


def duration_string(ms) -> Column:
    """``d:hh:mm:ss:mmm`` for a non-negative millisecond count."""
    m = as_col(ms).cast("bigint")
    return F.format_string(
        "%d:%02d:%02d:%02d:%03d",
        F.floor(m / MS_PER_DAY).cast("bigint"),
        F.pmod(F.floor(m / MS_PER_HOUR).cast("bigint"), F.lit(24)),
        F.pmod(F.floor(m / MS_PER_MINUTE).cast("bigint"), F.lit(60)),
        F.pmod(F.floor(m / MS_PER_SECOND).cast("bigint"), F.lit(60)),
        F.pmod(m, F.lit(1000)),
    )


def format_count(c, decimals: int = 0) -> Column:
    """Human-readable count with thousands separators (``1,234,567`` / ``12.5``)."""
    return F.format_number(as_col(c), decimals)
