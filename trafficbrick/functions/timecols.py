"""Zone-independent conversions between wall-clock and instant timestamps.

Watermarks need ``TIMESTAMP`` (an instant) while packet tables carry
``TIMESTAMP_NTZ`` (wall clock). A cast, and the differences that SQL takes between
timestamps, go through the session's time zone (missing and repeated hours, offset
windows). These read the wall clock as UTC microseconds and back, from its date and
time of day alone, so windows line up under any session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "1970-01-01 00:00:00"


def wallclock_micros(c: Column) -> Column:
    """Microseconds from 1970 of a wall-clock time, every day of 24 hours."""
    whole = (F.unix_date(F.to_date(c)).cast("bigint") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60) * 1_000_000
    return whole + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def micros_to_wallclock(us: Column) -> Column:
    seconds = (us.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    none = F.lit(0)
    return F.lit(_EPOCH_NTZ).cast("timestamp_ntz") + F.make_dt_interval(none, none, none, seconds)


def wallclock_to_instant(c: Column) -> Column:
    return F.timestamp_micros(wallclock_micros(c))


def instant_to_wallclock(c: Column) -> Column:
    return micros_to_wallclock(F.unix_micros(c))
