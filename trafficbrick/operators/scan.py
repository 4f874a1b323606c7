"""Ordered running computations without a single-task window.

``Window.partitionBy(device).orderBy(ts)`` sends a device's whole history to
one task. These helpers split the order into coarse buckets (e.g. a day),
compute each bucket in parallel, and stitch buckets together through a small
bucket-level table (one row per key and bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import wallclock_micros


def _order(cols, descending):
    return [F.col(c).desc() if descending else F.col(c).asc() for c in cols]


def running_sums(df: DataFrame, keys: list[str], order: list[str], cols: list[str], bucket: Column,
                 descending: bool = False, suffix: str = "_cum") -> DataFrame:
    """Add ``<col><suffix>`` = sum of ``col`` over rows up to and including this
    one in ``order`` (per ``keys``). ``bucket`` must be monotone in ``order``."""
    d = df.withColumn("_bkt", bucket)
    per_bucket = d.groupBy(*keys, "_bkt").agg(*[F.sum(c).alias(c) for c in cols])
    before = (Window.partitionBy(*keys).orderBy(F.col("_bkt").desc() if descending else F.col("_bkt").asc())
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_bucket.select(*keys, "_bkt", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{c}")
                                                 for c in cols])
    inside = (Window.partitionBy(*keys, "_bkt").orderBy(*_order(order, descending))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    j = d.join(offsets, [*keys, "_bkt"], "left")
    for c in cols:
        j = j.withColumn(f"{c}{suffix}", F.sum(c).over(inside) + F.col(f"_off_{c}"))
    return j.drop("_bkt", *[f"_off_{c}" for c in cols])


def previous_row(df: DataFrame, keys: list[str], order: str, cols: list[str], bucket: Column,
                 prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<col>``: the value on the preceding row by the time ``order`` per ``keys``
    (NULL on the first row).

    A bucket's last row is taken column by column with a plain number as the order, so the
    aggregate keeps fixed-width buffers and is a hash aggregate.
    """
    d = df.withColumn("_bkt", bucket).withColumn("_at", wallclock_micros(F.col(order)))
    last = d.groupBy(*keys, "_bkt").agg(*[F.max_by(c, "_at").alias(f"_last_{c}") for c in cols])
    w_b = Window.partitionBy(*keys).orderBy("_bkt")
    carry = last.select(*keys, "_bkt", *[F.lag(f"_last_{c}").over(w_b).alias(f"_carry_{c}") for c in cols])
    w = Window.partitionBy(*keys, "_bkt").orderBy("_at")
    j = d.join(carry, [*keys, "_bkt"], "left")
    for c in cols:
        j = j.withColumn(f"{prefix}{c}", F.coalesce(F.lag(c).over(w), F.col(f"_carry_{c}")))
    return j.drop("_bkt", "_at", *[f"_carry_{c}" for c in cols])
