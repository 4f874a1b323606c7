"""Multi-device input (A3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_devices(sources: dict[str, DataFrame]) -> DataFrame:
    """Union packet/frame sources by column name, tagging each with its device.

    A plain ``UNION ALL``: no shuffle, each source keeps its own partitioning
    and scan-level pushdown.
    """
    if not sources:
        raise ValueError("no sources")
    tagged = [df.withColumn("device", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
