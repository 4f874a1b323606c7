"""Strata (pinned address prefixes) -- A5 and D4.

A strata file holds lines ``<uint32 address> <bin>``; the address's top 17
bits are pinned to the bin and the last line for a prefix wins. The result is
keyed by a 17-bit prefix, so it never exceeds 131,072 rows whatever the input
size: that bound is what makes broadcasting it safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addr import prefix17
from ..functions.hashing import BRICK_DIM


def read_strata_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines -> ``(line_no, ip, bin)``; blank lines ignored.

    Line order is the file order: a single text file is read as ordered splits
    and ``monotonically_increasing_id`` grows with split index and row position.
    """
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.trim("value").alias("v"))
    parts = F.split(F.col("v"), r"\s+")
    # lines that are no pair of numbers give nulls, which valid_lines() rejects
    return (raw.where(F.col("v") != "")
               .select("line_no", F.get(parts, 0).try_cast("bigint").alias("ip"), F.get(parts, 1).try_cast("int").alias("bin")))


def valid_lines(lines: DataFrame, dim: int = BRICK_DIM) -> DataFrame:
    """Lines with a uint32 address (where there is one) and a bin in ``0..dim-2``;
    a bin of ``dim-1`` or more would leave no hashed bins."""
    ok = F.col("bin").between(0, dim - 2)
    if "ip" in lines.columns:
        ok = ok & F.col("ip").between(0, 4294967295)
    return lines.where(ok)


def strata_from_lines(lines: DataFrame, dim: int = BRICK_DIM) -> DataFrame:
    """``(line_no, ip, bin)`` -> ``(prefix17, bin)`` with last-line-wins per prefix
    over the valid lines."""
    return (valid_lines(lines, dim).groupBy(prefix17("ip").alias("prefix17"))
                                   .agg(F.max_by("bin", "line_no").alias("bin")))


def read_strata(spark: SparkSession, path: str, dim: int = BRICK_DIM) -> DataFrame:
    return strata_from_lines(read_strata_lines(spark, path), dim)


def reserved_table(lines: DataFrame, dim: int = BRICK_DIM) -> DataFrame:
    """One row ``reserved``: the number of leading bins kept for pinned prefixes,
    ``max(bin) + 1`` over all valid lines (also overridden ones), at least 1."""
    return valid_lines(lines, dim).agg((F.coalesce(F.max("bin"), F.lit(0)) + 1).alias("reserved"))


def reserved_bins(lines: DataFrame | None, dim: int = BRICK_DIM) -> int:
    """The value of :func:`reserved_table` (1 without lines); collects that one row."""
    return 1 if lines is None else int(reserved_table(lines, dim).first()["reserved"])
