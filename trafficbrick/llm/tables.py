"""Intermediate tables under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: cuts the lineage.

    Spark is asked to delete the query's shuffle files when it ends, as nothing
    runs ``df`` again; the caller's setting is put back.
    """
    spark = df.sparkSession
    where = scratch_path(spark, name)
    old = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(where)
    finally:
        if old is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, old)
    return spark.read.parquet(where)
