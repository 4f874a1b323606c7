"""Connected components of a large edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

SALTS = 64


def _written(df: DataFrame, name: str) -> DataFrame:
    where = scratch_path(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def _star(edges: DataFrame, larger: bool, many: int) -> DataFrame:
    """One star step on ``many`` edges ``(u, v)`` with ``u > v``: each node hangs its larger
    (or else its smaller) neighbours and itself on its least neighbour.

    The edges of a node with more than a 1024th of them (fewer than 2048 nodes, broadcast) are
    dealt over ``SALTS`` keys, and its least neighbour goes to each of them.
    """
    both = edges if not larger else edges.select(F.col("v").alias("u"), F.col("u").alias("v")).unionByName(edges)
    ends = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(ends.where(F.col("n") > max(64, many // 1024)).select("u", F.lit(True).alias("hub")))
    least = (ends.select("u", F.least("u", "m").alias("m")).join(hubs, "u", "left")
                 .select("u", "m", F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("s")))
    salt = F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    dealt = both.join(hubs, "u", "left").withColumn("s", salt).select("u", "v", "s")
    if larger:
        moved = dealt.where(F.col("v") > F.col("u")).join(least, ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = (dealt.join(least, ["u", "s"]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(ends.select("u", F.least("u", "m").alias("v"))))
    return moved.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, label`` for every node of an edge, ``label`` the least node of its component.

    Alternates large-star and small-star steps until nothing changes. Every step
    is an aggregate with map-side combine and a join back, in which a hub's edges are
    dealt over several keys; the edge table is written after each round, which
    cuts the lineage. The driver sees a count and two check sums a round. Null
    ends and loops are ignored; an empty table gives no node.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = _written(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()

    seen = state(e)
    while seen[0]:
        e = _written(_star(_star(e, True, seen[0]), False, seen[0]), "edges")
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
