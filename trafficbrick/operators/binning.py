"""Bin assignment and cell addressing.

``assign_bins`` adds ``src_hash, dst_hash, src_bin, dst_bin, cell, sub``.
Pinned prefixes come from a broadcast left join against the strata table
(at most 131,072 rows by construction); all other addresses are hashed.
Run it on the smallest table that still carries the addresses -- the summary
plan bins *flows* after the first aggregation, not raw packets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addr import prefix17
from ..functions.hashing import BRICK_DIM, R17, hash17, hash_bin, sub_bucket
from ..functions.parity import ParityTables


def _portable(df: DataFrame, addr: str, out: str) -> DataFrame:
    return df.withColumn(out, hash17(addr))


def _parity_lookup(parity: ParityTables):
    """Vectorised seeded-table hash + bin (numpy gather over Arrow batches).

    The tables are fixed-size (1.5 MB as int32), shipped once with the
    function; no join and no per-row Python."""
    t1, t2, t3 = (parity.t1.astype(np.int32), parity.t2.astype(np.int32), parity.t3.astype(np.int32))
    bm = parity.bin_map.astype(np.int32)

    @F.pandas_udf("h bigint, b int")
    def lookup(ip: pd.Series) -> pd.DataFrame:
        a = ip.to_numpy(dtype=np.int64)
        lo, hi = a & 65535, a >> 16
        h = t1[lo] ^ t2[hi] ^ t3[(lo + hi) & R17]
        return pd.DataFrame({"h": h.astype(np.int64), "b": bm[h]})

    return lookup


def _strata_bin(df: DataFrame, addr: str, out: str, strata: DataFrame) -> DataFrame:
    # the same broadcast side for src and dst, so the exchange is built once and reused
    # one row per 17-bit prefix: at most 131,072 rows, whatever the caller passes
    one = strata.groupBy("prefix17").agg(F.max("bin").alias("bin"))
    s = F.broadcast(one).alias(f"_s_{out}")
    j = df.join(s, prefix17(addr) == F.col(f"_s_{out}.prefix17"), "left")
    return j.withColumn(out, F.col(f"_s_{out}.bin")).drop(F.col(f"_s_{out}.prefix17")).drop(F.col(f"_s_{out}.bin"))


def assign_bins(df: DataFrame, strata: DataFrame | None = None, reserved: int = 1, *,
                parity: ParityTables | None = None,
                dim: int = BRICK_DIM, src: str = "src_ip", dst: str = "dst_ip") -> DataFrame:
    """Add hash, bin, cell and sub-bucket columns for ``src``/``dst``.

    ``reserved`` is the count of pinned-only bins (see ``reserved_bins``); with
    ``parity`` tables the seeded hash and its bin map replace the portable hash
    (their ``reserved`` is fixed when they are drawn).
    """
    if parity is not None:
        lookup = _parity_lookup(parity)
        d = df.withColumn("_ps", lookup(F.col(src).cast("bigint"))).withColumn("_pd", lookup(F.col(dst).cast("bigint")))
        d = d.withColumn("src_hash", F.col("_ps.h")).withColumn("dst_hash", F.col("_pd.h"))
        src_h, dst_h = F.col("_ps.b"), F.col("_pd.b")
    else:
        d = _portable(_portable(df, src, "src_hash"), dst, "dst_hash")
        src_h, dst_h = hash_bin("src_hash", reserved, dim), hash_bin("dst_hash", reserved, dim)
    if strata is not None:
        d = _strata_bin(d, src, "_src_sbin", strata)
        d = _strata_bin(d, dst, "_dst_sbin", strata)
        src_bin = F.coalesce(F.col("_src_sbin"), src_h)
        dst_bin = F.coalesce(F.col("_dst_sbin"), dst_h)
    else:
        src_bin, dst_bin = src_h, dst_h
    d = (d.withColumn("src_bin", src_bin.cast("int"))
          .withColumn("dst_bin", dst_bin.cast("int")))
    d = d.withColumn("cell", with_cell_expr("src_bin", "dst_bin", dim)) \
         .withColumn("sub", sub_bucket("src_hash"))
    return d.drop(*[c for c in ("_src_sbin", "_dst_sbin", "_ps", "_pd") if c in d.columns])


def with_cell_expr(src_bin, dst_bin, dim: int = BRICK_DIM) -> Column:
    """Row-major cell index."""
    s = F.col(src_bin) if isinstance(src_bin, str) else src_bin
    t = F.col(dst_bin) if isinstance(dst_bin, str) else dst_bin
    return (s * dim + t).cast("int")
