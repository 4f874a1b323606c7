"""The bounded training sample of labelled rows and the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

MAX_ROWS = 12_000


def held_out(id_col: str) -> Column:
    """Rows that no model is fitted on: CRC-32 of the id as text, a multiple of 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """``text, label`` of at most ``max_rows`` labelled rows outside the held-out fold.

    The rows are those of the smallest id hashes, so they do not follow the
    order of the tables. Labels come once per id (the largest, where ids repeat);
    null labels take no part. The sampled ids (``max_rows`` at most) are
    broadcast; the texts are not shuffled. The sample is written once under the
    checkpoint folder, so fitting reads no other text again.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
                   .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
                   .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    where = scratch_path(docs.sparkSession, f"sample-{label}")
    docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label").write.parquet(where)
    return docs.sparkSession.read.parquet(where)
