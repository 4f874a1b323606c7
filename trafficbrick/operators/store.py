"""Document storage: write, newest, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_path, file_system
from .scan import running_sums


def write_bricks(documents: DataFrame, path: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Append documents to a store partitioned by date.

    The date partitioning plays the role of a timestamp index: readers that
    filter on ``date`` or ``ts`` prune whole folders.
    """
    (document_bytes(documents).withColumn("date", F.to_date("ts"))
              .write.mode(mode).partitionBy("date").format(fmt).save(path))


def read_bricks(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """The stored documents with their ``size_bytes`` and the ``date`` they are filed under."""
    return spark.read.format(fmt).load(path)


def latest_brick(bricks: DataFrame) -> DataFrame:
    """The newest document.

    The time is found from the ``ts`` column alone (one value reaches the driver);
    only the documents of that time are then read. With a ``date`` column the
    filter prunes the other dates' folders.
    """
    newest = bricks.agg(F.max("ts")).first()[0]
    if newest is None:
        return bricks.limit(0)
    at = F.to_timestamp_ntz(F.lit(newest.isoformat(sep=" ")))
    found = bricks.where(F.col("ts") == at)
    return (found.where(F.col("date") == F.to_date(at)) if "date" in bricks.columns else found).limit(1)


def document_bytes(bricks: DataFrame) -> DataFrame:
    """Approximate stored size: 8 bytes per counter plus the hitter text (kept where
    the store already has it)."""
    if "size_bytes" in bricks.columns:
        return bricks
    text = F.aggregate("hitters", F.lit(0).cast("bigint"), lambda acc, h: acc + F.length(h))
    return bricks.withColumn("size_bytes", (F.size("data") * 8 + text).cast("bigint"))


def _cutoff(bricks: DataFrame, max_bytes: int, bucket: str):
    """The oldest time from which on all documents together fit in ``max_bytes`` (None: not even the newest do).

    Only times and sizes are read; documents of one time stay or go together.
    """
    slim = document_bytes(bricks).groupBy("ts").agg(F.sum("size_bytes").alias("size_bytes"))
    cum = running_sums(slim, [], ["ts"], ["size_bytes"], F.date_trunc(bucket, F.col("ts")), descending=True,
                       suffix="_newer")
    return cum.where(F.col("size_bytes_newer") <= max_bytes).agg(F.min("ts")).first()[0]


def retain_bricks(bricks: DataFrame, max_bytes: int, bucket: str = "day") -> DataFrame:
    """Capped store (A9) as a view: the newest documents whose cumulative size fits in ``max_bytes``.

    The running size is computed on a slim ``(ts, size)`` projection (bucketed
    parallel scan, no single-task window); the only value that reaches the
    driver is the cut-off time, and the documents themselves are just filtered
    by ``ts >= cutoff`` -- a predicate that prunes stored date partitions.
    """
    cutoff = _cutoff(bricks, max_bytes, bucket)
    if cutoff is None:
        return document_bytes(bricks).limit(0)
    return document_bytes(bricks).where(F.col("ts") >= F.to_timestamp_ntz(F.lit(cutoff.isoformat(sep=" "))))


# ---------------------------------------------------------------- eviction
_NEW, _OLD = "_evict_new", "_evict_old"     # hidden from readers


def _settle(spark, path: str) -> None:
    """Finish what an interrupted eviction left: a date's folder is either the old or the new one, whole."""
    fs, root = file_system(spark, path)
    sub = lambda *names: file_system(spark, "/".join((path, *names)))[1]
    old, new = sub(_OLD), sub(_NEW)
    if fs.exists(old):
        for status in fs.listStatus(old):
            name = status.getPath().getName()
            if not fs.exists(sub(name)):
                whole = fs.exists(sub(_NEW, name, "_SUCCESS"))
                fs.rename(sub(_NEW, name) if whole else status.getPath(), sub(name))
    fs.delete(old, True)
    fs.delete(new, True)


def evict_bricks(spark, path: str, max_bytes: int) -> int:
    """Cap a stored collection (A9): drop the oldest documents until the rest fits in ``max_bytes``; returns
    the bytes that stay.

    The store is the one ``write_bricks`` or the stream sink writes, filed by date. The totals of
    each date (one row a day reaches the driver) tell which dates stay, whole; older dates' folders are deleted, and of
    the date in between the newest documents that fit are written anew and put in place by renaming.
    Run again after a crash, it finishes what was begun; run again on a capped store, it does nothing. One
    eviction at a time; writers may append to newer dates meanwhile.
    """
    path = path.rstrip("/")
    _settle(spark, path)
    fs, root = file_system(spark, path)
    if not fs.exists(root) or not any(s.getPath().getName().startswith("date=") for s in fs.listStatus(root)):
        return 0
    stored = document_bytes(read_bricks(spark, path))
    totals = sorted(((r.date, r.n) for r in stored.groupBy("date").agg(F.sum("size_bytes").alias("n")).collect()), reverse=True)
    kept, k = 0, 0
    while k < len(totals) and kept + totals[k][1] <= max_bytes:
        kept += totals[k][1]
        k += 1
    folder = lambda d: f"date={d.isoformat()}"
    if k < len(totals):
        day = totals[k][0]
        own = stored.where(F.col("date") == F.lit(day)).drop("date")
        cutoff = _cutoff(own, max_bytes - kept, "hour")
        if cutoff is not None:
            some = own.where(F.col("ts") >= F.to_timestamp_ntz(F.lit(cutoff.isoformat(sep=" "))))
            by = [c for c in ("batch_id",) if c in own.columns]
            some.write.partitionBy(*by).parquet(f"{path}/{_NEW}/{folder(day)}")
            kept += spark.read.parquet(f"{path}/{_NEW}/{folder(day)}").agg(F.sum("size_bytes")).first()[0]
        _, old = file_system(spark, f"{path}/{_OLD}")
        fs.mkdirs(old)
        fs.rename(file_system(spark, f"{path}/{folder(day)}")[1], file_system(spark, f"{path}/{_OLD}/{folder(day)}")[1])
        if cutoff is not None:
            fs.rename(file_system(spark, f"{path}/{_NEW}/{folder(day)}")[1], file_system(spark, f"{path}/{folder(day)}")[1])
        fs.delete(old, True)
        drop_path(spark, f"{path}/{_NEW}")
    for day, _ in totals[k + 1:]:
        drop_path(spark, f"{path}/{folder(day)}")
    return int(kept)
