"""Starting a streaming query with its own state settings."""

from __future__ import annotations

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# the store's own row count, for a metric that nothing here reads, takes a look-up for every row put or removed
COUNT_ROWS = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"


def start(spark, writer, state_partitions: int | None = None):
    """Start ``writer`` on the RocksDB state store, which processors with timers and maps need.

    With ``state_partitions``, the query's state (and its per-batch shuffles) use that
    many partitions; the count is pinned in the query's checkpoint on first start. A query keeps a
    clone of the session's settings, so the caller's are put back right after.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if spark.conf.get(COUNT_ROWS, None) is None:
        wanted[COUNT_ROWS] = "false"
    if state_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(state_partitions)
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
