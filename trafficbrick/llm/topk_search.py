"""Exact top-k inner products by an impact-ordered index (operator 5).

Vectors are turned to whole numbers, ``floor(scale * x)``. A block of candidates
is indexed as postings: for each dimension, the rows of one quantised level form
a segment. A query processes segments score-at-a-time, by descending impact
(the largest product a segment can give), and keeps for every row an upper bound
on its score. It stops early only when the bounds prove that few rows can still
be members; those are rescored exactly, so the result is exact.

Candidates and queries are packed into written blocks. Candidate blocks lie in bands of
``BAND``; every block of queries goes to every band once, where a task searches it in the
band's blocks and keeps ``k`` rows a query. What is shuffled is the queries, once for each
band, and the candidates once; neither is held by the driver or broadcast, and a task holds one block
of each. The bands' lists are merged by query.
"""

from __future__ import annotations

import json
from functools import partial
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

SCALE = 1024
BLOCK = 8192
LEVEL_BITS = 4
CHUNK_BYTES = 1 << 20   # whole numbers of a block of queries
BAND = 64               # candidate blocks that a block of queries meets in one task
_EXACT = 1 << 62


def whole_numbers(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their ``floor(scale * x)`` (shorter vectors padded with 0).

    Null vectors and those with null or non-finite components take no part. The
    dtype is object where a value leaves 63 bits.
    """
    lens = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    at = np.cumsum(lens) - lens
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    ok = (bad[at + lens] == bad[at]) & np.asarray(column.is_valid())
    rows = np.flatnonzero(ok)
    width = int(lens[rows].max()) if len(rows) else 0
    out = np.zeros((len(rows), width))
    fill = np.arange(width)[None, :] < lens[rows][:, None]
    out[fill] = values[(at[rows][:, None] + np.arange(width)[None, :])[fill]]
    scaled = np.floor(out * scale)
    if scaled.size and np.abs(scaled).max() >= _EXACT:
        return rows, np.array([[int(v) for v in r] for r in scaled], dtype=object).reshape(scaled.shape)
    return rows, scaled.astype(np.int64)


def _widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.concatenate([x, np.zeros((len(x), width - x.shape[1]), dtype=x.dtype)], axis=1)


class ImpactIndex:
    """Postings of a block of whole-number vectors by dimension and quantised level."""

    def __init__(self, x: np.ndarray):
        self.x = x
        n, d = x.shape
        top = int(np.abs(x).max()) if x.size else 0
        self.shift = max(0, top.bit_length() - LEVEL_BITS)
        level = x >> self.shift
        self.rows, dims, levels, bounds = [], [], [], [0]
        for j in range(d):
            order = np.argsort(level[:, j], kind="stable")
            cut = np.flatnonzero(np.diff(level[order, j])) + 1
            for part in np.split(order, cut):
                self.rows.append(part)
                dims.append(j)
                levels.append(level[part[0], j])
        self.dims = np.array(dims, dtype=np.int64)
        self.low = np.array(levels, dtype=np.int64) << self.shift
        self.high = self.low + (1 << self.shift) - 1

    def members(self, q: np.ndarray, k: int, floor: int | None) -> np.ndarray:
        """Rows that may be among the best ``k`` and reach ``floor``: all that are, and few more."""
        n = len(self.x)
        qs = q[self.dims]
        most = np.where(qs >= 0, qs * self.high, qs * self.low)
        least = np.where(qs >= 0, qs * self.low, qs * self.high)
        order = np.argsort(-most, kind="stable")
        upper, lower = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        # what the segments still to come can add at most, or take away at most, by dimension
        d = len(q)
        step = max(1, len(order) // 8)
        enough = max(4 * k, n // 50)
        for at in range(0, len(order), step):
            for s in order[at:at + step].tolist():
                rows = self.rows[s]
                upper[rows] += most[s]
                lower[rows] += least[s]
            left = order[at + step:]
            hi, lo = np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
            np.maximum.at(hi, self.dims[left], most[left])
            np.minimum.at(lo, self.dims[left], least[left])
            bound = floor
            if n >= k:
                kth = int(np.partition(lower, n - k)[n - k] + lo.sum())
                bound = kth if bound is None else max(bound, kth)
            if bound is None:
                continue
            open_ = np.flatnonzero(upper + hi.sum() >= bound)
            if len(open_) <= enough or at + step >= len(order):
                return open_
        return np.arange(n)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k] if scores.dtype != object else \
        np.array(sorted(range(len(ids)), key=lambda r: (-scores[r], ids[r]))[:k], dtype=np.int64)
    return ids[order], scores[order]


def _block_batches(batches: Iterator[pa.RecordBatch], scale: int, size: int) -> Iterator[pa.RecordBatch]:
    """(id, vector) -> blocks of at most ``size`` rows that take part: ids, whole numbers, width (0 and the numbers as
    text where they leave 63 bits)."""
    held_ids, held_x, many = [], [], 0

    def block() -> pa.RecordBatch:
        width = max(v.shape[1] for v in held_x)
        x = np.concatenate([_widen(v, width) for v in held_x])
        huge = x.dtype == object
        raw = json.dumps([list(map(int, r)) for r in x]).encode() if huge else x.astype("<i8").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held_ids).astype("<i8").tobytes()], pa.binary()), pa.array([raw], pa.binary()),
                                           pa.array([-1 if huge else width], pa.int32())], ["ids", "x", "width"])

    for b in batches:
        rows, x = whole_numbers(b.column(1), scale)
        ids = b.column(0).to_numpy(zero_copy_only=False)[rows]
        at = 0
        while at < len(rows):
            step = min(size - many, len(rows) - at)
            held_ids.append(ids[at:at + step])
            held_x.append(x[at:at + step])
            at, many = at + step, many + step
            if many == size:
                yield block()
                held_ids, held_x, many = [], [], 0
    if many:
        yield block()


def _unpack(ids: bytes, raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, dtype="<i8")
    if width < 0:
        rows = json.loads(raw)
        return ids, np.array(rows, dtype=object).reshape(len(ids), -1)
    return ids, np.frombuffer(raw, dtype="<i8").reshape(len(ids), width)


class _Search:
    """The best ``k`` of a block of queries, over the candidate blocks it meets."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.q, self.k = q_ids, q, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        width, k = max(x.shape[1], self.q.shape[1]), self.k
        x, q = _widen(x, width), _widen(self.q, width)
        size = int(np.abs(x).max()) * int(np.abs(q).max()) * max(width, 1) if x.size and q.size else 0
        exact = x.dtype == object or q.dtype == object or size >= _EXACT
        if exact:
            x, q = x.astype(object), q.astype(object)
        index = None if exact else ImpactIndex(x)
        for n, own in enumerate(self.q_ids):
            old_ids, old = self.best[n]
            floor = int(old[-1]) if len(old) == k and not exact else None
            # the query's own row may be among the members, so one more is asked for
            rows = np.arange(len(x)) if exact else index.members(q[n], k + 1, floor)
            rows = rows[ids[rows] != own]
            scores = x[rows] @ q[n] if width else np.zeros(len(rows), dtype=np.int64)
            self.best[n] = _best(np.r_[old_ids, ids[rows]], np.r_[old.astype(scores.dtype), scores], k)

    def rows(self) -> pa.RecordBatch:
        top = (1 << 63) - 1
        owner = np.repeat(self.q_ids, [len(i) for i, _ in self.best])
        found = [int(s) for _, scores in self.best for s in scores]
        return pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int64)), pa.array(np.concatenate([i for i, _ in self.best]).astype(np.int64)),
                                           pa.array([max(-top - 1, min(top, s)) for s in found], pa.int64())], ["query_id", "vec_id", "score"])


def _search_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a query block and a candidate block, sorted by band and query block -> each query's best ``k`` in a band."""
    now, search = None, None
    for b in batches:
        bands, numbers, widths, q_widths = (b.column(c).to_pylist() for c in ("band", "q", "width", "q_width"))
        for r in range(b.num_rows):
            key = bands[r], numbers[r]
            if key != now:
                if search is not None:
                    yield search.rows()
                search = _Search(*_unpack(b.column("q_ids")[r].as_py(), b.column("q_x")[r].as_py(), q_widths[r]), k)
                now = key
            search.meet(*_unpack(b.column("ids")[r].as_py(), b.column("x")[r].as_py(), widths[r]))
    if search is not None:
        yield search.rows()


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
          scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of every
    query with the rows of other ids, ties to the smaller id.

    Vectors that are null or hold null or non-finite components, and null ids,
    take no part. Shorter vectors count as padded with 0; an empty vector scores
    0. Rows that repeat an id are candidates each; queries that repeat an id are
    one (the first by components). Scores beyond 64 bits are held at the limits.
    Empty tables give an empty result.
    """
    pick = [F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")]
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    cand = vectors.select(*pick).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    asked = queries.select(*pick).where(F.col("id").isNotNull() & finite).groupBy("id").agg(F.min("v").alias("v"))

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        packed = rows.mapInArrow(partial(_block_batches, scale=scale, size=size), "ids binary, x binary, width int")
        return written(packed.withColumn("n", F.monotonically_increasing_id()), name)

    width = queries.agg(F.coalesce(F.max(F.size(vector_col)), F.lit(0))).first()[0]
    them = blocks(cand, BLOCK, "candidate-blocks")
    us = blocks(asked, max(1, CHUNK_BYTES // (8 * max(width, 1))), "query-blocks")
    # blocks are dealt evenly over the bands by their rank (one short row a block is ordered); few blocks: a band each,
    # as far as there are tasks for them
    many, tasks = them.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bands = max(1, -(-many // BAND), min(many, tasks))
    order = them.select("n").withColumn("band", (F.row_number().over(Window.orderBy("n")) % bands).cast("int"))
    banded = them.join(order, "n").select("band", "ids", "x", "width").repartition(bands, "band")
    sent = us.select(F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), F.col("n").alias("q"), F.col("ids").alias("q_ids"),
                     F.col("x").alias("q_x"), F.col("width").alias("q_width")).repartition(bands, "band")
    # a block of queries meets all blocks of its band one after the other
    found = sent.hint("merge").join(banded, "band")
    best = found.mapInArrow(partial(_search_batches, k=k), "query_id bigint, vec_id bigint, score bigint")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth vector."""
    from ..session import read_table
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
