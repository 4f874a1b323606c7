"""Near-duplicate join on word shingles with Bayesian pruning (operator 6).

Two documents are linked if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more (a text of fewer words is one shingle).

1. Every text gets 128 MinHash values. Equal texts are one *class*, one node of
   the join; only one of each goes on.
2. Values are banded by fours. Representatives that share a band are compared
   value by value, 16 at a time; a pair is dropped as soon as the posterior
   probability of reaching the threshold (uniform prior) falls below ``tolerance``.
   What survives is kept as a spanning forest, and its connected components say
   which texts have to meet.
3. Inside a component all pairs are compared the same way, and survivors are
   verified exactly on their shingle sets. Links are counted; a spanning forest
   of the links gives the near-duplicate groups.

Groups of any size are dealt to tasks as pairs of blocks of at most about
``BLOCK`` texts, so a hot group spreads over tasks, and neither all pairs nor
whole groups are ever rows or one task's memory. Bands with the same members
are compared once. A pair at the threshold shares no band with probability
``(1 - 0.8**4)**32``, below 5e-8.
"""

from __future__ import annotations

import functools
import math
from fractions import Fraction
from functools import partial
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .components import components
from .wordhash import Words, mix, rolling, slices, splitmix, text_bytes

SHINGLE = 5
VALUES = 128
ROWS = 4
STEP = 16
TOLERANCE = 1e-6
BLOCK = 256
_PAIRS = 1 << 17
_A = (splitmix(VALUES, 101) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (splitmix(VALUES, 103) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


# ---------------------------------------------------------------- shingles and signatures
def shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts (with repeats) and each text's range in them."""
    w = Words(data, offs)
    h = w.hashes()
    many = np.diff(w.first)
    at, _ = w.windows(size)
    count = np.maximum(many - size + 1, 0)
    short = np.flatnonzero((many > 0) & (many < size))
    count[short] = 1
    first = np.r_[0, np.cumsum(count)]
    out = np.empty(first[-1], dtype=np.uint64)
    full = np.ones(first[-1], dtype=bool)
    full[first[short]] = False
    out[full] = rolling(h, size, 5)[at]
    for t in short:
        x = np.uint64(many[t])
        for v in h[w.first[t]:w.first[t + 1]]:
            x = mix(np.array([x ^ v]))[0]
        out[first[t]] = x
    return out, first


def signatures(sh: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``VALUES`` 16-bit MinHash values of each text (all 0 without shingles)."""
    out = np.zeros((len(first) - 1, VALUES), dtype=np.uint16)
    some = np.flatnonzero(np.diff(first))
    if not len(some):
        return out
    x = (sh >> np.uint64(32)).astype(np.uint32)
    starts = first[:-1][some]
    for k in range(VALUES):
        v = x * _A[k]
        v ^= v >> np.uint32(15)
        v *= _B[k]
        v ^= v >> np.uint32(16)
        least = np.minimum.reduceat(v, starts)
        out[some, k] = (mix(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of equally long rows."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)]) \
             .cast(pa.binary())


def _matrix(column: pa.Array) -> np.ndarray:
    """The signatures of a binary column."""
    a = column.cast(pa.large_binary())
    offs = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset:a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], dtype=np.uint16)[offs[0] // 2:offs[-1] // 2].reshape(len(a), VALUES)


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = text_bytes(b.column(2))
        for i, j in slices(offs):
            sh, first = shingles(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i),
                                              pa.array(np.diff(first) > 0), _binary(signatures(sh, first))],
                                             ["id", "digest", "some", "sig"])


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bands = _matrix(b.column(1)).view(np.uint64)
        n = bands.shape[1]
        keys = mix(bands ^ splitmix(n, 107)[None, :])
        rep = b.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(rep, n))], ["k", "rep"])


# ---------------------------------------------------------------- pruning
@functools.cache
def needed(threshold: float, tolerance: float) -> list[int]:
    """Least matches after 16, 32, ... values with a posterior of ``tolerance`` or more.

    With a uniform prior, P(J > t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs ``(a, b)`` of rows of ``sig`` that pass every step of the comparison."""
    m = np.zeros(len(a), dtype=np.int64)
    for k, least in enumerate(needed(threshold, tolerance)):
        part = slice(k * STEP, (k + 1) * STEP)
        m += np.count_nonzero(sig[a, part] == sig[b, part], axis=1)
        keep = m >= least
        a, b, m = a[keep], b[keep], m[keep]
    return a, b


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's component under the edges ``(a, b)``."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        if (label[a] == label[b]).all():
            return label


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (runs of equal values in the first ``keys`` columns) and their bounds."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[:1] = True
        for c in range(keys):
            v = table.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        table = pa.Table.from_batches(held).combine_chunks()
        starts = cut(table)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
            held = table.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.r_[cut(table), table.num_rows]


def _pairs(bounds: np.ndarray, block: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs to compare, group by group, in portions: within a block, or between the two of a pair of blocks."""
    got_a: list[np.ndarray] = []
    got_b: list[np.ndarray] = []
    size = 0
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo < 2:
            continue
        if left[lo] == right[lo]:
            a, b = _triangle(hi - lo)
        else:
            first, second = np.flatnonzero(block[lo:hi] == left[lo]), np.flatnonzero(block[lo:hi] == right[lo])
            a, b = np.repeat(first, len(second)), np.tile(second, len(first))
        for at in range(0, len(a), _PAIRS):
            got_a.append(a[at:at + _PAIRS] + lo)
            got_b.append(b[at:at + _PAIRS] + lo)
            size += len(got_a[-1])
            if size >= _PAIRS:
                yield np.concatenate(got_a), np.concatenate(got_b)
                got_a, got_b, size = [], [], 0
    if size:
        yield np.concatenate(got_a), np.concatenate(got_b)


@functools.lru_cache(maxsize=64)
def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _edge_batches(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """(group, left, right, block, rep, sig) -> edges of a spanning forest of the survivors."""
    for table, bounds in whole_groups(batches, 3):
        left, right, block, rep = (table.column(c).to_numpy() for c in (1, 2, 3, 4))
        sig = _matrix(table.column(5).combine_chunks())
        for a, b in _pairs(bounds, block, left, right):
            a, b = survivors(sig, a, b, threshold, tolerance)
            if len(a):
                label = forest(len(rep), a, b)
                at = np.flatnonzero(label != np.arange(len(rep)))
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[label[at]])], ["a", "b"])


def blocked(rows: DataFrame, group: str, size: str, node: str) -> DataFrame:
    """``rows`` dealt to pairs of blocks: columns ``left, right, block`` are added and each
    row is repeated for every block of its group. Rows are sorted by group and pair in each partition."""
    blocks = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    dealt = (rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")))
    return dealt.repartition(group, "left", "right").sortWithinPartitions(group, "left", "right")


# ---------------------------------------------------------------- exact verification
def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label, size, text) -> node, label, size, sig, set (sorted distinct shingles)."""
    for b in batches:
        data, offs = text_bytes(b.column(3))
        for i, j in slices(offs):
            sh, first = shingles(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            sets = [np.unique(sh[first[k]:first[k + 1]]).tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, j - i) for c in range(3)],
                                              _binary(signatures(sh, first)), pa.array(sets, pa.binary())],
                                             ["node", "label", "size", "sig", "set"])


def common(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every set in ``rows`` with every one in ``cols``."""
    lens = np.array([len(s) for s in sets])
    values, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), lens)
    shared = np.cumsum(count > 1) - 1       # values of one set alone meet nothing
    keep = count[back] > 1
    owner, back = owner[keep], shared[back[keep]]
    order = np.argsort(back, kind="stable")
    owner, back = owner[order], back[order]
    total = np.zeros((len(rows), len(cols)), dtype=np.float32)
    width = 4096
    for lo in range(0, int((count > 1).sum()), width):
        x, y = np.searchsorted(back, [lo, lo + width])
        hit = np.zeros((len(sets), width), dtype=np.float32)
        hit[owner[x:y], back[x:y] - lo] = 1
        total += hit[rows] @ hit[cols].T
    return total.astype(np.int64)


def _link_batches(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """(label, left, right, block, node, sig, set) -> links of each node, and edges of a spanning forest."""
    ratio = Fraction(str(threshold))
    for table, bounds in whole_groups(batches, 3):
        left, right, block, node = (table.column(c).to_numpy() for c in (1, 2, 3, 4))
        sig, raw = _matrix(table.column(5).combine_chunks()), table.column(6)
        found_a, found_b = [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo < 2:
                continue
            sets = [np.frombuffer(s, dtype=np.uint64) for s in raw.slice(lo, hi - lo).to_pylist()]
            lens = np.array([len(s) for s in sets])
            inside = left[lo] == right[lo]
            rows = np.arange(hi - lo) if inside else np.flatnonzero(block[lo:hi] == left[lo])
            cols = rows if inside else np.flatnonzero(block[lo:hi] == right[lo])
            place = np.zeros(hi - lo, dtype=np.int64)
            if not len(rows) or not len(cols):
                continue
            both = None
            for a, b in _pairs(np.array([0, hi - lo]), block[lo:hi], left[lo:hi], right[lo:hi]):
                a, b = survivors(sig[lo:hi], a, b, threshold, tolerance)
                if not len(a):
                    continue
                if both is None:
                    both = common(sets, rows, cols)
                place[rows] = np.arange(len(rows))
                x = place[a].copy()
                place[cols] = np.arange(len(cols))
                inter = both[x, place[b]]
                union = lens[a] + lens[b] - inter
                ok = inter * ratio.denominator >= union * ratio.numerator
                found_a.append(a[ok] + lo)
                found_b.append(b[ok] + lo)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
        if not len(a):
            continue
        links = np.bincount(np.r_[a, b], minlength=len(node))
        label = forest(len(node), a, b)
        at, up = np.flatnonzero(links), label
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links[at].astype(np.int64)), pa.array(node[up[at]])],
                                         ["node", "links", "peer"])


# ---------------------------------------------------------------- the join
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                    tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``class_id`` (least id of its near-duplicate
    group), ``rep_id`` (least id of the same text), ``n_copies`` (rows of that text),
    ``n_links`` (other texts at the threshold or above), ``digest`` (of the text) and ``group``
    (a number for each near-duplicate group, equal within one run only).

    ``id_col`` is a whole number. Null text counts as empty; empty and wordless
    texts are copies of each other where the texts are equal, and have no links.
    Texts are compared as texts, whatever their ids: rows that share an id but not the text
    may be in different groups (of one ``class_id``, where it is the least id of both). A row with
    a null id belongs to its text's class; a text of which no row has an id is a group of
    its own, without links and with null ids. An empty table gives an empty result.
    """
    spark = docs.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        where = scratch_path(spark, name)
        df.write.parquet(where)
        return spark.read.parquet(where)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))
    signed = written(base.mapInArrow(_signature_batches, "id bigint, digest binary, some boolean, sig binary"), "signatures")
    # a text's node is a number given once, in the written table: ids may repeat over texts
    classes = written(signed.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_copies"),
                                                   F.first("some").alias("some"), F.first("sig").alias("sig"))
                            .withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = classes.where(F.col("some") & F.col("least").isNotNull()).select(F.col("node").alias("rep"), "sig")

    # bands that hold several texts; of bands with the same members one is kept
    bands = reps.mapInArrow(_band_batches, "k bigint, rep bigint")
    groups = (bands.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"),
                                     F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
                   .where(F.col("n") > 1).groupBy("n", "x", "y").agg(F.min("k").alias("k")).select("k", "n"))
    met = bands.join(groups, "k").join(reps, "rep").select("k", "n", "rep", "sig")
    edges = written(blocked(met, "k", "n", "rep").select("k", "left", "right", "block", "rep", "sig")
                    .mapInArrow(partial(_edge_batches, threshold=threshold, tolerance=tolerance), "a bigint, b bigint"), "pairs")
    meet = written(components(edges, "a", "b"), "meet")

    sizes = meet.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    wanted = (meet.join(sizes, "label").join(classes.select("node", "least", "digest"), "node")
                  .select(F.col("least").alias("id"), "digest", "node", "label", "size"))
    # a merge join at every size: the texts move alike whether few or many of them are wanted
    sets = (base.join(wanted.hint("merge"), ["id", "digest"]).dropDuplicates(["node"]).select("node", "label", "size", "text")
                .mapInArrow(_set_batches, "node bigint, label bigint, size bigint, sig binary, set binary"))
    links = written(blocked(sets, "label", "size", "node").select("label", "left", "right", "block", "node", "sig", "set")
                    .mapInArrow(partial(_link_batches, threshold=threshold, tolerance=tolerance),
                                "node bigint, links bigint, peer bigint"), "links")

    groups_of = components(links, "node", "peer")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = (classes.select("digest", "node", "least", "n_copies").join(groups_of, "node", "left").join(counted, "node", "left")
                      .withColumn("group", F.coalesce("label", "node")))
    grouped = written(grouped.select("digest", "least", "n_copies", "links", "group"), "text-groups")
    ids = grouped.groupBy("group").agg(F.min("least").alias("class_id"))
    return (signed.select("id", "digest").join(grouped.join(ids, "group"), "digest")
                  .select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "class_id",
                          F.col("least").alias("rep_id"), "n_copies", F.coalesce("links", F.lit(0)).alias("n_links"), "digest", "group"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate class and links of every document."""
    from ..session import read_table
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("digest", "group")
