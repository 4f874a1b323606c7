"""Best-fit packing after Martello-Toth dominance reduction (operator 9).

Documents become token pieces of at most ``capacity``; the pieces are packed
into as few sequences as can be. Lengths are whole numbers up to the capacity,
so an instance of any size is a histogram of at most ``capacity`` counts: the
reduction and the best-fit pass work on those counts in bulk on the driver and
give a plan of *slots* (length, rank range, sequences, offset). Pieces get a
rank within their length in parallel and look their slot up.

Reduction (each rule keeps an optimal packing):

* a full piece, or one that nothing else fits beside, is a sequence of its own;
* two lengths that fill a sequence exactly belong together;
* if one more piece at most fits beside ``j``, the longest that fits does;
* if two at most fit and no pair of them is longer than the longest single
  one, that single one does.
"""

from __future__ import annotations

import functools
import json
import zlib
from functools import partial
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .runs import parts, pretokens, run_hashes
from .token_counts import byte_signs, tokenizer_path

CAPACITY = 2048
END_ID = 0
PARTS = 8192        # parts that all pieces are ranked in, besides one a length
KEPT_WORDS = 300_000


# ---------------------------------------------------------------- token ids
class Encoder:
    """Token ids of pretokens, as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        back = {s: b for b, s in byte_signs().items()}
        vocab = {bytes(back[c] for c in w): i for w, i in model["model"]["vocab"].items() if all(c in back for c in w)}
        added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        for w in added:
            vocab.pop(w.encode(), None)
        self.special = next(iter(added), "")
        self.special_ids = np.array([added.get(self.special, 0)], dtype="<u4").tobytes()
        self.bpe = tiktoken.Encoding("bytes", pat_str=r"(?s).+", mergeable_ranks=vocab, special_tokens={})
        self.kept: dict[int, bytes] = {}

    def ids(self, word: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(word), dtype="<u4").tobytes()


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def _ids_of(column: pa.Array, enc: Encoder) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, ids)`` for every row that has text, in order."""
    held_row, held = -1, []
    for part in parts(column):
        start, special = pretokens(part, enc.special)
        if not len(start):
            continue
        end = np.r_[start[1:], len(part.points)]
        keys, where, back = np.unique(run_hashes(part.points, start, end), return_index=True, return_inverse=True)
        if len(enc.kept) > KEPT_WORDS:
            enc.kept.clear()
        known = [enc.kept.get(k) for k in keys.tolist()]
        for k, ids in enumerate(known):
            if ids is None:
                w = where[k]
                known[k] = enc.special_ids if special[w] else enc.ids(part.text[start[w]:end[w]])
                enc.kept[int(keys[k])] = known[k]
        pool = np.frombuffer(b"".join(known), dtype="<u4")
        size = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        base = np.cumsum(size) - size
        many = size[back]
        total = np.r_[0, np.cumsum(many)]
        flat = pool[np.arange(total[-1]) + np.repeat(base[back] - total[:-1], many)]
        cuts = total[np.searchsorted(start, part.offsets)]
        for r in range(part.hi - part.lo):
            if cuts[r] == cuts[r + 1]:
                continue
            if part.lo + r != held_row:
                if held:
                    yield held_row, held[0] if len(held) == 1 else np.concatenate(held)
                held_row, held = part.lo + r, []
            held.append(flat[cuts[r]:cuts[r + 1]])
    if held:
        yield held_row, held[0] if len(held) == 1 else np.concatenate(held)


def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    enc = encoder_of(path)
    end = np.array([END_ID], dtype="<u4")
    for b in batches:
        found = dict.fromkeys(range(b.num_rows), end)
        rows: list[tuple[int, int, int, int, int]] = []

        def cut(row: int, ids: np.ndarray) -> None:
            n = len(ids)
            first = n % capacity or capacity
            lo, hi, k = 0, min(first, n), 0
            while lo < n:
                rows.append((row, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
                lo, hi, k = hi, hi + capacity, k + 1

        for row, ids in _ids_of(b.column(1), enc):
            found.pop(row)
            cut(row, np.concatenate([ids, end]))
        for row in found:
            cut(row, end)
        at, piece, lo, size, crc = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(lo),
                                          pa.array(size), pa.array(crc)], ["id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32``: each text's ids and the end
    id, cut from the end into pieces of ``capacity`` (the first may be shorter)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_piece_batches, path=path, capacity=capacity),
                           f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


# ---------------------------------------------------------------- the plan
class Shelf:
    """``many`` sequences with the same content ``items`` of (length, how many)."""

    def __init__(self, many: int, items: list[tuple[int, int]], room: int):
        self.many, self.items, self.room = many, items, room


def _best_pair(have: np.ndarray, room: int) -> int:
    """Largest sum up to ``room`` of two available lengths (0: none)."""
    sizes = np.flatnonzero(have[:room + 1] > 0)
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        total = int(sizes[i] + sizes[j])
        if total > room or (i == j and have[sizes[i]] < 2):
            j -= 1
        else:
            best, i = max(best, total), i + 1
    return best


def reduce_by_dominance(have: np.ndarray, capacity: int) -> list[Shelf]:
    """Take from ``have`` (counts by length) the sequences that some optimal packing has."""
    fixed: list[Shelf] = []

    def fix(many: int, *items: tuple[int, int]) -> None:
        if many > 0:
            for size, q in items:
                have[size] -= many * q
            fixed.append(Shelf(int(many), list(items), capacity - sum(s * q for s, q in items)))

    fix(have[capacity], (capacity, 1))
    for j in range(capacity - 1, capacity // 2, -1):
        fix(min(have[j], have[capacity - j]), (j, 1), (capacity - j, 1))
    if capacity % 2 == 0:
        fix(have[capacity // 2] // 2, (capacity // 2, 2))
    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(have)[::-1].tolist():
            while have[j] > 0:
                have[j] -= 1
                rest = np.flatnonzero(have)
                small = np.repeat(rest[:3], np.minimum(have[rest[:3]], 3))[:3].tolist()
                fits = rest[rest <= capacity - j]
                have[j] += 1
                if not len(fits):
                    fix(have[j] if j + j > capacity else 1, (j, 1))
                    changed = True
                    continue
                k = int(fits[-1])
                single = len(small) < 2 or j + small[0] + small[1] > capacity
                if not single and (len(small) < 3 or j + sum(small) > capacity):
                    have[j] -= 1
                    single = _best_pair(have, capacity - j) <= k
                    have[j] += 1
                if not single:
                    break
                if k == j:
                    fix(have[j] // 2, (j, 2))
                else:
                    fix(min(have[j], have[k]), (j, 1), (k, 1))
                changed = True
    return fixed


def best_fit(have: np.ndarray, capacity: int) -> list[Shelf]:
    """Best-fit decreasing over counts: a piece goes where least room is left."""
    open_: list[list[Shelf]] = [[] for _ in range(capacity + 1)]
    for size in np.flatnonzero(have)[::-1].tolist():
        left = int(have[size])
        for room in range(size, capacity + 1):
            if not left:
                break
            q = room // size
            keep = []
            for s in open_[room]:
                full = min(s.many, left // q)
                if full:
                    open_[room - q * size].append(Shelf(full, s.items + [(size, q)], room - q * size))
                    s.many -= full
                    left -= full * q
                if s.many and left and left < q:
                    open_[room - left * size].append(Shelf(1, s.items + [(size, left)], room - left * size))
                    s.many -= 1
                    left = 0
                if s.many:
                    keep.append(s)
            open_[room] = keep
        q = capacity // size
        if left // q:
            open_[capacity - q * size].append(Shelf(left // q, [(size, q)], capacity - q * size))
        if left % q:
            open_[capacity - left % q * size].append(Shelf(1, [(size, left % q)], capacity - left % q * size))
        have[size] = 0
    return [s for shelves in open_ for s in shelves]


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Slots ``(length, first rank, ranks, per sequence, first sequence, offset)`` sorted by length and rank."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        have[size] = n
    shelves = reduce_by_dominance(have, capacity) + best_fit(have, capacity)
    taken, slots, sequence = np.zeros(capacity + 1, dtype=np.int64), [], 0
    for s in shelves:
        offset = 0
        for size, q in s.items:
            slots.append((size, taken[size], s.many * q, q, sequence, offset))
            taken[size] += s.many * q
            offset += size * q
        sequence += s.many
    return np.array(sorted(slots), dtype=np.int64).reshape(-1, 6)


def _slot_batches(batches: Iterator[pa.RecordBatch], slots) -> Iterator[pa.RecordBatch]:
    s = slots.value
    key = s[:, 0] << 44 | s[:, 1]
    for b in batches:
        size, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
        at = np.searchsorted(key, size << 44 | rank, "right") - 1
        nth = rank - s[at, 1]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:5], pa.array(s[at, 4] + nth // s[at, 3]), pa.array(s[at, 5] + nth % s[at, 3] * size)],
            ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``id, piece, start, length, ids_crc32``) with ``sequence_id`` and ``offset``.

    ``pieces`` is read three times: give a written table. The driver holds one
    count for each length (at most ``capacity``). Ranks are taken within parts of a
    length, as many as its share of ``PARTS`` and one at least: a part holds about a ``PARTS``-th of
    all pieces at most, however many have one length. The table of part sizes has at most
    ``PARTS + capacity`` rows and is broadcast.
    """
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(sum(counts.values()), 1)
    parts_of = F.get(F.lit([max(1, counts.get(k, 0) * PARTS // total) for k in range(capacity + 1)]), F.col("length").cast("int"))
    sized = pieces.withColumn("part", F.pmod(F.xxhash64("id", "piece"), parts_of).cast("int"))
    sizes = sized.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    slots = spark.sparkContext.broadcast(plan(counts, capacity))
    within = Window.partitionBy("length", "part").orderBy("id", "piece")
    ranked = (sized.withColumn("nth", F.row_number().over(within) - 1)
                   .join(F.broadcast(base), ["length", "part"])
                   .select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")))
    kind = pieces.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(partial(_slot_batches, slots=slots),
                             f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
                             "sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack ``docs``: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    Null or empty text: one piece of the end id alone. Repeated rows are packed
    once each; null ids are kept. An empty table gives no piece. The pieces are
    written under the checkpoint folder, so texts are tokenised once.
    """
    where = scratch_path(docs.sparkSession, "token-pieces")
    token_pieces(docs, path, id_col, text_col, capacity).write.parquet(where)
    return pack(docs.sparkSession.read.parquet(where), capacity).withColumnRenamed("id", id_col)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    from ..session import read_table
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
