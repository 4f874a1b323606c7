"""Token counts by heap-and-linked-list byte-pair merging (operator 3).

A pretoken starts as one symbol per byte. A heap holds every adjacent pair that
has a merge rank; the lowest rank (leftmost first) is popped, its two symbols
become one in a linked list, and the pairs with the new neighbours are pushed.
The count is the number of initial symbols minus the merges; no identifiers of
a text are built. Each task keeps the counts of recent pretokens.
"""

from __future__ import annotations

import functools
import heapq
import json
from functools import partial
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import parts, pretokens, run_hashes

KEPT_WORDS = 400_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merges:
    """The merge table of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.first = [vocab[s] for _, s in sorted(byte_signs().items())]
        special = [t["content"] for t in model.get("added_tokens", [])]
        if len(special) > 1:
            raise ValueError("one added token at most is supported")
        self.special = special[0] if special else ""
        self.kept: dict[int, int] = {}

    def count(self, word: bytes) -> int:
        """Symbols left of ``word`` after all merges."""
        sym = [self.first[b] for b in word]
        n = len(sym)
        ranks = self.ranks
        heap = []
        for i in range(n - 1):
            found = ranks.get((sym[i], sym[i + 1]))
            if found:
                heap.append((found[0], i, sym[i], sym[i + 1], found[1]))
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue
            merges += 1
            sym[i], sym[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = ranks.get((made, sym[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, made, sym[k], found[1]))
            h = before[i]
            if h >= 0:
                found = ranks.get((sym[h], made))
                if found:
                    heapq.heappush(heap, (found[0], h, sym[h], made, found[1]))
        return n - merges


@functools.lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    return Merges(path)


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = merges_of(path)
    for b in batches:
        total = np.zeros(b.num_rows, dtype=np.int64)
        for part in parts(b.column(1)):
            start, special = pretokens(part, m.special)
            if not len(start):
                continue
            end = np.r_[start[1:], len(part.points)]
            keys, where, back = np.unique(run_hashes(part.points, start, end), return_index=True, return_inverse=True)
            if len(m.kept) > KEPT_WORDS:
                m.kept.clear()
            known = [m.kept.get(k, -1) for k in keys.tolist()]
            for k, c in enumerate(known):
                if c < 0:
                    w = where[k]
                    known[k] = 1 if special[w] else m.count(part.text[start[w]:end[w]].encode())
                    m.kept[int(keys[k])] = known[k]
            counts = np.r_[0, np.cumsum(np.array(known, dtype=np.int64)[back])]
            total[part.lo:part.hi] += np.diff(counts[np.searchsorted(start, part.offsets)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(total)], ["id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    ``path`` is a byte-level BPE file readable on every executor. Null or empty
    text: no bytes, no tokens. Null ids and repeated rows are kept as they are;
    further columns of ``docs`` are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), t.alias("text"), F.octet_length(t).cast("bigint").alias("n_bytes"))
    out = rows.mapInArrow(partial(_count_batches, path=path), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document under the 50k byte-level vocabulary."""
    from ..session import read_table
    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
