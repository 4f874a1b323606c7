"""Substring deduplication with difference-cover anchors (operator 1).

A *window* is ``size`` consecutive words of one document (words are runs of
bytes outside 0x20 and 0x09-0x0D). Every word that lies in a window whose word
sequence also starts in a document of smaller id is removed.

Method. ``cover`` is a difference cover modulo ``period``: every residue is a
difference of two of its members. Words at positions whose residue is in the
cover start an *anchor* of ``size - period + 1`` words. Two equal windows always
hold an anchor at the same distance from their starts, whatever their places in
the two documents, so hashing about a fifth of the positions finds every match.
Anchors that occur in two different texts are then extended: the full windows
around them are compared by a 96-bit hash, once for each text, and the smallest
document of each decides.

Distribution. Anchors and windows are only ever counted by key with map-side
combine, written, and joined back by key, so a passage shared by a third of all
documents costs one row per task in the aggregate, and its join is between two
plain exchanges, which adaptive execution splits. No pairs are formed. Exact
copies are settled by their digest alone. Each step's result is a small written
table (keys, places); the shuffle files of a step go when it ends.
"""

from __future__ import annotations

from functools import partial
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written
from .wordhash import Words, mix, rolling, slices, text_bytes

# Perfect difference sets, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
# anchors only propose windows, so 48 bits are enough for them
_SHORT = np.uint64(16)


def cover_for(size: int) -> tuple[int, tuple[int, ...], int]:
    """``(period, cover, anchor words)`` for windows of ``size`` words: the
    longest period that leaves an anchor of a third of the window at least."""
    period = max(p for p in COVERS if p == 1 or size - p + 1 >= max(2, size // 3))
    return period, COVERS[period], size - period + 1


def _anchor_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    period, cover, span = cover_for(size)
    chosen = np.zeros(period, dtype=bool)
    chosen[list(cover)] = True
    for b in batches:
        data, offs = text_bytes(b.column(2))
        ids, digests = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        for i, j in slices(offs):
            w = Words(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            at, text = w.windows(span)
            place = at - w.first[text]
            keep = chosen[place % period] & (np.diff(w.first)[text] >= size)
            at, text, place = at[keep], text[keep], place[keep]
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((rolling(w.hashes(), span, 1)[at] >> _SHORT).view(np.int64)),
                     pa.array(digests[i:j][text]), pa.array(ids[i:j][text]), pa.array(place.astype(np.int32))],
                    ["anchor", "tag", "id", "place"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column (null: empty)."""
    lens = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), dtype=np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lens)]


def _covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Mask over ``n`` places of the union of ranges ``lo..hi-1``."""
    step = np.bincount(lo, minlength=n + 1)[:n + 1] - np.bincount(hi, minlength=n + 1)[:n + 1]
    return np.cumsum(step)[:n] > 0


def _window_keys(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The 96-bit hash of the window from each word on."""
    h = w.hashes()
    return rolling(h, size, 2), (rolling(h, size, 3) >> np.uint64(32)).astype(np.uint32)


def _first_of_each(h1: np.ndarray, h2: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of the first of equal windows of one text, in order of text."""
    order = np.lexsort((h2, h1, text))
    a, b, t = h1[order], h2[order], text[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (t[1:] != t[:-1])
    return order[new]


def _with_repeats(w: Words, size: int, start: np.ndarray) -> np.ndarray:
    """``start`` and every other window of the same texts that equals one of them."""
    text = np.searchsorted(w.first, start, "right") - 1
    at, owner = w.windows(size)
    wanted = np.isin(owner, text)
    at, owner = at[wanted], owner[wanted]
    h1, h2 = _window_keys(w, size)
    key = mix(h1[at] ^ mix(h2[at].astype(np.uint64) << np.uint64(32) | owner.astype(np.uint64)))
    gone = mix(h1[start] ^ mix(h2[start].astype(np.uint64) << np.uint64(32) | text.astype(np.uint64)))
    return at[np.isin(key, gone)]


def _window_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    span = cover_for(size)[2]
    for b in batches:
        data, offs = text_bytes(b.column(2))
        ids, tags = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        places, cuts = _lists(b.column(3))
        for i, j in slices(offs):
            w = Words(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            many = np.diff(w.first)
            p = places[cuts[i]:cuts[j]].astype(np.int64)
            text = np.repeat(np.arange(j - i), np.diff(cuts[i:j + 1]))
            lo = np.maximum(p + span - size, 0) + w.first[text]
            hi = np.minimum(p, many[text] - size) + 1 + w.first[text]
            start = np.flatnonzero(_covered(lo, hi, len(w)))
            if not len(start):
                continue
            text = np.searchsorted(w.first, start, "right") - 1
            h1, h2 = _window_keys(w, size)
            once = _first_of_each(h1[start], h2[start], text)
            start, text = start[once], text[once]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[start].view(np.int64)), pa.array(h2[start].view(np.int32)), pa.array(ids[i:j][text]),
                 pa.array(tags[i:j][text]), pa.array((start - w.first[text]).astype(np.int32))], ["h1", "h2", "id", "tag", "place"])


def _kept_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """In: rest, text, starts, copy. Out: rest, text of the kept words, n_words, n_removed."""
    for b in batches:
        data, offs = text_bytes(b.column(1))
        starts, cuts = _lists(b.column(2))
        copy = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
        for i, j in slices(offs):
            w = Words(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            many = np.diff(w.first)
            text = np.repeat(np.arange(j - i), np.diff(cuts[i:j + 1]))
            lo = starts[cuts[i]:cuts[j]].astype(np.int64) + w.first[text]
            if len(lo):
                lo = _with_repeats(w, size, lo)
            gone = _covered(lo, lo + size, len(w)) | np.repeat(copy[i:j] & (many >= size), many)
            kept = np.flatnonzero(~gone)
            owner = np.repeat(np.arange(j - i), many)[kept]
            mask = w.inside.copy()
            dead = np.flatnonzero(gone)
            if len(dead):
                mask &= ~_covered(w.start[dead], w.end[dead], len(mask))
            joint = w.end[kept[:-1]][owner[1:] == owner[:-1]]  # a blank follows each word but a text's last
            out = w.data.copy()
            out[joint] = 0x20
            mask[joint] = True
            ends = np.r_[0, np.cumsum(mask)][offs[i:j + 1] - offs[i]].astype(np.int64)
            body = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(ends), pa.py_buffer(out[mask]))
            removed = np.bincount(np.repeat(np.arange(j - i), many)[gone], minlength=j - i)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), body.cast(pa.string()), pa.array(many.astype(np.int64)),
                 pa.array(removed.astype(np.int64))], ["rest", "text", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50) -> DataFrame:
    """``docs`` without the words that repeat from a smaller ``id_col`` (a whole number).

    Returns ``rest`` (a struct of all columns of ``docs`` but the text), ``text``
    (the kept words joined by one blank), ``n_words`` and ``n_removed``; one row
    for each row of ``docs``. Windows are judged on the input texts.

    Null or empty text: no words, ``text`` is empty. Fewer than ``size`` words:
    nothing is removed. Null id: the row neither removes nor loses words.
    Repeated rows of one id do not remove each other's words; different texts of
    one id are told apart by 64 bits of their digest. An empty table
    gives an empty result.
    """
    rest = [c for c in docs.columns if c != text_col]
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.struct(*rest).alias("rest"))
    some = base.where(F.col("id").isNotNull())
    tag = F.xxhash64("text").alias("tag")
    texts = some.select("id", tag, "text", "rest")

    anchors = some.select("id", tag, "text").mapInArrow(
        partial(_anchor_batches, size=size), f"anchor bigint, tag bigint, id {id_type}, place int")
    shared = written(anchors.groupBy("anchor").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi"))
                            .where(F.col("lo") != F.col("hi")).select("anchor"), "shared-anchors")
    places = written(anchors.join(shared, "anchor")
                            .groupBy("id", "tag").agg(F.collect_list("place").alias("places")), "anchor-places")

    # nothing follows the join, so the rows of a text that many documents copy can be dealt over tasks
    known = some.select("id", tag, F.unhex(F.sha2("text", 256)).alias("key")).distinct()
    first = known.groupBy("key").agg(F.min("id").alias("first"))
    copies = written(known.join(first, "key").where(F.col("id") > F.col("first"))
                          .select("id", "tag", F.lit(True).alias("copy")), "copies")

    windows = (texts.select("id", "tag", "text").join(places.join(copies, ["id", "tag"], "left_anti"), ["id", "tag"])
                    .select("id", "tag", "text", "places")
                    .mapInArrow(partial(_window_batches, size=size), f"h1 bigint, h2 int, id {id_type}, tag bigint, place int"))
    least = written(windows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
                           .where(F.col("n") > 1).select("h1", "h2", "least"), "repeated-windows")
    starts = written(windows.join(least, ["h1", "h2"]).where(F.col("id") > F.col("least"))
                            .groupBy("id", "tag").agg(F.collect_list("place").alias("starts")), "repeat-starts")
    keyed = (texts.join(starts, ["id", "tag"], "left").join(copies, ["id", "tag"], "left")
                  .select("rest", "text", "starts", F.coalesce("copy", F.lit(False)).alias("copy")))
    without = base.where(F.col("id").isNull()).select("rest", "text", F.array().cast("array<int>").alias("starts"),
                                                      F.lit(False).alias("copy"))
    return (keyed.unionByName(without)
                 .mapInArrow(partial(_kept_batches, size=size),
                             f"rest {base.schema['rest'].dataType.simpleString()}, text string, "
                             "n_words bigint, n_removed bigint"))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its words, the removed ones and the digest of the kept text."""
    from ..session import read_table
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select(F.col("rest.doc_id").alias("doc_id"), "n_words", "n_removed",
                      F.sha2("text", 256).alias("kept_sha256"))
