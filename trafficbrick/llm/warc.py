"""WARC archives: writing, and reading by boundary-chain verification (operator 10).

Writing goes through Spark's text writer: every row is one whole record, so files
are committed by Spark and rotate after a number of records.

Reading splits files at any byte. The record magic is the line separator of
Spark's text reader, so every task sees the candidate records of its split; each
candidate tells its successor's offset (its own plus header, content and the two
blank lines). A candidate inside a payload is told from a record by reachability:
inside a split, successors are followed to the first offset beyond it, and pointer
jumping from each file's start over those exits finds the one candidate through
which a split is entered. Only candidates on the chain from there are records.
Payloads that hold the magic are put together again from their candidates.
"""

from __future__ import annotations

import base64
import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# The format's version line, blank line and record end.
MAGIC = "WARC/1.0\r\n"
_BLANK = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
RECORDS_PER_FILE = 20_000
BROADCAST_ROWS = 200_000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1 (40 signs; RFC 4648 alphabet)."""
    fives = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*fives)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _beside(rows: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join that broadcasts ``small`` only while it is counted to be within ``BROADCAST_ROWS``."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(small) if few else small, on, how)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """One record per row of ``pages`` under ``path``.

    Of rows with equal payloads of ``min_bytes`` or more, those of the smallest id
    are ``response`` records and the others ``revisit`` records that refer to it;
    shorter payloads are all responses. Null html: an empty payload. Null url: an
    empty address; line ends in an address are escaped. A null id never is the
    smallest. Further columns are not read.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                        html.alias("html"))
    keys = rows.where(F.octet_length("html") >= min_bytes).select("id", F.sha2("html", 256).alias("key"))
    first = keys.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # payloads stay where they are: only the keys that occur again meet the rows
    again = first.where(F.col("first").isNotNull()).select("key", "first")
    marked = _beside(rows.withColumn("key", F.sha2("html", 256)), again, ["key"], "left")
    revisit = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first"))) \
        & (F.octet_length("html") >= min_bytes)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(_HTTP), F.octet_length("html").cast("string"), F.lit(_BLANK))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name("id"), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.sha1("html")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name("first"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(_BLANK), block)
    (marked.select(record.alias("value")).write.option("lineSep", _BLANK).option("maxRecordsPerFile", records_per_file)
           .text(path))


# ---------------------------------------------------------------- candidates
_CHUNK = ("file string, block bigint, nth bigint, rel bigint, size bigint, reach bigint, whole boolean, kind string, "
          "record_id string, refers string, stated string, payload_bytes bigint, payload_digest string, exit bigint")


def parse_record(raw: bytes) -> dict | None:
    """Header fields, payload and total length of the record that ``raw`` (magic
    taken off) begins with; None without a whole header of it."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in raw[:end].split(b"\r\n"):
        key, sign, value = line.partition(b":")
        if not sign:
            return None
        fields[key.strip().lower()] = value.strip()
    size = fields.get(b"content-length", b"")
    if not size.isdigit() or len(size) > 15:
        return None
    begin = end + 4
    block = raw[begin:begin + int(size)]
    head = block.find(b"\r\n\r\n")
    payload = block[head + 4:] if head >= 0 and block.startswith(b"HTTP/") else block
    return {"fields": fields, "reach": begin + int(size) + 4, "payload": payload}


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _text(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace")


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, file, block) in file order within each split -> candidate rows.

    ``rel`` is the offset after the magic in the split's own count of bytes,
    ``reach`` the successor's (null without a header), ``exit`` the first offset
    on the chain that no candidate of the split has. A split's candidates are
    held without their payloads until it ends.
    """
    names = [c.strip().split(" ")[0] for c in _CHUNK.split(",")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.strip().split(" ")[0], kinds[c.strip().split(" ")[1]]) for c in _CHUNK.split(",")])
    step = len(MAGIC)
    now, rel, nth, held = None, 0, 0, []

    def ended() -> pa.RecordBatch:
        at = {r[3]: k for k, r in enumerate(held)}
        out = [None] * len(held)
        for k in range(len(held) - 1, -1, -1):
            reach = held[k][5]
            if reach is not None:
                out[k] = out[at[reach]] if reach in at and reach > held[k][3] else reach
        cols = list(zip(*[(*r, x) for r, x in zip(held, out)]))
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(cols, names)], schema=schema)

    for b in batches:
        values = b.column(0).cast(pa.large_binary())
        files, blocks = b.column(1).to_pylist(), b.column(2).to_pylist()
        for r in range(b.num_rows):
            if (files[r], blocks[r]) != now:
                if held:
                    yield ended()
                now, rel, nth, held = (files[r], blocks[r]), 0, 0, []
            raw = values[r].as_py()
            found = parse_record(raw)
            if found is None:
                row = (None, False, None, None, None, None, None, None)
            else:
                f, whole = found["fields"], found["reach"] == len(raw)
                row = (rel + found["reach"] + step, whole, _text(f.get(b"warc-type")), _text(f.get(b"warc-record-id")),
                       _text(f.get(b"warc-refers-to")), _text(f.get(b"warc-payload-digest")),
                       len(found["payload"]) if whole else None, _digest(found["payload"]) if whole else None)
            held.append((*now, nth, rel, len(raw), *row))
            rel += len(raw) + step
            nth += 1
    if held:
        yield ended()


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", MAGIC).text(path)
                 .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.file_block_start").alias("block")))


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, off, reach, entry) sorted -> the same with ``record``: on the chain from the entry."""
    now, expected = None, None
    for b in batches:
        files, blocks, offs, reach, entry = (c.to_pylist() for c in b.columns[:5])
        mark = np.zeros(b.num_rows, dtype=bool)
        for r in range(b.num_rows):
            if (files[r], blocks[r]) != now:
                now, expected = (files[r], blocks[r]), entry[r]
            if offs[r] == expected:
                mark[r], expected = True, reach[r]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(mark)], ["file", "off", "record"])


def _whole_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, off, parts of (nth, raw)) -> payload length and digest of the record put together."""
    for b in batches:
        size, digest = [], []
        for parts in b.column(2).to_pylist():
            raw = MAGIC.encode().join(p["value"] for p in sorted(parts, key=lambda p: p["at"]))
            found = parse_record(raw)
            payload = found["payload"] if found and found["reach"] <= len(raw) else b""
            size.append(len(payload))
            digest.append(_digest(payload))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.string())],
                                         ["file", "off", "joined_bytes", "joined_digest"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records under ``path``: ``file, offset, kind, record_id, refers, stated`` (the
    header's digest), ``payload_bytes, payload_digest`` (of the stored payload).

    Files may be split anywhere. A file that does not start with a record has
    none; a chain ends where a record's successor is not a candidate. Candidates
    go to tasks by split; a record is put together in one task.
    """
    def written(df: DataFrame, name: str) -> DataFrame:
        where = scratch_path(spark, name)
        df.write.parquet(where)
        return spark.read.parquet(where)

    # offsets of this table count from each split's first candidate
    found = written(_raw(spark, path).mapInArrow(_candidate_batches, _CHUNK), "candidates")
    sizes = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "block", (F.coalesce(F.sum("bytes").over(before), F.lit(0)) - len(MAGIC)).alias("base"))
    # the line before the first magic is no candidate; at offset 0 it is empty
    cand = (found.join(base, ["file", "block"]).select("file", "block", "nth", "whole", "kind", "record_id", "refers", "stated",
                                                       "payload_bytes", "payload_digest",
                                                       (F.col("base") + F.col("rel")).alias("off"),
                                                       (F.col("base") + F.col("reach")).alias("reach"),
                                                       (F.col("base") + F.col("exit")).alias("exit"))
                 .where(F.col("off") >= 0))
    cand = written(cand, "chain")

    # pointer jumping over the candidates that a chain from another split can enter, and the files' starts
    entered = cand.select("file", F.col("exit").alias("off")).where("off is not null").unionByName(
        cand.select("file", F.lit(0).cast("bigint").alias("off"))).distinct()
    jumps = written(cand.select("file", "off", "exit").join(entered, ["file", "off"]), "jumps")
    reached = jumps.where("off = 0").select("file", "off")
    many = reached.count()
    while many:
        next_ = reached.join(jumps, ["file", "off"]).where("exit is not null").select("file", F.col("exit").alias("off"))
        reached = written(reached.unionByName(next_).distinct().join(jumps.select("file", "off"), ["file", "off"]), "reached")
        now = reached.count()
        if now == many:
            break
        many = now
        ahead = jumps.select("file", F.col("off").alias("exit"), F.col("exit").alias("beyond"))
        jumps = written(jumps.join(ahead, ["file", "exit"], "left").select("file", "off", F.coalesce("beyond", "exit").alias("exit")), "jumps")

    entries = cand.select("file", "block", "off").join(reached, ["file", "off"]).groupBy("file", "block").agg(F.min("off").alias("entry"))
    marks = (cand.select("file", "block", "off", "reach").join(entries, ["file", "block"], "left")
                 .select("file", "block", "off", "reach", "entry")
                 .repartition("file", "block").sortWithinPartitions("file", "block", "off")
                 .mapInArrow(_chain_batches, "file string, off bigint, record boolean"))
    marked = written(cand.join(marks, ["file", "off"]), "marked")
    records = marked.where("record")

    # payloads that hold the magic: the candidates up to the successor belong to the record
    broken = marked.where("not record or not coalesce(whole, false)").select("file", "block", "nth", "off", "record", "reach")
    last = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    owned = (broken.withColumn("owner", F.last(F.when(F.col("record"), F.col("off")), ignorenulls=True).over(last))
                   .withColumn("until", F.last(F.when(F.col("record"), F.col("reach")), ignorenulls=True).over(last))
                   .where(F.col("owner").isNotNull() & (F.col("off") < F.col("until")))
                   .select("file", "block", "nth", "owner", "off"))
    parts = _beside(_numbered(spark, path), owned, ["file", "block", "nth"], "inner")
    joined = (parts.groupBy("file", "owner").agg(F.collect_list(F.struct(F.col("off").alias("at"), "value")).alias("parts"))
                   .select("file", F.col("owner").alias("off"), "parts")
                   .mapInArrow(_whole_batches, "file string, off bigint, joined_bytes bigint, joined_digest string"))
    return (records.join(joined, ["file", "off"], "left")
                   .select("file", F.col("off").alias("offset"), "kind", "record_id", "refers", "stated",
                           F.coalesce("payload_bytes", "joined_bytes").alias("payload_bytes"),
                           F.coalesce("payload_digest", "joined_digest").alias("payload_digest")))


def _numbered_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, nth = None, 0
    for b in batches:
        files, blocks = b.column(1).to_pylist(), b.column(2).to_pylist()
        place = []
        for key in zip(files, blocks):
            if key != now:
                now, nth = key, 0
            place.append(nth)
            nth += 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], ["value", "file", "block", "nth"])


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return _raw(spark, path).mapInArrow(_numbered_batches, "value binary, file string, block bigint, nth bigint")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back; revisits take the payload of the record
    they refer to: of the responses of that page the one with the digest that the revisit states."""
    from ..session import read_table
    path = scratch_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    rows = read_warc(spark, path).select(
        F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)").alias("page_id"),
        "payload_bytes", "payload_digest", F.regexp_replace("stated", "^sha1:", "").alias("stated"), F.col("kind").alias("record_type"),
        F.when(page("refers") != "", page("refers").cast("bigint")).alias("refers_to"))
    whole = (rows.where("record_type = 'response' and page_id is not null")
                 .groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated"))
                 .agg(F.min("payload_bytes").alias("full_bytes")))
    own = rows.where("refers_to is null")
    visits = rows.where("refers_to is not null").join(whole, ["refers_to", "stated"])
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(*cols).unionByName(visits.select("page_id", F.col("full_bytes").alias("payload_bytes"),
                                                       F.col("stated").alias("payload_digest"), "record_type", "refers_to"))
