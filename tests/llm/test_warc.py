import base64
import hashlib

import pytest

from trafficbrick.llm.warc import MAGIC, op10_warc, read_warc, write_warc

SCHEMA = "key string, page_id long, url string, html string, first int"


def b32(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def want(rows, least=0):
    first = {}
    for k, t in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    out = []
    for k, t in rows:
        f = first.get(t or "")
        visit = len((t or "").encode()) >= least and f is not None and f != k
        out.append((k, len((t or "").encode()), b32(t), "revisit" if visit else "response", f if visit else None))
    return sorted(out, key=str)


def nasty():
    inner = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    return [(1, "a" * 50), (2, "é日本"), (3, "a" * 50), (4, None), (5, ""), (6, f"x{MAGIC}y"), (7, inner), (8, inner * 3 + "tail"),
            (9, MAGIC), (10, f"{MAGIC}{MAGIC}\r\n\r\n"), (11, "\r\n\r\n"), (12, f"x{MAGIC}y"), (13, "big " * 20_000),
            (14, f"{'z' * 3000}{inner}{'z' * 3000}"), (15, inner[:-1])] + [(100 + i, f"page {i} " * (i % 40)) for i in range(200)]


@pytest.mark.parametrize("split", ["64m", "2000", "700"])
def test_round_trip_whatever_the_splits(spark, tmp_path, split):
    rows = nasty()
    path = str(tmp_path / "w")
    pages = spark.createDataFrame([("k", k, f"http://x/{k}\r\nWARC-Type: no", t, 1) for k, t in rows], SCHEMA).coalesce(2)
    write_warc(pages, path, records_per_file=80)
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if split == "64m" else split)
        got = read_warc(spark, path).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    num = lambda s: None if not s else int(s[10:-1])
    body = {k: t or "" for k, t in rows}
    for r in got:
        shown = "" if r.kind == "revisit" else body[num(r.record_id)]
        assert (r.payload_bytes, r.payload_digest) == (len(shown.encode()), b32(shown))
        assert r.stated == "sha1:" + b32(body[num(r.record_id)])
    have = [(num(r.record_id), len(body[num(r.record_id)].encode()), b32(body[num(r.record_id)]), r.kind, num(r.refers)) for r in got]
    assert sorted(have, key=str) == want(rows)


def test_small_payloads_nulls_and_empty_table(spark, tmp_path):
    rows = [("k", 2, None, "aa", 1), ("k", 3, None, "aa", 1), ("k", 5, "u", "bbbb", 1), ("k", 4, "u", "bbbb", 1),
            ("k", None, "u", "bbbb", 1), ("k", 4, "u", "bbbb", 1)]
    write_warc(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"), min_bytes=3)
    got = sorted((r.record_id, r.kind, r.refers or "") for r in read_warc(spark, str(tmp_path / "a")).collect())
    p = "<urn:page:{}>".format
    assert got == sorted([(p(2), "response", ""), (p(3), "response", ""), (p(5), "revisit", p(4)), (p(4), "response", ""),
                          (p(4), "response", ""), (p("null"), "revisit", p(4))])
    write_warc(spark.createDataFrame([], SCHEMA), str(tmp_path / "b"))
    assert read_warc(spark, str(tmp_path / "b")).count() == 0


def test_query_on_the_table(spark, sf_small):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()]
    assert sorted(map(tuple, op10_warc(spark, sf_small).collect()), key=str) == want(pages)


from trafficbrick.llm.warc import op10_warc as warc_query  # noqa: E402


def test_several_payloads_of_one_page(spark, tmp_path):
    """A revisit reports the payload it repeats, also where the page it refers to has others."""
    import base64
    import hashlib
    html = [(1, "A" * 10), (1, "BB"), (5, "BB"), (6, "A" * 10), (6, "BB"), (7, None), (1, ""), (8, "C"), (8, "C")]
    rows = [(k, "u", h) for k, h in html]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    first = {}
    for k, h in html:
        first[h or ""] = min(first.get(h or "", k), k)
    want = []
    for k, h in html:
        h = h or ""
        again = k != first[h]
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        want.append((k, len(h), digest, "revisit" if again else "response", first[h] if again else None))
    got = [tuple(r) for r in warc_query(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
