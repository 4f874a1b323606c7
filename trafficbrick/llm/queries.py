"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .fingerprints import op7_fingerprints
from .jaccard_join import op6_jaccard_join
from .language_id import op12_language_id
from .packing import op9_best_fit_packing
from .periodic_runs import op11_periodic_runs
from .pieces import op4_sentencepiece_nbest
from .quality import op8_quality_rules
from .substring_dedup import op1_substring_dedup
from .token_counts import op3_token_counts
from .topk_search import op5_topk_search
from .toxicity import op2_toxicity
from .warc import op10_warc
from .whitening import op13_whitening

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_sentencepiece_nbest": op4_sentencepiece_nbest,
    "op5_topk_search": op5_topk_search,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality_rules": op8_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_language_id": op12_language_id,
    "op13_whitening": op13_whitening,
}

# DuckDB SQL of the queries that SQL can express
SQL: dict[str, str] = {
    # one row per word of every text; a window is the list of 50 words from a word on
    "op1_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM places),
least AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN least USING (h) WHERE doc_id > first),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)""",
    "op5_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    # base32 from the digest's bits, five at a time
    "op10_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, sha256(coalesce(html, '')) AS k FROM pages),
bits AS (
  SELECT page_id, array_to_string(list_transform(range(1, 41), lambda i:
           lpad(bin(instr('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), '') AS b FROM p),
codes AS (
  SELECT page_id, array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j:
             CAST(substr(b, i * 5 + j + 1, 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS BIGINT), 1)), '') AS payload_digest
  FROM bits),
f AS (SELECT k, min(page_id) AS first FROM p GROUP BY k)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN p.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (k) JOIN codes USING (page_id)""",
}


def _run_grams(sizes: list[int]) -> str:
    """Digests of ``size`` words from each place on, each size by joining two of half of it."""
    out = []
    for half, size in zip(sizes, sizes[1:]):
        out.append(f"g{size} AS (SELECT doc_id, i, n, md5(h || h2) AS h FROM (SELECT doc_id, i, n, h, lead(h, {half}) OVER "
                   f"(PARTITION BY doc_id ORDER BY i) AS h2 FROM g{half}) WHERE h2 IS NOT NULL),")
    return "\n".join(out)


def _run_steps(sizes: list[int]) -> str:
    """Distances of the next equal gram, as long as the gram at most and longer than half of it."""
    return " UNION ".join(f"SELECT doc_id, q FROM (SELECT doc_id, n, lead(i) OVER (PARTITION BY doc_id, h ORDER BY i) - i AS q FROM g{size}) "
                          f"WHERE q <= {size} AND q > {size // 2 if size > 16 else 0} AND 3 * q <= n" for size in sizes)


_SIZES = [16 << k for k in range(12)]      # periods of up to 32,768 words

# the CRC-32 of the id bit by bit (-1: one shift); every period that a run can have is a distance of equal
# grams; its stretches of equal words that far apart are the runs
SQL["op11_periodic_runs"] = rf"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS w,
         list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda k: CAST(-1 AS BIGINT))))),
           lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END, 4294967295) AS crc
  FROM documents),
docs AS (SELECT doc_id, w, len(w) AS n, (xor(crc, 4294967295) // 10) AS g, xor(crc, 4294967295) % 10 = 0 AND len(w) > 0 AS planted FROM split),
shape AS (SELECT *, CASE WHEN planted THEN g % n ELSE n END AS a FROM docs),
shape2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM shape),
texts AS (SELECT doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) AS w FROM shape2),
words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM texts),
g16 AS (SELECT doc_id, i, n, md5(array_to_string(w[i + 1:i + 16], ' ')) AS h
        FROM (SELECT doc_id, n, w, unnest(range(n - 15)) AS i FROM texts WHERE n >= 16)),
{_run_grams(_SIZES)}
steps AS ({_run_steps(_SIZES)}),
equal AS (SELECT s.doc_id, s.q, u.i FROM steps s JOIN words u ON u.doc_id = s.doc_id
          JOIN words v ON v.doc_id = s.doc_id AND v.i = u.i + s.q AND v.x = u.x),
stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM equal)
  GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT doc_id, s AS start, l + q AS length, min(q) AS period FROM stretches GROUP BY doc_id, s, l + q),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS HUGEINT) * 1000000000000 // period DESC, start, period) AS k
                 FROM runs) WHERE k = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t
           FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.i) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i
         WHERE gone.i IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length,
       CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM docs d LEFT JOIN best b USING (doc_id) LEFT JOIN listed l USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
