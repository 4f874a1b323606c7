"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark code: the same rules, spelled in SQL over
the raw test tables. ``sum`` results are cast to BIGINT (DuckDB widens them).
"""

from __future__ import annotations

RESERVED = 1
DAYS = 30


def h17(x: str) -> str:
    """Portable 17-bit hash of the BIGINT expression ``x``."""
    lo = f"(({x}) & 65535)"
    hi = f"(({x}) >> 16)"
    mx = f"(({lo} + {hi}) & 131071)"

    def r(v, a, b, c):
        return f"((((({v} * {a}) + {b}) % 2147483647) * {v} + {c}) % 131071)"
    return f"xor(xor({r(lo, 48271, 11, 101)}, {r(hi, 69621, 13, 103)}), {r(mx, 39373, 17, 107)})"


def hbin(x: str, reserved) -> str:
    return f"CAST(({reserved}) + {h17(x)} % (128 - ({reserved})) AS INTEGER)"


def ip_text(x: str) -> str:
    return (f"concat_ws('.', CAST((({x}) >> 24) & 255 AS VARCHAR), CAST((({x}) >> 16) & 255 AS VARCHAR), "
            f"CAST((({x}) >> 8) & 255 AS VARCHAR), CAST(({x}) & 255 AS VARCHAR))")


PACKETS = """packets AS (
  SELECT l_shipdate + to_seconds(CAST((l_orderkey*8 + l_linenumber) % 86400 AS BIGINT)) AS ts,
         'eth0' AS device,
         l_orderkey*8 + l_linenumber AS seq,
         2048 AS eth_type, 0 AS vlan_id,
         CASE WHEN l_linenumber % 4 = 0 THEN 17 ELSE 6 END AS ip_proto,
         ((l_suppkey + 1) * 2654435761) % 4294967296 AS src_ip,
         ((l_partkey % 37 + 1) * 2246822519) % 4294967296 AS dst_ip,
         CAST(1024 + l_orderkey % 64512 AS INTEGER) AS sport,
         CAST(CASE l_linenumber % 4 WHEN 0 THEN 53 WHEN 1 THEN 80 WHEN 2 THEN 443 ELSE 22 END AS INTEGER) AS dport,
         CAST(64 + CAST(l_quantity AS BIGINT) * 29 AS INTEGER) AS wire_len
  FROM lineitem)"""

STRATA = """strata_lines AS (
  SELECT s_suppkey AS line_no, ((s_suppkey + 1) * 2654435761) % 4294967296 AS ip, CAST(s_suppkey % 7 AS INTEGER) AS bin
  FROM supplier
  UNION ALL
  SELECT s_suppkey + 1000000000000, ((s_suppkey + 1) * 2654435761) % 4294967296, CAST((s_suppkey + 1) % 7 AS INTEGER)
  FROM supplier WHERE s_suppkey % 10 = 0),
strata AS (SELECT CAST(ip >> 15 AS INTEGER) AS prefix17, arg_max(bin, line_no) AS bin FROM strata_lines GROUP BY 1),
strata_reserved AS (SELECT coalesce(max(bin), 0) + 1 AS r FROM strata_lines)"""


def windowed(src: str = "packets", every: str = f"{DAYS} days", weight: str = "wire_len") -> str:
    return f"""wpackets AS (
  SELECT *, time_bucket(INTERVAL '{every}', ts, TIMESTAMP '1970-01-01') AS window_start,
         time_bucket(INTERVAL '{every}', ts, TIMESTAMP '1970-01-01') + INTERVAL '{every}' AS window_end,
         CAST({weight} AS BIGINT) AS w
  FROM {src} WHERE eth_type = 2048)"""


BINNED = f"""binned AS (
  SELECT *, src_bin * 128 + dst_bin AS cell, CAST({h17('src_ip')} >> 9 AS INTEGER) AS sub FROM (
    SELECT *, {hbin('src_ip', RESERVED)} AS src_bin, {hbin('dst_ip', RESERVED)} AS dst_bin FROM wpackets))"""

BINNED_STRATA = f"""binned AS (
  SELECT *, src_bin * 128 + dst_bin AS cell, CAST({h17('src_ip')} >> 9 AS INTEGER) AS sub FROM (
    SELECT wp.*,
           coalesce(ss.bin, {hbin('wp.src_ip', '(SELECT r FROM strata_reserved)')}) AS src_bin,
           coalesce(sd.bin, {hbin('wp.dst_ip', '(SELECT r FROM strata_reserved)')}) AS dst_bin
    FROM wpackets wp
    LEFT JOIN strata ss ON CAST(wp.src_ip >> 15 AS INTEGER) = ss.prefix17
    LEFT JOIN strata sd ON CAST(wp.dst_ip >> 15 AS INTEGER) = sd.prefix17))"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


BASE = with_(PACKETS, windowed(), BINNED)
BASE_STRATA = with_(PACKETS, STRATA, windowed(), BINNED_STRATA)

# exact heaviest flow per cell (ties: smaller src, then dst); ports of the flow's first packet
FLOWS = """flows AS (
  SELECT window_start, window_end, cell, src_ip, dst_ip, CAST(sum(w) AS BIGINT) AS flow_bytes,
         arg_min(sport, (ts, seq, w, sport, dport)) AS sport, arg_min(dport, (ts, seq, w, sport, dport)) AS dport
  FROM binned WHERE src_ip <> 0 GROUP BY ALL),
cells AS (SELECT window_start, window_end, cell, CAST(sum(w) AS BIGINT) AS cell_bytes FROM binned GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY window_start, cell ORDER BY flow_bytes DESC, src_ip, dst_ip) AS rn
  FROM flows)"""

# sequential weighted vote, one recursion step per packet of a cell
VOTE = """ordered AS (
  SELECT window_start, window_end, cell, src_ip, dst_ip, sport, dport, w,
         row_number() OVER (PARTITION BY window_start, cell ORDER BY ts, seq, src_ip, dst_ip, w, sport, dport) AS rn
  FROM binned),
vote(window_start, window_end, cell, rn, src_ip, dst_ip, sport, dport, cnt) AS (
  SELECT window_start, window_end, cell, rn, src_ip, dst_ip, sport, dport, w FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.window_start, o.window_end, o.cell, o.rn,
         CASE WHEN v.src_ip = 0 OR NOT (v.src_ip = o.src_ip AND v.dst_ip = o.dst_ip) AND v.cnt - o.w < 0
              THEN o.src_ip ELSE v.src_ip END,
         CASE WHEN v.src_ip = 0 OR NOT (v.src_ip = o.src_ip AND v.dst_ip = o.dst_ip) AND v.cnt - o.w < 0
              THEN o.dst_ip ELSE v.dst_ip END,
         CASE WHEN v.src_ip = 0 OR NOT (v.src_ip = o.src_ip AND v.dst_ip = o.dst_ip) AND v.cnt - o.w < 0
              THEN o.sport ELSE v.sport END,
         CASE WHEN v.src_ip = 0 OR NOT (v.src_ip = o.src_ip AND v.dst_ip = o.dst_ip) AND v.cnt - o.w < 0
              THEN o.dport ELSE v.dport END,
         CASE WHEN v.src_ip = 0 THEN o.w
              WHEN v.src_ip = o.src_ip AND v.dst_ip = o.dst_ip THEN v.cnt + o.w
              WHEN v.cnt - o.w < 0 THEN o.w - v.cnt
              ELSE v.cnt - o.w END
  FROM vote v JOIN ordered o ON o.window_start = v.window_start AND o.cell = v.cell AND o.rn = v.rn + 1),
last_rn AS (SELECT window_start, cell, max(rn) AS rn FROM ordered GROUP BY ALL),
voted AS (
  SELECT v.window_start, v.window_end, v.cell, v.src_ip, v.dst_ip, v.sport, v.dport, v.cnt AS count
  FROM vote v JOIN last_rn l ON v.window_start = l.window_start AND v.cell = l.cell AND v.rn = l.rn
  WHERE v.src_ip <> 0)"""

# cells rolled up from flows with the shipped summary plan's columns
SUMMARY_CELLS = """sflows AS (
  SELECT window_start, window_end, cell, sub, src_ip, dst_ip, CAST(sum(w) AS BIGINT) AS flow_bytes,
         arg_min(sport, (ts, seq, w, sport, dport)) AS sport, arg_min(dport, (ts, seq, w, sport, dport)) AS dport
  FROM binned GROUP BY ALL),
ssub AS (SELECT window_start, window_end, cell, sub, sum(flow_bytes) AS sub_bytes FROM sflows GROUP BY ALL),
sbest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY window_start, cell ORDER BY flow_bytes DESC, src_ip, dst_ip) AS rn
    FROM sflows WHERE src_ip <> 0) WHERE rn = 1),
scells AS (
  SELECT s.window_start, s.window_end, s.cell, CAST(s.cell // 128 AS INTEGER) AS src_bin,
         CAST(s.cell % 128 AS INTEGER) AS dst_bin, CAST(sum(s.sub_bytes) AS BIGINT) AS bytes,
         CAST(max(s.sub_bytes) AS BIGINT) AS est
  FROM ssub s GROUP BY ALL),
summary_cells AS (
  SELECT c.*, coalesce(b.src_ip, 0) AS src_ip, coalesce(b.dst_ip, 0) AS dst_ip,
         coalesce(b.sport, 0) AS sport, coalesce(b.dport, 0) AS dport
  FROM scells c LEFT JOIN sbest b ON c.window_start = b.window_start AND c.cell = b.cell),
top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY est DESC, src_ip, dst_ip) AS rank
    FROM summary_cells WHERE src_ip <> 0) WHERE rank <= 20)"""


def _label(s, sp, d, dp):
    return f"CASE WHEN {s} = 0 THEN '' ELSE '[' || {ip_text(s)} || ':' || CAST({sp} AS VARCHAR) || ', ' || {ip_text(d)} || ':' || CAST({dp} AS VARCHAR) || ']' END"


SQL = {
    "brick": BASE + """
SELECT window_start, window_end, src_bin, dst_bin, src_bin * 128 + dst_bin AS cell, CAST(sum(w) AS BIGINT) AS bytes
FROM binned GROUP BY ALL""",
    "sub_buckets": BASE + """
SELECT window_start, window_end, cell, sub, CAST(sum(w) AS BIGINT) AS bytes FROM binned GROUP BY ALL""",
    "cell_estimate": BASE + """
SELECT window_start, window_end, cell, CAST(max(b) AS BIGINT) AS est, CAST(sum(b) AS BIGINT) AS cell_bytes
FROM (SELECT window_start, window_end, cell, sub, sum(w) AS b FROM binned GROUP BY ALL) GROUP BY ALL""",
    "dominant_flow": with_(PACKETS, windowed(), BINNED, FLOWS) + """
SELECT r.window_start, r.window_end, r.cell, r.src_ip, r.dst_ip, r.sport, r.dport, r.flow_bytes, c.cell_bytes
FROM ranked r JOIN (SELECT window_start, cell, CAST(sum(w) AS BIGINT) AS cell_bytes FROM binned WHERE src_ip <> 0 GROUP BY ALL) c
  ON r.window_start = c.window_start AND r.cell = c.cell
WHERE r.rn = 1""",
    "vote_hitters": with_(PACKETS, windowed(), BINNED, VOTE) + "SELECT * FROM voted",
    "vote_hitters_strata": with_(PACKETS, STRATA, windowed(), BINNED_STRATA, VOTE) + "SELECT * FROM voted",
    "vote_hitters_packets": with_(PACKETS, windowed(weight="1"), BINNED, VOTE) + "SELECT * FROM voted",
    "vote_merged_majority": with_(PACKETS, windowed(), BINNED, FLOWS) + """
SELECT r.window_start, r.window_end, r.cell, r.src_ip, r.dst_ip
FROM ranked r JOIN cells c ON r.window_start = c.window_start AND r.cell = c.cell
WHERE r.rn = 1 AND r.flow_bytes * 2 > c.cell_bytes""",
    "majority_fraction": with_(PACKETS, windowed(), BINNED, VOTE, FLOWS) + """
SELECT v.window_start, v.window_end, count(*) AS active_cells,
       CAST(sum(CASE WHEN coalesce(f.flow_bytes, 0) * 2 > c.cell_bytes THEN 1 ELSE 0 END) AS BIGINT) AS majority_cells,
       sum(CASE WHEN coalesce(f.flow_bytes, 0) * 2 > c.cell_bytes THEN 1 ELSE 0 END) / count(*) AS majority_fraction
FROM voted v
LEFT JOIN flows f ON v.window_start = f.window_start AND v.cell = f.cell AND v.src_ip = f.src_ip AND v.dst_ip = f.dst_ip
LEFT JOIN cells c ON v.window_start = c.window_start AND v.cell = c.cell
GROUP BY ALL""",
    "active_cells": with_(PACKETS, windowed(), BINNED, VOTE) + """
SELECT window_start, window_end, count(*) AS active_cells FROM voted GROUP BY ALL""",
    "top_hitters": with_(PACKETS, windowed(), BINNED, SUMMARY_CELLS) + """
SELECT window_start, window_end, rank, cell, src_ip, dst_ip, sport, dport, est FROM top""",
    "hitter_report": with_(PACKETS, STRATA, windowed(), BINNED_STRATA, SUMMARY_CELLS) + f"""
SELECT window_start, window_end, rank,
       'Hitter Flow #' || CAST(rank AS VARCHAR) || ': [' || {ip_text('src_ip')} || '] -> [' || {ip_text('dst_ip')}
       || ']: ' || format('{{:,}}', est) || ' bytes.' AS line
FROM top""",
    "summary_cells": with_(PACKETS, STRATA, windowed(), BINNED_STRATA, SUMMARY_CELLS) + """
SELECT window_start, window_end, cell, src_bin, dst_bin, bytes, est, src_ip, dst_ip, sport, dport FROM summary_cells""",
    "dense_brick": with_(PACKETS, STRATA, windowed(), BINNED_STRATA, SUMMARY_CELLS) + f"""
, grid AS (SELECT w.window_start, w.window_end, g.cell
           FROM (SELECT DISTINCT window_start, window_end FROM summary_cells) w,
                (SELECT CAST(range AS INTEGER) AS cell FROM range(16384)) g)
SELECT g.window_end AS ts,
       list(coalesce(c.bytes, 0) ORDER BY g.cell) AS data,
       list(coalesce({_label('c.src_ip', 'c.sport', 'c.dst_ip', 'c.dport')}, '') ORDER BY g.cell) AS hitters
FROM grid g LEFT JOIN summary_cells c ON g.window_start = c.window_start AND g.cell = c.cell
GROUP BY g.window_start, g.window_end""",
    "hash17": with_(PACKETS) + f"""
SELECT seq, src_ip, {h17('src_ip')} AS src_hash, {h17('dst_ip')} AS dst_hash FROM packets""",
    "hash_bin": with_(PACKETS) + f"""
SELECT seq, src_ip, dst_ip, {hbin('src_ip', 1)} AS src_bin, {hbin('dst_ip', 7)} AS dst_bin7 FROM packets""",
    "cell": BASE + "SELECT seq, src_ip, dst_ip, src_bin, dst_bin, cell FROM binned",
    "sub_bucket": with_(PACKETS) + f"SELECT seq, src_ip, CAST({h17('src_ip')} >> 9 AS INTEGER) AS sub FROM packets",
    "strata_last_wins": with_(STRATA) + "SELECT prefix17, bin FROM strata",
    "reserved_bins": with_(STRATA) + "SELECT r AS reserved FROM strata_reserved",
    "assign_bin": BASE_STRATA + "SELECT seq, src_ip, dst_ip, src_bin, dst_bin, cell, sub FROM binned",
    "brick_strata": BASE_STRATA + """
SELECT window_start, window_end, src_bin, dst_bin, src_bin * 128 + dst_bin AS cell, CAST(sum(w) AS BIGINT) AS bytes
FROM binned GROUP BY ALL""",
    "ip_text": with_(PACKETS) + f"""
SELECT seq, src_ip, {ip_text('src_ip')} AS src_text, {ip_text('dst_ip')} AS dst_text, dst_ip AS dst_back FROM packets""",
    "flow_label": with_(PACKETS) + f"""
SELECT seq, {_label('src_ip', 'sport', 'dst_ip', 'dport')} AS label FROM packets""",
    "octets": with_(PACKETS) + """
SELECT seq, src_ip, CAST((src_ip >> 24) & 255 AS INTEGER) AS o1, CAST((src_ip >> 16) & 255 AS INTEGER) AS o2,
       CAST((src_ip >> 8) & 255 AS INTEGER) AS o3, CAST(src_ip & 255 AS INTEGER) AS o4 FROM packets""",
    "low_high16": with_(PACKETS) + """
SELECT seq, dst_ip, CAST(dst_ip & 65535 AS INTEGER) AS lo16, CAST(dst_ip >> 16 AS INTEGER) AS hi16 FROM packets""",
    "prefix17": with_(PACKETS) + """
SELECT seq, src_ip, CAST(src_ip >> 15 AS INTEGER) AS src_prefix17, CAST(dst_ip >> 15 AS INTEGER) AS dst_prefix17
FROM packets""",
    "delta_ms": """
SELECT event_id, date_diff('microsecond', date_trunc('day', ts), ts) / 1000.0 AS ms FROM events""",
    "duration_text": """
SELECT event_id, ms, format('{}:{:02d}:{:02d}:{:02d}:{:03d}', ms // 86400000, (ms // 3600000) % 24,
       (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS text
FROM (SELECT event_id, date_diff('millisecond', TIMESTAMP '2023-12-25 00:00:00', ts) AS ms FROM events)""",
    "format_count": BASE + """
SELECT window_start, window_end, src_bin * 128 + dst_bin AS cell, format('{:,}', CAST(sum(w) AS BIGINT)) AS bytes_text
FROM binned GROUP BY ALL""",
}


EVENT_PACKETS = """epackets AS (
  SELECT ts, 'eth1' AS device, event_id AS seq,
         CASE WHEN event_type = 'error' THEN 34525 ELSE 2048 END AS eth_type,
         CAST((user_id % 3) * 100 AS INTEGER) AS vlan_id,
         CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 17 ELSE 6 END AS ip_proto,
         ((user_id + 1) * 2654435761) % 4294967296 AS src_ip,
         ((event_id % 11 + 1) * 2246822519) % 4294967296 AS dst_ip,
         CAST(CASE WHEN event_type <> 'view' THEN 1024 + event_id % 64512 ELSE 0 END AS INTEGER) AS sport,
         CAST(CASE WHEN event_type <> 'view' THEN 443 ELSE 0 END AS INTEGER) AS dport,
         CAST(64 + CAST(floor(value) AS INTEGER) * 3 AS INTEGER) AS wire_len
  FROM events),
allpackets AS (
  SELECT ts, device, seq, eth_type, vlan_id, ip_proto, src_ip, dst_ip, sport, dport, wire_len FROM packets
  UNION ALL SELECT * FROM epackets)"""


def _hx(x, n):
    return f"lpad(hex({x}), {2 * n}, '0')"


FRAMEHEX = ("'0200' || " + _hx("dst_ip", 4) + " || '0200' || " + _hx("src_ip", 4)
            + " || CASE WHEN vlan_id <> 0 THEN '8100' || " + _hx("vlan_id", 2) + " ELSE '' END || "
            + _hx("eth_type", 2) + " || '4500' || " + _hx("greatest(wire_len - 14, 40)", 2)
            + " || '0001000040' || " + _hx("ip_proto", 1) + " || '0000' || " + _hx("src_ip", 4) + " || "
            + _hx("dst_ip", 4) + " || CASE WHEN ip_proto IN (6, 17) THEN " + _hx("sport", 2) + " || "
            + _hx("dport", 2) + " ELSE '' END")

ALL = with_(PACKETS, EVENT_PACKETS)
FRAMES = with_(PACKETS, EVENT_PACKETS, f"frames AS (SELECT *, {FRAMEHEX} AS fhex FROM allpackets)")

TOTALS = """totals AS (
  SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start,
         time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 day' AS window_end,
         device, count(*) AS packets, CAST(sum(wire_len + 24) AS BIGINT) AS line_bytes
  FROM allpackets GROUP BY ALL),
cumulative AS (
  SELECT device, window_end,
         CAST(sum(packets) OVER (PARTITION BY device ORDER BY window_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS packets,
         CAST(sum(line_bytes) OVER (PARTITION BY device ORDER BY window_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS bytes,
         date_diff('microsecond', min(window_start) OVER (PARTITION BY device), window_end) / 1000.0 AS ms
  FROM totals)"""

CAPTURE = """hourly AS (
  SELECT date_trunc('hour', ts) AS ts, event_type AS device, count(*) AS recv_h,
         count(*) FILTER (WHERE user_id % 7 = 0) AS drop_h
  FROM events GROUP BY ALL),
stats AS (
  SELECT ts, device,
         CAST(sum(recv_h) OVER (PARTITION BY device ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS recv,
         CAST(sum(drop_h) OVER (PARTITION BY device ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS "drop"
  FROM hourly)"""

DOCS = f"""grid AS (SELECT w.window_start, w.window_end, g.cell
           FROM (SELECT DISTINCT window_start, window_end FROM summary_cells) w,
                (SELECT CAST(range AS INTEGER) AS cell FROM range(16384)) g),
docs AS (
  SELECT g.window_end AS ts,
         list(coalesce(c.bytes, 0) ORDER BY g.cell) AS data,
         list(coalesce({_label('c.src_ip', 'c.sport', 'c.dst_ip', 'c.dport')}, '') ORDER BY g.cell) AS hitters
  FROM grid g LEFT JOIN summary_cells c ON g.window_start = c.window_start AND g.cell = c.cell
  GROUP BY g.window_start, g.window_end),
latest AS (SELECT * FROM docs ORDER BY ts DESC LIMIT 1),
sized AS (SELECT *, CAST(len(data) * 8 + list_sum(list_transform(hitters, lambda h: length(h))) AS BIGINT) AS size_bytes FROM docs)"""

DOC_BASE = with_(PACKETS, STRATA, windowed(), BINNED_STRATA, SUMMARY_CELLS, DOCS)


def _cells_of(src):
    return f"""(SELECT d.ts, d.data[r.i + 1] AS traffic, CAST(r.i // 128 AS INTEGER) AS x, CAST(r.i % 128 AS INTEGER) AS y,
        d.hitters[r.i + 1] AS hitters FROM {src} d, (SELECT range AS i FROM range(16384)) r)"""


_CAT = "CASE WHEN traffic < 1000000 / 2 THEN '1' WHEN traffic < 1000000 THEN '5' ELSE '10' END"
_COLOR = "CASE WHEN traffic < 1000000 / 2 THEN '#3a9244' WHEN traffic < 1000000 THEN '#f9cc10' ELSE '#b2282f' END"
_HLABEL = "CASE WHEN hitters = '' THEN 'No Top Hitters' ELSE hitters END"

SQL.update({
    "union_devices": ALL + "SELECT * FROM allpackets",
    "decode_frames": ALL + """
SELECT ts, device, seq, eth_type, vlan_id,
       CASE WHEN eth_type = 2048 THEN ip_proto END AS ip_proto,
       CASE WHEN eth_type = 2048 THEN src_ip END AS src_ip,
       CASE WHEN eth_type = 2048 THEN dst_ip END AS dst_ip,
       CASE WHEN eth_type = 2048 AND ip_proto IN (6, 17) THEN sport ELSE 0 END AS sport,
       CASE WHEN eth_type = 2048 AND ip_proto IN (6, 17) THEN dport ELSE 0 END AS dport,
       wire_len
FROM allpackets""",
    "packet_weight": ALL + "SELECT device, seq, CAST(wire_len AS BIGINT) AS w_bytes, CAST(1 AS BIGINT) AS w_packets FROM allpackets",
    "line_bytes": ALL + "SELECT device, seq, wire_len, CAST(wire_len + 24 AS BIGINT) AS line_bytes FROM allpackets",
    "filter_packets": ALL + """
SELECT device, seq, src_ip, dst_ip, wire_len FROM allpackets WHERE dport = 443 AND wire_len > 1000 AND eth_type = 2048""",
    "first_seen": ALL + "SELECT device, min(ts) AS first_ts, count(*) AS frames FROM allpackets GROUP BY ALL",
    "truncate_frames": FRAMES + """
SELECT device, seq, CAST(least(length(fhex) // 2, 40) AS INTEGER) AS cap_len, wire_len, substr(fhex, 1, 80) AS frame_hex
FROM frames""",
    "mac_text": ALL + """
SELECT device, seq,
       '02:00:' || regexp_replace(lpad(hex(dst_ip), 8, '0'), '(..)(..)(..)(..)', '\\1:\\2:\\3:\\4') AS dst_mac,
       '02:00:' || regexp_replace(lpad(hex(src_ip), 8, '0'), '(..)(..)(..)(..)', '\\1:\\2:\\3:\\4') AS src_mac
FROM allpackets""",
    "traffic_totals": with_(PACKETS, EVENT_PACKETS, TOTALS) + "SELECT * FROM totals",
    "capture_totals": with_(CAPTURE) + """
SELECT ts, CAST(sum(recv) AS BIGINT) AS recv, CAST(sum("drop") AS BIGINT) AS "drop",
       CAST(sum(recv) + sum("drop") AS BIGINT) AS total,
       CASE WHEN sum(recv) = 0 THEN 0.0
            ELSE CAST(sum("drop") AS DOUBLE) * 100.0 / CAST(sum(recv) + sum("drop") AS DOUBLE) END AS drop_pct
FROM stats GROUP BY ts""",
    "cumulative_rates": with_(PACKETS, EVENT_PACKETS, TOTALS) + """
SELECT device, window_end, packets, bytes, ms,
       CAST(packets AS DOUBLE) * 1000.0 / ms AS pps, CAST(bytes AS DOUBLE) * 8.0 / (ms * 1000.0) AS mbps
FROM cumulative""",
    "interval_rates": with_(PACKETS, EVENT_PACKETS, TOTALS) + """
SELECT device, window_end, packets, bytes, ms,
       CAST(packets AS DOUBLE) / (ms / 1000.0) AS pps,
       CAST(bytes AS DOUBLE) * 8.0 / 1e9 / (ms / 1000.0) AS gbps,
       floor(bytes / 125000000) / (ms / 1000.0) AS gbps_trunc
FROM (
  SELECT device, window_end, packets - lag(packets) OVER w AS packets, bytes - lag(bytes) OVER w AS bytes,
         date_diff('microsecond', lag(window_end) OVER w, window_end) / 1000.0 AS ms,
         lag(window_end) OVER w AS prev
  FROM cumulative WINDOW w AS (PARTITION BY device ORDER BY window_end))
WHERE prev IS NOT NULL""",
    "stored_bricks": DOC_BASE + "SELECT ts, data, hitters FROM docs",
    "latest_brick": DOC_BASE + "SELECT ts, data, hitters FROM latest",
    "retain_bricks": DOC_BASE + """
SELECT ts, size_bytes, data, hitters FROM (
  SELECT *, sum(size_bytes) OVER (ORDER BY ts DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newer FROM sized)
WHERE newer <= 5000000""",
    "brick_cells": DOC_BASE + "SELECT * FROM " + _cells_of("docs"),
    "categories": DOC_BASE + f"SELECT ts, x, y, traffic, {_CAT} AS category, {_COLOR} AS color FROM " + _cells_of("docs"),
    "hitter_default": DOC_BASE + f"SELECT ts, x, y, {_HLABEL} AS hitters FROM " + _cells_of("docs"),
    "payload": DOC_BASE + f""", vcells AS (SELECT ts, x, y, traffic, {_HLABEL} AS hitters, {_CAT} AS category FROM {_cells_of('docs')})
SELECT ts, to_json({{'x': list(x ORDER BY x, y), 'y': list(y ORDER BY x, y), 'traffic': list(traffic ORDER BY x, y),
                    'hitters': list(hitters ORDER BY x, y), 'category': list(category ORDER BY x, y)}})::VARCHAR AS payload
FROM vcells GROUP BY ts""",
})

SQL["read_captures"] = ALL + """
SELECT ts, eth_type, vlan_id,
       CASE WHEN eth_type = 2048 THEN ip_proto END AS ip_proto,
       CASE WHEN eth_type = 2048 THEN src_ip END AS src_ip,
       CASE WHEN eth_type = 2048 THEN dst_ip END AS dst_ip,
       CASE WHEN eth_type = 2048 AND ip_proto IN (6, 17) THEN sport ELSE 0 END AS sport,
       CASE WHEN eth_type = 2048 AND ip_proto IN (6, 17) THEN dport ELSE 0 END AS dport,
       wire_len
FROM allpackets"""

_PLAIN_CELLS = with_(PACKETS, windowed(), BINNED, SUMMARY_CELLS)
SQL["stream_bricks"] = _PLAIN_CELLS + """
SELECT window_start, window_end, cell, src_bin, dst_bin, bytes, est, src_ip, dst_ip, sport, dport FROM summary_cells"""
SQL["stream_late"] = with_(PACKETS, "ontime AS (SELECT * FROM packets WHERE seq % 8 <> 7)", windowed("ontime"), BINNED,
                          SUMMARY_CELLS) + """
SELECT window_start, window_end, cell, bytes, est FROM summary_cells"""
SQL["stream_vote"] = with_(PACKETS, windowed(), BINNED, VOTE) + "SELECT * FROM voted"
SQL["stream_captures"] = _PLAIN_CELLS + """
SELECT window_start, window_end, cell, src_bin, dst_bin, bytes, est FROM summary_cells"""

# the native pipeline: vote candidates on the cells, ranked by the estimate
_TOP = SUMMARY_CELLS[SUMMARY_CELLS.index("top AS ("):]
VOTE_CELLS = """vsub AS (SELECT window_start, window_end, cell, sub, sum(w) AS sub_bytes FROM binned GROUP BY ALL),
vcell AS (SELECT window_start, window_end, cell, CAST(sum(sub_bytes) AS BIGINT) AS bytes,
                 CAST(max(sub_bytes) AS BIGINT) AS est FROM vsub GROUP BY ALL),
summary_cells AS (
  SELECT c.*, coalesce(v.src_ip, 0) AS src_ip, coalesce(v.dst_ip, 0) AS dst_ip,
         coalesce(v.sport, 0) AS sport, coalesce(v.dport, 0) AS dport
  FROM vcell c LEFT JOIN voted v ON c.window_start = v.window_start AND c.cell = v.cell),
""" + _TOP


def _report(unit: str) -> str:
    return f"""
SELECT window_start, window_end, rank,
       'Hitter Flow #' || CAST(rank AS VARCHAR) || ': [' || {ip_text('src_ip')} || '] -> [' || {ip_text('dst_ip')}
       || ']: ' || format('{{:,}}', est) || ' {unit}.' AS line
FROM top"""


SQL["vote_top_hitters"] = with_(PACKETS, windowed(), BINNED, VOTE, VOTE_CELLS) + """
SELECT window_start, window_end, rank, cell, src_ip, dst_ip, sport, dport, est FROM top"""
SQL["vote_hitter_report"] = with_(PACKETS, STRATA, windowed(), BINNED_STRATA, VOTE, VOTE_CELLS) + _report("bytes")
SQL["vote_packets_report"] = with_(PACKETS, windowed(weight="1"), BINNED, VOTE, VOTE_CELLS) + _report("packets")
SQL["vote_documents"] = with_(PACKETS, STRATA, windowed(), BINNED_STRATA, VOTE, VOTE_CELLS, DOCS) + \
    "SELECT ts, data, hitters FROM docs"

# hourly documents of the second device, silent hours included
_FILLED = DOCS.replace("(SELECT DISTINCT window_start, window_end FROM summary_cells) w", """(
             SELECT t AS window_start, t + INTERVAL '1 hour' AS window_end
             FROM (SELECT unnest(generate_series(min(window_start), max(window_start), INTERVAL '1 hour')) AS t
                   FROM summary_cells)) w""")
SQL["dense_brick_filled"] = with_(PACKETS, EVENT_PACKETS, windowed("epackets", "1 hour"), BINNED, SUMMARY_CELLS, _FILLED) + \
    "SELECT ts, data, hitters FROM docs"

SQL["global_rates"] = with_(PACKETS, EVENT_PACKETS, """gtotals AS (
  SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS packets,
         CAST(sum(wire_len + 24) AS BIGINT) AS line_bytes
  FROM allpackets GROUP BY ALL),
gcum AS (
  SELECT window_start + INTERVAL '1 day' AS window_end,
         CAST(sum(packets) OVER (ORDER BY window_start) AS BIGINT) AS packets,
         CAST(sum(line_bytes) OVER (ORDER BY window_start) AS BIGINT) AS bytes,
         date_diff('microsecond', min(window_start) OVER (), window_start + INTERVAL '1 day') / 1000.0 AS ms
  FROM gtotals)""") + """
SELECT window_end, packets, bytes, ms, CAST(packets AS DOUBLE) * 1000.0 / ms AS pps,
       CAST(bytes AS DOUBLE) * 8.0 / (ms * 1000.0) AS mbps
FROM gcum"""

SQL["dashboard"] = SQL["payload"].replace(_cells_of("docs"), _cells_of("latest"))
SQL["read_strata_file"] = SQL["strata_last_wins"]

SQL["offline_summary"] = _PLAIN_CELLS + """
SELECT window_start, window_end, rank, cell, src_ip, dst_ip, est FROM top"""

# The seeded hash: the C library's additive feedback generator by its published
# recurrence, 31 words a recursion step (r[i] = r[i-31] + r[i-3]), from which the
# tables are drawn in the native order. The first 341 words after the seed words'
# copy are not used (31 words of the state and 310 discarded outputs).
PARITY_SEED = 134
RAND = f"""seeds(i, v) AS (
  SELECT 0, CAST({PARITY_SEED} AS BIGINT) UNION ALL SELECT i + 1, (v * 16807) % 2147483647 FROM seeds WHERE i < 30),
gen(k, s) AS (
  SELECT 0, list_concat((SELECT list(v ORDER BY i) FROM seeds WHERE i >= 3), (SELECT list(v ORDER BY i) FROM seeds WHERE i < 3))
  UNION ALL
  SELECT k + 1, list_transform(range(0, 31), lambda i: CAST((s[29 + i % 3]
           + list_sum(list_transform(range(i % 3, i + 1, 3), lambda j: s[j + 1]))) % 4294967296 AS BIGINT))
  FROM gen WHERE k < 11 + 393216 // 31),
draws AS (SELECT (k - 11) * 31 + p AS n, s[p + 1] >> 1 AS v FROM gen, (SELECT range AS p FROM range(31)) WHERE k >= 11),
t AS (SELECT n % 4 AS c, n // 4 AS i, v % 131071 AS v FROM draws WHERE n < 262144),
binmap AS (
  SELECT n - 262144 AS h, (SELECT r FROM strata_reserved) + v % (128 - (SELECT r FROM strata_reserved)) AS b
  FROM draws WHERE n >= 262144 AND n < 393216),
ips AS (SELECT src_ip AS ip FROM wpackets UNION SELECT dst_ip FROM wpackets),
hashed AS (
  SELECT ip, xor(xor(t1.v, t2.v), t3.v) AS h
  FROM ips JOIN t t1 ON t1.c = 0 AND t1.i = ip & 65535 JOIN t t2 ON t2.c = 1 AND t2.i = ip >> 16
  JOIN t t3 ON t3.c = 2 + (((ip & 65535) + (ip >> 16)) & 131071) // 65536
           AND t3.i = (((ip & 65535) + (ip >> 16)) & 131071) % 65536),
bin_of AS (
  SELECT ip, CAST(coalesce(st.bin, b) AS INTEGER) AS bin
  FROM hashed JOIN binmap USING (h) LEFT JOIN strata st ON CAST(ip >> 15 AS INTEGER) = st.prefix17),
binned AS (
  SELECT wp.*, s.bin AS src_bin, d.bin AS dst_bin FROM wpackets wp JOIN bin_of s ON wp.src_ip = s.ip JOIN bin_of d ON wp.dst_ip = d.ip)"""
SQL["brick_parity"] = with_(PACKETS, STRATA, windowed(), RAND) + """
SELECT window_start, window_end, src_bin, dst_bin, src_bin * 128 + dst_bin AS cell, CAST(sum(w) AS BIGINT) AS bytes
FROM binned GROUP BY ALL"""

# live forms of batch results
SQL["stream_vote_report"] = SQL["vote_hitter_report"]
SQL["stream_dense_filled"] = SQL["dense_brick_filled"]
SQL["stream_interval_rates"] = SQL["interval_rates"]
SQL["stream_global_rates"] = SQL["global_rates"]
SQL["stream_capture_totals"] = SQL["capture_totals"]

SQL["evict_bricks"] = SQL["retain_bricks"]
SQL["read_captures_split"] = SQL["read_captures"]
SQL["capture_report"] = ALL + "SELECT CAST(count(*) AS BIGINT) AS records, CAST(0 AS BIGINT) AS lost_bytes FROM allpackets"
