"""The same rows as queries.py, computed from the tables alone."""

from __future__ import annotations

from glyphlake.operators.rules import NO_CHUNKS, RULES
from glyphlake.sources.carriers import FAULTS
from glyphlake.sources.encode import ADAM7, LEGAL_PAIRS

# Whole documents as gray rows: n bytes, h rows, t filtered bytes; in stored blocks: nb blocks, s stream bytes, c IDAT chunks of 1000.
_DOC = "doc AS (SELECT doc_id AS file_id, coalesce(text, '') AS txt, strlen(coalesce(text, '')) AS n, greatest(1, ceil(strlen(coalesce(text, '')) / 16.0))::BIGINT AS h FROM documents)"
_ITEM = _DOC.replace("documents", "benchmark").replace("doc_id AS", "item_id AS")
_STORED = "st AS (SELECT *, 17 * h AS t, ceil(17 * h / 65535.0)::BIGINT AS nb, 2 + 5 * ceil(17 * h / 65535.0)::BIGINT + 17 * h + 4 AS s FROM doc), sc AS (SELECT *, ceil(s / 1000.0)::BIGINT AS c FROM st)"
_IDATS = "idat AS (SELECT file_id, s, c, unnest(range(0, c)) AS k FROM sc), seg AS (SELECT file_id, k, s, c, 41 + 1012 * k AS physical_offset, least(1000, s - 1000 * k) AS length, 1000 * k AS logical_start FROM idat)"
# Bytes of benchmark texts; as literals of 8 or 9 bits after the filter byte 0.
_HEX = "hx AS (SELECT item_id AS file_id, CASE WHEN strlen(coalesce(text, '')) = 0 THEN '00' ELSE hex(encode(text)) END AS hex FROM benchmark)"
_BYTE = "b AS (SELECT file_id, i, ('0x' || substr(hex, (2 * i + 1)::BIGINT, 2))::INT AS v FROM (SELECT file_id, hex, unnest(range(0, length(hex) // 2)) AS i FROM hx))"
_LITERAL = "lit AS (SELECT file_id, 0 AS idx, 0 AS v FROM hx UNION ALL SELECT file_id, i + 1, v FROM b), tok AS (SELECT file_id, idx, v, CASE WHEN v < 144 THEN 8 ELSE 9 END AS bits, 3 + coalesce(sum(CASE WHEN v < 144 THEN 8 ELSE 9 END) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM lit), fin AS (SELECT file_id, max(idx) + 1 AS n, (max(a + bits))::BIGINT AS a FROM tok GROUP BY 1), stream AS (SELECT file_id, n, a, (6 + (a + 7 + 7) // 8)::BIGINT AS s FROM fin)"
# Padded gray bytes of benchmark texts.
_PIXEL = "hx AS (SELECT file_id, h, rpad(hex(encode(txt)), (32 * h)::INT, '0') AS hex FROM doc), px AS (SELECT file_id, i // 16 AS y, i % 16 AS x, ('0x' || substr(hex, (2 * i + 1)::BIGINT, 2))::INT AS v FROM (SELECT file_id, hex, unnest(range(0, 16 * h)) AS i FROM hx))"
_L = "strlen(c_name)"
_FAULT = f"fault AS (SELECT c_custkey AS file_id, {_L} AS l, (c_custkey % {len(FAULTS)})::INT AS f, 69 + {_L} AS z FROM customer)"
_AT = {f: i for i, f in enumerate(FAULTS)}
# Issues by fault, in order: rule and offset (l: name bytes, z: bytes of a file in order).
_ISSUES = {
    "signature_invalid": [("signature_invalid", "0"), ("idat_required", "z")],
    "signature_truncated": [("signature_truncated", "5"), ("idat_required", "5")],
    "chunk_truncated": [("chunk_truncated", "z - 12"), ("iend_required", "z - 6")],
    "data_after_iend": [("data_after_iend", "z")],
    "ihdr_required": [("ihdr_required", "8")],
    "ihdr_duplicate": [("ihdr_duplicate", "z + 25")],
    "iend_required": [("iend_required", "z - 12")],
    "idat_not_contiguous": [("idat_not_contiguous", "64")],
    "chunk_crc_mismatch": [("chunk_crc_mismatch", "53 + l")],
    "idat_adler_truncated": [("idat_adler_truncated", "41")],
    "ihdr_invalid_length": [("ihdr_invalid_length", "8")],
    "ihdr_zero_dimension": [("ihdr_zero_dimension", "16")],
    "ihdr_bit_depth_color_type": [("ihdr_bit_depth_color_type", "24")],
    "ihdr_compression_method": [("ihdr_compression_method", "26")],
    "ihdr_filter_method": [("ihdr_filter_method", "27")],
    "ihdr_interlace_method": [("ihdr_interlace_method", "28")],
    "image_dimension_limit": [("image_dimension_limit", "8")],
    "decoded_image_budget": [("decoded_image_budget", "8")],
    "decoded_image_overflow": [("decoded_image_budget", "8")],
    "idat_required": [("idat_required", "45")],
    "idat_zlib_header_truncated": [("idat_adler_truncated", "41"), ("idat_zlib_header_truncated", "41")],
    "idat_zlib_method": [("idat_zlib_method", "41")],
    "idat_zlib_window": [("idat_zlib_window", "41")],
    "idat_zlib_fcheck": [("idat_zlib_fcheck", "42")],
    "idat_zlib_dictionary": [("idat_zlib_dictionary", "42")],
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FOUND = "found AS (" + " UNION ALL ".join(f"SELECT file_id, {k} AS seq, '{rule}' AS rule_id, 'error' AS severity, {_quoted(RULES[rule][0])} AS message, ({at})::BIGINT AS \"offset\", '{RULES[rule][1]}' AS spec_ref FROM fault WHERE f = {_AT[f]}" for f, found in _ISSUES.items() for k, (rule, at) in enumerate(found)) + ")"
_SIZES = {"signature_truncated": "5", "chunk_truncated": "z - 6", "data_after_iend": "z + 3", "ihdr_required": "z - 25", "ihdr_duplicate": "z + 25", "iend_required": "z - 12", "idat_not_contiguous": "z + 12 + 15", "idat_adler_truncated": "62", "ihdr_invalid_length": "z + 1", "idat_required": "45", "idat_zlib_header_truncated": "58"}
_SIZE = "CASE " + " ".join(f"WHEN f = {_AT[k]} THEN {v}" for k, v in _SIZES.items()) + " ELSE z END"
_FORMAT = ", ".join(str(_AT[f]) for f in ("signature_invalid", "signature_truncated", "chunk_truncated"))
_PASS = ", ".join(f"({k}, {x0}, {y0}, {dx}, {dy})" for k, (x0, y0, dx, dy) in enumerate(ADAM7))
_PAIR = ", ".join(f"({k}, {d}, {c})" for k, (d, c) in enumerate(LEGAL_PAIRS))
_HEAD = f"kind(k, depth, color) AS (VALUES {_PAIR}), head AS (SELECT p_partkey AS file_id, p_size::BIGINT AS w, p_partkey % 13 + 1 AS h, depth, color, p_partkey % 2 AS lace, CASE color WHEN 0 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 4 END AS ch FROM part JOIN kind ON p_partkey % {len(LEGAL_PAIRS)} = k)"
_PASSES = f"step(pass, x0, y0, dx, dy) AS (VALUES {_PASS}), pas AS (SELECT file_id, pass, x0, y0, dx, dy, greatest(0, ceil((w - x0) / dx))::BIGINT AS pw, greatest(0, ceil((h - y0) / dy))::BIGINT AS ph, depth, ch FROM head, step WHERE lace = 1 UNION ALL SELECT file_id, 0, 0, 0, 1, 1, w, h, depth, ch FROM head WHERE lace = 0), lay AS (SELECT *, CASE WHEN pw > 0 AND ph > 0 THEN pw ELSE 0 END AS width, CASE WHEN pw > 0 AND ph > 0 THEN ph ELSE 0 END AS height FROM pas), rws AS (SELECT *, (width * ch * depth + 7) // 8 AS row_bytes FROM lay)"
# 8 x 8 interlaced pixels of four bits: pass, first stream row, first filtered byte, row bytes.
_EIGHT = "eight(pass, x0, y0, dx, dy, first_row, first_byte, rb) AS (VALUES (0,0,0,8,8,0,0,1),(1,4,0,8,8,1,2,1),(2,0,4,4,8,2,4,1),(3,2,0,4,4,3,6,1),(4,0,2,2,4,5,10,2),(5,1,0,2,2,7,16,2),(6,0,1,1,2,11,28,4)), grid AS (SELECT k, k % 8 AS x, k // 8 AS y FROM range(64) r(k)), loc AS (SELECT k, x, y, pass, (x - x0) // dx AS lx, (y - y0) // dy AS ry, first_row, first_byte, rb FROM grid, eight WHERE x >= x0 AND y >= y0 AND (x - x0) % dx = 0 AND (y - y0) % dy = 0), nfiles AS (SELECT count(DISTINCT event_id // 64) AS files FROM events)"
_RUN = "run AS (SELECT doc_id AS file_id, coalesce(quality, 0) AS q FROM labels)"
_RUN_TOKENS = "VALUES (0, 'literal', 0, 1, 0, 0), (1, 'literal', 1, 2, 0, 0), (2, 'length_distance', 2, 260, 258, 1), (3, 'length_distance', 260, 300, 40, 1), (4, 'end_of_block', 300, 300, 0, 0)"

SQL: dict[str, str] = {
    "chunk_stats": f"WITH {_DOC}, {_STORED} SELECT type, n::BIGINT AS chunks, b::BIGINT AS data_bytes FROM (SELECT 'IHDR' AS type, count(*) AS n, 13 * count(*) AS b FROM sc UNION ALL SELECT 'IEND', count(*), 0 FROM sc UNION ALL SELECT 'IDAT', sum(c), sum(s) FROM sc UNION ALL SELECT NULL, 2 * count(*) + sum(c), 13 * count(*) + sum(s) FROM sc)",
    "chunk_counts": f"WITH {_DOC}, {_STORED} SELECT file_id, 'IHDR' AS type, 1::BIGINT AS chunks, 13::BIGINT AS data_bytes FROM sc UNION ALL SELECT file_id, 'IEND', 1, 0 FROM sc UNION ALL SELECT file_id, 'IDAT', c, s FROM sc",
    "chunk_offsets": f"WITH {_DOC}, {_STORED}, {_IDATS} SELECT file_id, 0::BIGINT AS idx, 'IHDR' AS type, 8::BIGINT AS header_offset, 16::BIGINT AS data_offset, 13::BIGINT AS data_length, 29::BIGINT AS crc_offset FROM sc UNION ALL SELECT file_id, k + 1, 'IDAT', physical_offset - 8, physical_offset, length, physical_offset + length FROM seg UNION ALL SELECT file_id, c + 1, 'IEND', 33 + 12 * c + s, 41 + 12 * c + s, 0, 41 + 12 * c + s FROM sc",
    "chunk_issue_kinds": f"WITH {_FAULT} SELECT file_id, 0::BIGINT AS seq, CASE f WHEN {_AT['signature_invalid']} THEN 'bad_signature' WHEN {_AT['signature_truncated']} THEN 'truncated_signature' WHEN {_AT['chunk_truncated']} THEN 'truncated_header' ELSE 'trailing_bytes_after_iend' END AS kind, (CASE f WHEN {_AT['signature_invalid']} THEN 0 WHEN {_AT['signature_truncated']} THEN 5 WHEN {_AT['chunk_truncated']} THEN z - 12 ELSE z END)::BIGINT AS \"offset\" FROM fault WHERE f IN ({_FORMAT}, {_AT['data_after_iend']})",
    "chunk_spans": "SELECT item_id AS file_id, 0::BIGINT AS idx, 'IHDR' AS type, part, \"offset\"::BIGINT AS \"offset\", length::BIGINT AS length FROM benchmark, (VALUES ('header', 8, 8), ('data', 16, 13), ('crc', 29, 4)) v(part, \"offset\", length)",
    "idat_segments": f"WITH {_DOC}, {_STORED}, {_IDATS} SELECT file_id, k AS seg, physical_offset, length, logical_start FROM seg",
    "logical_to_physical": f"WITH {_DOC}, {_STORED}, {_IDATS}, want AS (SELECT file_id, 0 AS request, s - 4 AS a, s AS z FROM sc UNION ALL SELECT file_id, 1, 0, s FROM sc) SELECT file_id, request, k AS seg, physical_offset + greatest(a, logical_start) - logical_start AS \"offset\", least(z, logical_start + length) - greatest(a, logical_start) AS length FROM want JOIN seg USING (file_id) WHERE logical_start < z AND a < logical_start + length",
    "physical_to_logical": f"WITH {_DOC}, {_STORED}, {_IDATS}, want AS (SELECT file_id, request, o FROM sc, (VALUES (0, 0), (1, 33), (2, 46), (3, 1041), (4, 1053)) v(request, o)) SELECT w.file_id, request, o::BIGINT AS \"offset\", logical_start + o - physical_offset AS logical FROM want w LEFT JOIN seg ON seg.file_id = w.file_id AND o >= physical_offset AND o < physical_offset + length",
    "ihdr_fields": f"WITH {_DOC} SELECT file_id, 16::BIGINT AS width, h AS height, 8 AS bit_depth, 0 AS color_type, 0 AS compression, 0 AS filter, 0 AS interlace, 8::BIGINT AS header_offset FROM doc",
    "crc_check": f"WITH {_DOC}, {_STORED} SELECT (2 * count(*) + sum(c))::BIGINT AS chunks, 0::BIGINT AS mismatches FROM sc",
    "zlib_wrapper_fields": f"WITH {_ITEM}, {_STORED}, {_PIXEL}, sums AS (SELECT file_id, (1 + sum(v)) % 65521 AS a, (max(t) + sum((t - (17 * y + 1 + x)) * v)) % 65521 AS b FROM px JOIN sc USING (file_id) GROUP BY file_id) SELECT file_id, seq::BIGINT AS seq, name, value::BIGINT AS value, p1::BIGINT AS \"offset\", p2::BIGINT AS length, p3 AS bit_offset FROM (SELECT file_id, v.* FROM sc, (VALUES (0, 'CM', 8, 0, 4, 0), (1, 'CINFO', 7, 0, 4, 4), (2, 'FCHECK', 1, 1, 5, 0), (3, 'FDICT', 0, 1, 1, 5), (4, 'FLEVEL', 0, 1, 2, 6)) v(seq, name, value, p1, p2, p3) UNION ALL SELECT file_id, 5, 'ADLER32', b * 65536 + a, s - 4, 4, 0 FROM sums JOIN sc USING (file_id))",
    "wrapper_errors": f"WITH {_FAULT}, e AS (SELECT file_id, CASE WHEN f IN ({_FORMAT.rsplit(', ', 1)[0]}, {_AT['idat_required']}, {_AT['idat_zlib_header_truncated']}) THEN 'stream too short for a zlib header' WHEN f = {_AT['idat_zlib_method']} THEN 'compression method is not deflate' WHEN f = {_AT['idat_zlib_fcheck']} THEN 'zlib header check fails (FCHECK)' WHEN f = {_AT['idat_zlib_window']} THEN 'unsupported window size (CINFO)' WHEN f = {_AT['idat_adler_truncated']} THEN 'stream too short for the trailing Adler-32' ELSE '' END AS error FROM fault) SELECT file_id, error = '' AS success, error FROM e",
    "adler_check": "SELECT count(*) AS files, 0::BIGINT AS mismatches FROM documents",
    "bounded_reads": "SELECT item_id AS file_id, '504E47' AS head, '' AS at_end, NULL::VARCHAR AS outside FROM benchmark",
    "hex_dump": "WITH t AS (SELECT item_id AS file_id, hex(encode(text)) AS hx, text FROM benchmark WHERE strlen(text) > 0), l AS (SELECT file_id, hx, text, unnest(range(0, (length(hx) // 2 + 15) // 16)) AS k FROM t) SELECT file_id, (16 * k)::BIGINT AS \"offset\", trim(regexp_replace(substr(hx, (32 * k + 1)::BIGINT, 32), '(..)', '\\1 ', 'g')) AS hex, array_to_string(list_transform(regexp_extract_all(substr(hx, (32 * k + 1)::BIGINT, 32), '..'), lambda p: CASE WHEN ('0x' || p)::INT BETWEEN 32 AND 126 THEN chr(('0x' || p)::INT) ELSE '.' END), '') AS ascii FROM l",
    "hex_sources": f"WITH {_ITEM}, {_PIXEL}, first_row AS (SELECT file_id, h, substr(hex, 1, 32) AS r FROM hx) SELECT file_id, 'inflated' AS name, 'ready' AS status, (17 * h)::BIGINT AS size, '00' || r AS bytes FROM first_row UNION ALL SELECT file_id, 'defiltered', 'ready', 16 * h, r FROM first_row",
    "validation_issues": f"WITH {_FAULT}, {_FOUND} SELECT file_id, seq::BIGINT AS seq, rule_id, severity, message, \"offset\", spec_ref FROM found",
    "rule_summary": f"WITH {_FAULT}, {_FOUND} SELECT rule_id, count(*) AS n FROM found GROUP BY 1",
    "adler_rule": f"""WITH {_FAULT}
SELECT file_id, 'idat_adler_mismatch' AS rule_id, (49 + l + CASE f WHEN {_AT['idat_not_contiguous']} THEN 27 WHEN {_AT['ihdr_required']} THEN -25 WHEN {_AT['ihdr_duplicate']} THEN 25 WHEN {_AT['ihdr_invalid_length']} THEN 1 ELSE 0 END)::BIGINT AS "offset" FROM fault
  WHERE file_id % 4 = 0 AND f NOT IN ({', '.join(str(_AT[x]) for x in ('signature_invalid', 'signature_truncated', 'idat_adler_truncated', 'idat_required', 'idat_zlib_header_truncated', 'idat_zlib_method', 'idat_zlib_window', 'idat_zlib_fcheck', 'idat_zlib_dictionary'))})
UNION ALL SELECT file_id, 'chunk_crc_mismatch', (53 + l)::BIGINT FROM fault WHERE f = {_AT['chunk_crc_mismatch']}
UNION ALL SELECT file_id, 'idat_adler_truncated', 41::BIGINT FROM fault WHERE f IN ({_AT['idat_adler_truncated']}, {_AT['idat_zlib_header_truncated']})
""",
    "exit_codes": f"WITH {_FAULT} SELECT file_id, (CASE WHEN f = 0 THEN 0 WHEN f IN ({_FORMAT}) THEN 2 ELSE 3 END)::BIGINT AS code FROM fault",
    "validate_json": f"WITH {_FAULT}, {_FOUND}, j AS (SELECT file_id, string_agg('{{\"rule_id\":\"' || rule_id || '\",\"severity\":\"error\",\"message\":\"' || message || '\",\"offset\":' || \"offset\" || ',\"spec_ref\":\"' || spec_ref || '\"}}', ',' ORDER BY seq) AS js FROM found GROUP BY 1) SELECT file_id, '{{\"file\":\"broken/' || file_id || '.png\",\"size\":' || ({_SIZE}) || ',\"valid\":' || (js IS NULL) || ',\"issues\":[' || coalesce(js, '') || ']}}' AS json FROM fault LEFT JOIN j USING (file_id)",
    "inspect_json": f"WITH {_HEX}, {_BYTE}, {_LITERAL}, k AS (SELECT file_id, s, unnest(range(0, ceil(s / 100.0)::BIGINT)) AS i, ceil(s / 100.0)::BIGINT AS c FROM stream), ch AS (SELECT file_id, 0 AS i, 'IHDR' AS type, 8 AS a, 13 AS n FROM stream UNION ALL SELECT file_id, i + 1, 'IDAT', 33 + 112 * i, least(100, s - 100 * i) FROM k UNION ALL SELECT DISTINCT file_id, c + 1, 'IEND', 33 + 12 * c + s, 0 FROM k), j AS (SELECT file_id, max(a) + 12 AS size, string_agg('{{\"type\":\"' || type || '\",\"header_offset\":' || a || ',\"data_offset\":' || (a + 8) || ',\"data_length\":' || n || ',\"crc_offset\":' || (a + 8 + n) || '}}', ',' ORDER BY i) AS js FROM ch GROUP BY 1) SELECT file_id, '{{\"file\":\"literal/' || file_id || '.png\",\"size\":' || size || ',\"signature_valid\":true,\"chunks\":[' || js || '],\"issues\":[]}}' AS json FROM j",
    "chunk_tree": f"WITH {_HEX}, {_BYTE}, {_LITERAL}, k AS (SELECT file_id, s, unnest(range(0, ceil(s / 100.0)::BIGINT)) AS i, ceil(s / 100.0)::BIGINT AS c FROM stream), ch AS (SELECT file_id, 0 AS i, 'IHDR' AS type, 8 AS a, 13 AS n FROM stream UNION ALL SELECT file_id, i + 1, 'IDAT', 33 + 112 * i, least(100, s - 100 * i) FROM k UNION ALL SELECT DISTINCT file_id, c + 1, 'IEND', 33 + 12 * c + s, 0 FROM k) SELECT file_id, 'file: literal/' || file_id || '.png (' || (max(a) + 12) || ' bytes) signature=valid' || string_agg(chr(10) || '  ' || type || ' data=' || n || '@' || (a + 8) || ' crc@' || (a + 8 + n), '' ORDER BY i) AS text FROM ch GROUP BY file_id",
    "error_json": "SELECT 'n/' || n_name AS path, '{\"file\":\"n/' || n_name || '\",\"error\":true,\"error_code\":2}' AS json FROM nation WHERE n_regionkey = 1",
    "pass_layout": f"WITH {_HEAD}, {_PASSES} SELECT file_id, pass::BIGINT AS pass, width, height, x0::BIGINT AS x_start, y0::BIGINT AS y_start, dx::BIGINT AS x_step, dy::BIGINT AS y_step, row_bytes::BIGINT AS row_bytes, (CASE WHEN width > 0 THEN row_bytes + 1 ELSE 0 END)::BIGINT AS filter_row_bytes, (CASE WHEN width > 0 THEN (row_bytes + 1) * height ELSE 0 END)::BIGINT AS total_bytes FROM rws",
    "row_geometry": f"WITH {_HEAD} SELECT file_id, ch::BIGINT AS channels, ((w * ch * depth + 7) // 8)::BIGINT AS row_bytes, greatest(1, (ch * depth + 7) // 8)::BIGINT AS bpp FROM head",
    "total_pixels": f"WITH {_HEAD} SELECT file_id, w * h AS pixels FROM head",
    "stage_summary": f"WITH {_HEAD} SELECT file_id, concat_ws(',', CASE WHEN lace = 1 THEN 'adam7' END, CASE WHEN color = 3 THEN 'palette' END, CASE WHEN color IN (4, 6) THEN 'alpha' END, CASE WHEN depth < 8 THEN 'packed' END, CASE WHEN depth = 16 THEN '16-bit' END) AS conditions FROM head",
    "paeth_values": "WITH p AS (SELECT p_partkey AS file_id, p_partkey % 256 AS a, p_size * 5 % 256 AS b, p_partkey * p_size % 256 AS c FROM part), q AS (SELECT *, abs(b - c) AS x, abs(a - c) AS y, abs(a + b - 2 * c) AS z FROM p) SELECT file_id, 200::BIGINT AS f0, ((200 + a) % 256)::BIGINT AS f1, ((200 + b) % 256)::BIGINT AS f2, ((200 + (a + b) // 2) % 256)::BIGINT AS f3, ((200 + CASE WHEN x <= y AND x <= z THEN a WHEN y <= z THEN b ELSE c END) % 256)::BIGINT AS f4 FROM q",
    "scanline_spans": f"WITH {_DOC}, r AS (SELECT file_id, unnest(range(0, h)) AS k FROM doc) SELECT file_id, k AS stream_row, 0::BIGINT AS pass, k AS row_in_pass, 17 * k AS \"offset\", 17::BIGINT AS length, k % 5 AS filter_type FROM r",
    "filter_stats": f"WITH {_DOC}, r AS (SELECT unnest(range(0, h)) % 5 AS f FROM doc) SELECT f AS filter_type, count(*) AS rows, 16 * count(*) AS bytes FROM r GROUP BY 1",
    "unfiltered_rows": f"WITH {_DOC}, x AS (SELECT file_id, h, rpad(hex(encode(txt)), (32 * h)::INT, '0') AS hx FROM doc), r AS (SELECT file_id, hx, unnest(range(0, h)) AS k FROM x) SELECT file_id, k AS stream_row, md5(substr(hx, (32 * k + 1)::BIGINT, 32)) AS digest FROM r",
    "stage_sizes": f"WITH {_DOC} SELECT file_id, true AS success, 17 * h AS filtered, 16 * h AS unfiltered, h AS rows FROM doc",
    "stage_errors": f"WITH {_FAULT}, e AS (SELECT file_id, CASE WHEN f IN ({_AT['signature_invalid']}, {_AT['signature_truncated']}) THEN 'invalid PNG signature' WHEN f = {_AT['ihdr_required']} THEN 'missing or invalid IHDR' WHEN f IN ({_AT['ihdr_zero_dimension']}, {_AT['image_dimension_limit']}, {_AT['decoded_image_budget']}, {_AT['decoded_image_overflow']}, {_AT['ihdr_bit_depth_color_type']}) THEN 'invalid image header' WHEN f IN ({_AT['idat_required']}, {_AT['idat_adler_truncated']}, {_AT['idat_zlib_header_truncated']}, {_AT['idat_zlib_method']}, {_AT['idat_zlib_window']}, {_AT['idat_zlib_fcheck']}, {_AT['idat_zlib_dictionary']}) THEN 'inflate: stream did not reach end' ELSE '' END AS error FROM fault) SELECT file_id, error = '' AS success, error FROM e",
    "sample_sums": f"WITH {_HEX}, {_BYTE} SELECT file_id, count(*) AS n, sum(v)::BIGINT AS total, sum(v * (i + 1))::BIGINT AS weighted FROM b GROUP BY 1",
    "sample_histogram": f"WITH {_ITEM}, {_PIXEL} SELECT v::BIGINT AS value, count(*) AS n FROM px GROUP BY 1",
    "channel_sums": "SELECT 0::BIGINT AS channel, count(*) AS n, sum(l_quantity::INT)::BIGINT AS total FROM lineitem UNION ALL SELECT 1, count(*), sum(round(l_discount * 100)::INT) FROM lineitem UNION ALL SELECT 2, count(*), sum(round(l_tax * 100)::INT) FROM lineitem",
    "adam7_placement": "SELECT k // 8 AS y, k % 8 AS x, sum(v)::BIGINT AS total FROM (SELECT k, coalesce(v, 0) AS v FROM range(64) r(k) LEFT JOIN (SELECT event_id % 64 AS k, length(event_type) % 16 AS v FROM events) USING (k)) GROUP BY ALL",
    "filter_events": f"WITH {_ITEM}, {_PIXEL} SELECT (y % 5)::BIGINT AS type, count(*) AS n, sum(v)::BIGINT AS recon, 0::BIGINT AS wrong FROM px GROUP BY 1",
    "delivered_sums": "SELECT l_orderkey AS file_id, sum(l_quantity::INT // 256)::BIGINT AS r, sum(round(l_discount * 100)::INT // 256)::BIGINT AS g, sum(round(l_tax * 100)::INT // 256)::BIGINT AS b, (255 * count(*))::BIGINT AS a FROM lineitem GROUP BY 1",
    "delivered_palette": "WITH f AS (SELECT DISTINCT event_id // 64 AS f FROM events), p AS (SELECT f, k, coalesce(v, 0) AS v FROM f, range(64) r(k) LEFT JOIN (SELECT event_id // 64 AS f2, event_id % 64 AS k2, length(event_type) % 16 AS v FROM events) ON f = f2 AND k = k2) SELECT k // 8 AS y, k % 8 AS x, sum((3 * v + 1) % 256)::BIGINT AS r, sum((5 * v + 2) % 256)::BIGINT AS g, sum((7 * v + 3) % 256)::BIGINT AS b FROM p GROUP BY ALL",
    "image_diff": f"WITH {_HEX}, {_BYTE} SELECT file_id, 0::BIGINT AS y, min(i)::BIGINT AS x, 0::BIGINT AS channel, 1::BIGINT AS delta, count(*) AS differing FROM b WHERE i % 7 = 3 GROUP BY 1",
    "blocks": f"WITH {_DOC}, {_STORED}, k AS (SELECT file_id, t, nb, unnest(range(0, nb)) AS k FROM st) SELECT file_id, k AS idx, 'stored' AS type, k = nb - 1 AS last, 8 * (2 + k * 65540) AS input_bit_begin, 8 * (2 + k * 65540 + 5 + least(65535, t - 65535 * k)) AS input_bit_end, 65535 * k AS output_begin, 65535 * k + least(65535, t - 65535 * k) AS output_end FROM k",
    "block_stats": f"WITH {_DOC}, {_STORED} SELECT 'stored' AS type, sum(nb)::BIGINT AS blocks, (8 * sum(5 * nb + t))::BIGINT AS compressed_bits, sum(t)::BIGINT AS output_bytes FROM st UNION ALL SELECT 'fixed', 0, 0, 0 UNION ALL SELECT 'dynamic', 0, 0, 0",
    "block_for_output": f"WITH {_DOC}, {_STORED} SELECT file_id, request, o::BIGINT AS \"offset\", (CASE WHEN o < t THEN o // 65535 END)::BIGINT AS block_idx FROM st, (VALUES (0, 5), (1, 65535)) v(request, o)",
    "access_points": f"WITH {_DOC}, {_STORED}, k AS (SELECT file_id, unnest(range(0, nb)) AS k FROM st) SELECT file_id, k AS idx, 2 + 65540 * k AS input_byte, 0::BIGINT AS prime_bits, 65535 * k AS output_offset, least(32768, 65535 * k) AS history FROM k",
    "extract_output": "SELECT count(*) AS files, count(*) AS equal FROM documents",
    "extract_checks": "SELECT doc_id AS file_id, request, error = '' AS success, error FROM documents, (VALUES (0::BIGINT, ''), (1, 'output range out of bounds'), (2, 'source changed since indexing'), (3, 'source too short for the indexed stream'), (4, 'source too short for the access point')) v(request, error)",
    "tokens": f"WITH {_HEX}, {_BYTE}, {_LITERAL} SELECT file_id, idx::BIGINT AS idx, 'literal' AS kind, a AS input_bit_begin, a + bits AS input_bit_end, a + 16 AS stream_bit_begin, idx::BIGINT AS output_begin, idx::BIGINT + 1 AS output_end, v::BIGINT AS literal FROM tok UNION ALL SELECT file_id, n, 'end_of_block', a, a + 7, a + 16, n, n, 0 FROM fin",
    "token_stats": f"WITH {_HEX}, {_BYTE}, {_LITERAL} SELECT 'literal' AS kind, count(*) AS tokens, sum(bits)::BIGINT AS input_bits, count(*) AS output_bytes FROM tok UNION ALL SELECT 'end_of_block', count(*), 7 * count(*), 0 FROM fin UNION ALL SELECT 'length_distance', 0, 0, 0",
    "run_token_stats": "SELECT 'literal' AS kind, 2 * count(*) AS tokens, 16 * count(*) AS input_bits, 2 * count(*) AS output_bytes FROM labels UNION ALL SELECT 'length_distance', 2 * count(*), (8 + 5 + 7 + 3 + 5) * count(*), 298 * count(*) FROM labels UNION ALL SELECT 'end_of_block', count(*), 7 * count(*), 0 FROM labels",
    "length_histogram": "SELECT v::BIGINT AS value, count(*) AS n FROM labels, (VALUES (258), (40)) x(v) GROUP BY 1",
    "distance_histogram": "SELECT 1::BIGINT AS value, 2 * count(*) AS n FROM labels",
    "compression_rate": f"WITH {_HEX}, {_BYTE}, {_LITERAL} SELECT file_id, s AS compressed_bytes, n::BIGINT AS inflated_bytes, (1000 * s // n)::BIGINT AS per_mille FROM stream",
    "trace_status": f"WITH {_FAULT}, e AS (SELECT file_id, CASE WHEN f IN ({_FORMAT.rsplit(', ', 1)[0]}, {_AT['idat_required']}, {_AT['idat_zlib_header_truncated']}) THEN 'stream too short for a zlib header' WHEN f = {_AT['idat_zlib_method']} THEN 'compression method is not deflate' WHEN f = {_AT['idat_zlib_fcheck']} THEN 'zlib header check fails (FCHECK)' WHEN f = {_AT['idat_zlib_window']} THEN 'unsupported window size (CINFO)' WHEN f = {_AT['idat_zlib_dictionary']} THEN 'preset dictionaries (FDICT) are not supported' WHEN f = {_AT['idat_adler_truncated']} THEN 'stream too short for the trailing Adler-32' ELSE '' END AS error FROM fault) SELECT file_id, error = '' AS success, error FROM e",
    "token_containing": f"WITH {_HEX}, {_BYTE}, {_LITERAL} SELECT file_id, 5::BIGINT AS \"offset\", 5::BIGINT AS token_index, 5::BIGINT AS output_begin, 6::BIGINT AS output_end FROM fin WHERE n > 5",
    "token_overlapping": f"WITH {_HEX}, {_BYTE}, {_LITERAL} SELECT file_id, idx::BIGINT AS token_index, idx::BIGINT AS output_begin, idx::BIGINT + 1 AS output_end FROM tok WHERE idx >= 3 AND idx < 8",
    "literal_walk": "SELECT doc_id AS file_id, request::BIGINT AS request, 'ready' AS status, least(request, 1)::BIGINT AS literal_token, least(request // 2, 1)::BIGINT AS depth FROM labels, (VALUES (0), (1), (2), (3)) v(request)",
    "decode_arithmetic": "SELECT doc_id AS file_id, v.k::BIGINT AS token_index, kind, (CASE v.k WHEN 0 THEN coalesce(quality, 0) WHEN 1 THEN coalesce(quality, 0) WHEN 2 THEN 285 WHEN 3 THEN 273 ELSE 256 END)::BIGINT AS symbol, len::BIGINT AS length, (CASE v.k WHEN 2 THEN 258 WHEN 3 THEN 35 ELSE 0 END)::BIGINT AS length_base, (CASE v.k WHEN 3 THEN 3 ELSE 0 END)::BIGINT AS length_extra_bits, (CASE v.k WHEN 3 THEN 5 ELSE 0 END)::BIGINT AS length_extra_value, d::BIGINT AS distance, d::BIGINT AS distance_base FROM labels, (" + _RUN_TOKENS + ") v(k, kind, a, z, len, d)",
    "token_navigation": f"WITH {_HEX}, {_BYTE}, {_LITERAL} SELECT file_id, idx::BIGINT AS token_index, a AS \"begin\", a + bits AS \"end\" FROM tok UNION ALL SELECT file_id, n, a, a + 7 FROM fin",
    "huffman_inspector": "SELECT item_id AS file_id, 0::BIGINT AS block_idx, 'stored' AS mode, 'none' AS kind, 2::BIGINT AS declared, 0::BIGINT AS build_order FROM benchmark UNION ALL SELECT item_id + 1000000, 0, 'fixed', kind, d, o FROM benchmark, (VALUES ('literal_length', 288, 0), ('distance', 32, 1)) v(kind, d, o)",
    "huffman_inspector_text": "SELECT item_id AS file_id, 'tables=2|0,fixed,literal_length,0,288|0,fixed,distance,1,32' AS text FROM benchmark",
    "decode_inspector_text": "SELECT doc_id AS file_id, 'steps=5|0,literal,symbol=' || coalesce(quality, 0) || ',length=0+0+0+0,distance=0+0+0+0|1,literal,symbol=' || coalesce(quality, 0) || ',length=0+0+0+0,distance=0+0+0+0|2,match,symbol=285,length=258+258+0+0,distance=1+1+0+0|3,match,symbol=273,length=40+35+3+5,distance=1+1+0+0|4,eob,symbol=256,length=0+0+0+0,distance=0+0+0+0' AS text FROM labels",
    "block_inspector": f"WITH {_HEX}, {_BYTE}, {_LITERAL} SELECT file_id, 0::BIGINT AS block_idx, 'fixed' AS type, true AS last, 16::BIGINT AS input_bit_begin, a + 16 + 7 AS input_bit_end, 0::BIGINT AS output_begin, n::BIGINT AS output_end, n > 7 AS selected, (CASE WHEN n > 7 THEN 7 END)::BIGINT AS position FROM fin",
    "block_inspector_text": f"WITH {_HEX}, {_BYTE}, {_LITERAL} SELECT file_id, 'selected_block=' || CASE WHEN n > 7 THEN '0' ELSE '-' END || ';rows=1|0,fixed,1,16:' || (a + 23) || ',0:' || n || ',current=' || CASE WHEN n > 7 THEN '7' ELSE '-' END AS text FROM fin",
    "trace_window_status": f"WITH {_HEX}, {_BYTE}, {_LITERAL}, w AS (SELECT file_id, n, request, a, z, m FROM fin, (VALUES (0, 2, 6, 3), (1, 2, 6, 10), (2, 0, 100000, 10)) v(request, a0, z0, m), LATERAL (SELECT a0 AS a, z0 AS z) q(a, z)) SELECT file_id, request::BIGINT AS request, CASE WHEN z > n THEN 'error' WHEN z - a > m THEN 'partial' ELSE 'ready' END AS status, CASE WHEN z > n THEN 'inflated query range is out of bounds' WHEN z - a > m THEN 'trace token budget exceeded' ELSE '' END AS error, z <= n AND z - a > m AS truncated FROM (SELECT file_id, n, request, a0 AS a, z0 AS z, m FROM fin, (VALUES (0, 2, 6, 3), (1, 2, 6, 10), (2, 0, 100000, 10)) v(request, a0, z0, m))",
    "trace_window_tokens": f"WITH {_HEX}, {_BYTE}, {_LITERAL} SELECT file_id, request::BIGINT AS request, idx::BIGINT AS idx, idx::BIGINT AS output_begin FROM (SELECT file_id, idx, n FROM tok JOIN fin USING (file_id)), (VALUES (0, 3), (1, 10)) v(request, m) WHERE idx >= 2 AND idx < least(6, 2 + m) AND n >= 6",
    "locate_adam7": f"WITH {_EIGHT} SELECT x, y, pass::BIGINT AS pass, first_row + ry AS stream_row, ry AS row_in_pass, lx AS local_x, files FROM loc, nfiles",
    "coordinate_query": f"WITH {_ITEM} SELECT file_id, request::BIGINT AS request, CASE request WHEN 0 THEN 'ready' ELSE 'out of range' END AS status, CASE request WHEN 0 THEN '' ELSE 'image coordinate is outside the image' END AS error, (CASE request WHEN 0 THEN 0 END)::BIGINT AS stream_row, (CASE request WHEN 0 THEN 4 END)::BIGINT AS filtered_data_offset, (CASE request WHEN 0 THEN 3 END)::BIGINT AS unfiltered_data_offset, (CASE request WHEN 0 THEN 3 END)::BIGINT AS native_sample_index FROM doc, (VALUES (0), (1)) v(request)",
    "coordinate_adam7": f"WITH {_EIGHT} SELECT k AS request, 'ready' AS status, first_byte + ry * (rb + 1) + 1 + lx // 2 AS filtered_data_offset, (lx * 4 % 8)::BIGINT AS sample_bit_offset, y * 4 + x // 2 AS unfiltered_data_offset, y * 8 + x AS native_sample_index, files FROM loc, nfiles",
    "viewport_status": "SELECT l_orderkey AS file_id, CASE WHEN count(*) >= 3 THEN 'ready' ELSE 'out of range' END AS status FROM lineitem GROUP BY 1",
    "viewport_samples": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::INT, round(l_discount * 100)::INT, round(l_tax * 100)::INT) - 1 AS x, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey AS file_id, sum(l_quantity::INT + round(l_discount * 100)::INT + round(l_tax * 100)::INT)::BIGINT AS total FROM r WHERE n >= 3 AND x IN (1, 2) GROUP BY 1",
    "neighbourhood": f"WITH {_ITEM}, {_PIXEL} SELECT file_id, count(*) AS n, sum(v)::BIGINT AS total FROM px WHERE y <= 1 AND x BETWEEN 2 AND 4 GROUP BY 1",
    "stage_values": f"WITH {_ITEM}, {_PIXEL} SELECT file_id, v::BIGINT AS native, printf('%02X', v) AS filtered, printf('%02X', v) AS unfiltered FROM px WHERE y = 0 AND x = 3",
    "reconstruct_view": f"WITH {_ITEM}, {_PIXEL} SELECT file_id, x AS idx, x = 3 AS selected, v::BIGINT AS recon FROM px WHERE y = 0 AND x BETWEEN 1 AND 5",
    "formula_text": f"WITH {_ITEM}, {_PIXEL} SELECT file_id, 'none: (' || v || ' + 0) mod 256 = ' || v AS text FROM px WHERE y = 0 AND x = 3",
    "pixel_provenance": "SELECT item_id AS file_id, space, a::BIGINT AS \"begin\", z::BIGINT AS \"end\" FROM benchmark, (VALUES ('native', 3, 4), ('reconstructed', 3, 4), ('filtered', 4, 5), ('inflated', 4, 5), ('token', 4, 5), ('logical_bit', 88, 96), ('physical_bit', 416, 424)) v(space, a, z)",
    "anchor_index": f"WITH {_DOC}, k AS (SELECT file_id, unnest(range(0, (h + 5) // 6)) AS k FROM doc) SELECT file_id, 6 * k AS stream_row, 102 * k AS \"offset\" FROM k",
    "row_restore": f"WITH {_DOC} SELECT file_id, h - 1 AS stream_row, md5(substr(rpad(hex(encode(txt)), (32 * h)::INT, '0'), (32 * (h - 1) + 1)::BIGINT, 32)) AS digest, 17 * ((h - 1) % 6 + 1) AS replay_bytes FROM doc",
    "statistics": f"WITH {_ITEM}, {_STORED}, z AS (SELECT count(*) AS n, sum(c) AS c, sum(s) AS s, sum(t) AS t, sum(h) AS h FROM sc) SELECT 'chunk' AS family, 'IHDR' AS key, n::BIGINT AS n, (13 * n)::BIGINT AS input, 0::BIGINT AS output FROM z UNION ALL SELECT 'chunk', 'IEND', n, 0, 0 FROM z UNION ALL SELECT 'chunk', 'IDAT', c, s, 0 FROM z UNION ALL SELECT 'filter', k::VARCHAR, CASE k WHEN 0 THEN h ELSE 0 END, CASE k WHEN 0 THEN 16 * h ELSE 0 END, 0 FROM z, range(5) r(k) UNION ALL SELECT 'block', 'stored', n, 8 * (5 * n + t), t FROM z UNION ALL SELECT 'block', 'fixed', 0, 0, 0 UNION ALL SELECT 'block', 'dynamic', 0, 0, 0 UNION ALL SELECT 'token', 'literal', t, 8 * t, t FROM z UNION ALL SELECT 'token', 'end_of_block', n, 0, 0 FROM z UNION ALL SELECT 'token', 'length_distance', 0, 0, 0",
    "percentile_rank": "SELECT l_returnflag, l_linestatus, quantile_disc(l_quantity, 0.95) AS value FROM lineitem GROUP BY ALL",
    "threshold_gate": "WITH m AS (SELECT n_regionkey AS scenario, n_name AS metric, n_nationkey * 10 + CASE WHEN n_nationkey % 7 = 0 THEN 0.5 ELSE 0 END AS value FROM nation WHERE n_nationkey % 5 <> 0), c AS (SELECT n_regionkey AS scenario, n_name AS metric FROM nation WHERE n_nationkey % 4 <> 0) SELECT scenario, metric, CASE WHEN c.metric IS NULL THEN 'missing config' WHEN m.value IS NULL THEN 'missing scenario' WHEN m.value <> floor(m.value) THEN 'not an integer' WHEN m.value > 120 THEN 'over maximum' ELSE 'ok' END AS verdict FROM m FULL JOIN (SELECT scenario, metric, true AS there FROM c) c USING (scenario, metric)".replace("c.metric IS NULL", "c.there IS NULL"),
    "budget_status": "SELECT l_orderkey AS file_id, CASE WHEN count(*) > 5 OR count(DISTINCT l_partkey) > 4 THEN 'budget_exceeded' ELSE 'ready' END AS status FROM lineitem GROUP BY 1",
    "statistics_status": "WITH a AS (SELECT l_orderkey AS file_id, count(*) AS n, count(DISTINCT l_partkey) AS keys, sum(CASE WHEN l_orderkey % 11 = 0 THEN 9223372036854775807 ELSE l_suppkey END::HUGEINT) AS t FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS file_id, sum(CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_custkey END::HUGEINT) AS t FROM orders GROUP BY 1), j AS (SELECT file_id, CASE WHEN n > 5 OR keys > 4 THEN 'budget_exceeded' WHEN a.t > 9223372036854775807 THEN 'overflow' END AS x, CASE WHEN file_id % 7 = 0 AND b.t IS NOT NULL THEN 'invalid_input' WHEN coalesce(a.t, 0) + coalesce(b.t, 0) > 9223372036854775807 THEN 'overflow' END AS y, coalesce(a.t, 0) AS ta, coalesce(b.t, 0) AS tb FROM a FULL JOIN b USING (file_id)) SELECT file_id, coalesce(x, y, 'ready') AS status, CASE WHEN x IS NOT NULL THEN 'lines' WHEN y IS NOT NULL THEN 'orders' END AS failed, CASE WHEN x IS NOT NULL THEN 0 WHEN y IS NOT NULL THEN ta ELSE ta + tb END::BIGINT AS total FROM j",
    "checked_sums": "WITH v AS (SELECT c_nationkey::BIGINT AS file_id, CASE WHEN c_custkey % 10 = 0 THEN 9223372036854775807 ELSE c_custkey - 5 END::HUGEINT AS v FROM customer), g AS (SELECT file_id, sum(v) AS t, min(v) AS least FROM v GROUP BY 1) SELECT file_id, CASE WHEN least < 0 THEN 'invalid_input' WHEN t > 9223372036854775807 THEN 'overflow' ELSE 'ready' END AS status, CASE WHEN t <= 9223372036854775807 THEN t::BIGINT END AS total FROM g",
    "selection_text": "SELECT o_orderkey AS id, concat_ws(';', CASE WHEN o_orderkey % 2 = 1 THEN 'node:' || o_custkey END, CASE WHEN o_orderkey % 10 = 0 THEN 'physical_bit:' || o_custkey || ',8,3' WHEN o_orderkey % 5 = 0 THEN 'physical:' || o_custkey || ',8' END, CASE WHEN o_orderkey % 7 = 0 THEN 'logical:1,2' END, CASE WHEN o_orderkey % 3 = 0 THEN 'image:0,0,1,' || (o_orderkey % 50) || ',1' END, CASE WHEN o_orderkey % 6 = 0 THEN 'channel:1' END, CASE WHEN o_orderstatus = 'O' THEN 'stage:native' END) AS text FROM orders",
    "selection_round_trip": "SELECT count(*) AS n, count(*) AS parsed, count(*) AS equal FROM orders",
    "selection_merge": "WITH u AS (SELECT user_id AS document, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 2 END AS g, event_id, event_type FROM events), c AS (SELECT *, max(g) OVER (PARTITION BY document) AS m FROM u) SELECT document, g::BIGINT AS generation, event_id AS seq, max(CASE WHEN event_id % 2 = 0 THEN event_id END) OVER w AS node, max(CASE WHEN event_id % 3 = 0 THEN event_id END) OVER w AS logical_start, last_value(CASE WHEN event_id % 5 = 0 THEN event_type END IGNORE NULLS) OVER w AS stage FROM c WHERE g = m WINDOW w AS (PARTITION BY document ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
}
