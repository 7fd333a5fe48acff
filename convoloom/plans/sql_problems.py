"""SQL twins of those queries of the listed problems that SQL can say."""

from convoloom.functions.times import ZONES
from convoloom.plans.sql_messages import SP

_OFFSETS = "CASE z " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in ZONES.items()) + " END"


def instants(source: str) -> str:
    """CTEs that give tm(key..., ms) for a query source(key..., v, tz) named raw; key columns are kept."""
    return f"""raw AS ({source}), t0 AS (SELECT *, upper(trim(regexp_replace(v, '{SP}+', ' ', 'g'))) AS s FROM raw),
 t1 AS (SELECT *, CASE WHEN regexp_matches(s, '^\\d{{4}}-') THEN regexp_extract(s, '^(\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d)(?:\\.\\d+)? ?(?:Z|[A-Z]{{2,4}}|[+-]\\d\\d:?\\d\\d)?$', 1) ELSE s END AS b,
  regexp_extract(s, '^\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d\\.(\\d+)', 1) AS f,
  CASE WHEN regexp_matches(s, '^\\d{{8}}T\\d{{6}}Z$') OR regexp_matches(s, ' UTC$') THEN 'UTC' WHEN regexp_matches(s, '^[A-Z]{{3}} \\d') OR regexp_matches(s, '[AP]M$') THEN '' ELSE regexp_extract(s, ':\\d\\d(?:\\.\\d+)? ?(Z|[A-Z]{{2,4}}|[+-]\\d\\d:?\\d\\d)$', 1) END AS z FROM t0),
 t2 AS (SELECT *, CASE WHEN regexp_matches(s, '^\\d{{4}}-') THEN TRY_CAST(replace(b, 'T', ' ') AS TIMESTAMP) WHEN regexp_matches(s, '^\\d{{8}}T\\d{{6}}Z$') THEN try_strptime(s, '%Y%m%dT%H%M%SZ') WHEN contains(s, '/') THEN try_strptime(s, '%m/%d/%Y %I:%M:%S %p')
  WHEN regexp_matches(s, '^\\d\\d\\.\\d\\d\\.\\d{{4}} ') THEN try_strptime(s, '%d.%m.%Y %H:%M:%S') WHEN regexp_matches(s, '^[A-Z]{{3}} \\d') THEN try_strptime(regexp_replace(s, ' UTC$', ''), '%b %d, %Y, %I:%M:%S %p')
  ELSE try_strptime(regexp_extract(s, '^(?:[A-Z]{{3}}, )?(\\d{{1,2}} [A-Z]{{3}} \\d{{4}} \\d\\d:\\d\\d:\\d\\d)', 1), '%d %b %Y %H:%M:%S') END AS w,
  CASE WHEN regexp_matches(z, '^[+-]') THEN CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * (CAST(z[2:3] AS INT) * 60 + CAST(right(z, 2) AS INT)) ELSE {_OFFSETS} END AS o FROM t1),
 tm AS (SELECT *, CASE WHEN regexp_matches(s, '^\\d{{10}}$') THEN CAST(s AS BIGINT) * 1000 WHEN regexp_matches(s, '^\\d{{13}}$') THEN CAST(s AS BIGINT) WHEN regexp_matches(s, '^\\d{{16}}$') THEN CAST(s AS BIGINT) // 1000
  WHEN regexp_matches(s, '^\\d{{10}}\\.\\d+$') THEN CAST(split_part(s, '.', 1) AS BIGINT) * 1000 + CAST(rpad(split_part(s, '.', 2), 3, '0')[1:3] AS INT)
  WHEN w IS NULL THEN NULL WHEN z = '' THEN CASE WHEN timezone(tz, timezone(tz, w - INTERVAL 1 HOUR) + INTERVAL 1 HOUR) = w THEN least(epoch_ms(timezone(tz, w)), epoch_ms(timezone(tz, w - INTERVAL 1 HOUR)) + 3600000) ELSE epoch_ms(timezone(tz, w)) END
  ELSE epoch_ms(w) - o * 60000 END + CASE WHEN f <> '' THEN CAST(rpad(f, 3, '0')[1:3] AS INT) ELSE 0 END AS ms FROM t2)"""


_FIELDS = [("store_meta", "meta_id", "created_at_ms"), ("store_meta", "meta_id", "updated_at_ms"), ("sessions", "session_row_id", "created_at"), ("messages", "msg_id", "msg_time")]
_ALL = " UNION ALL ".join(f"SELECT '{t}' AS tbl, {k} AS row_id, '{f}' AS field, {f} AS v, tz FROM {t} JOIN workspaces USING (workspace_id)" for t, k, f in _FIELDS)

SQL = {
    "p3_found": f"WITH {instants(_ALL)} SELECT tbl, row_id, field, ms AS utc_ms FROM tm WHERE ms IS NOT NULL",
    "p6_found": """WITH RECURSIVE x AS (SELECT line_id, CASE WHEN json_valid(raw) THEN raw END AS j FROM transcript_lines), y AS (SELECT line_id, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(json_extract_string(j, '$')) THEN json_extract_string(j, '$') ELSE j END AS j FROM x),
 z AS (SELECT line_id, json_extract(j, '$.message.content') AS c FROM y WHERE json_type(j) = 'OBJECT'),
 p AS (SELECT line_id, CAST(unnest(range(len(l))) AS VARCHAR) AS part_path, unnest(l) AS part FROM (SELECT line_id, CASE json_type(c) WHEN 'ARRAY' THEN CAST(json_extract(c, '$[*]') AS JSON[]) WHEN 'VARCHAR' THEN [CAST('{"type":"text"}' AS JSON)] END AS l FROM z)
  UNION ALL SELECT line_id, part_path || '.' || CAST(unnest(range(len(l))) AS VARCHAR), unnest(l) FROM (SELECT line_id, part_path, CASE json_type(part, '$.content') WHEN 'ARRAY' THEN CAST(json_extract(part, '$.content[*]') AS JSON[]) WHEN 'VARCHAR' THEN [CAST('{"type":"text"}' AS JSON)] END AS l FROM p WHERE json_extract_string(part, '$.type') = 'tool_result'))
 SELECT line_id, part_path, coalesce(json_extract_string(part, '$.type'), '') AS part_type, coalesce(json_extract_string(part, '$.name'), '') AS part_name FROM p""",
    "p1_found": """WITH f AS (SELECT install_id, feed, drop_no, entity_id, payload FROM carrier_files WHERE json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT'),
 t AS (SELECT f.install_id, f.feed, f.drop_no, f.entity_id, replace(replace(j.fullkey[3:], '"', ''), '"', '') AS path, CASE WHEN j.type = 'VARCHAR' THEN 'string' WHEN j.type = 'BOOLEAN' THEN 'boolean' WHEN j.type = 'ARRAY' THEN 'array' WHEN j.type = 'DOUBLE' THEN 'fraction' ELSE 'integer' END AS type, CAST(j.value AS VARCHAR) AS value
  FROM f, json_tree(f.payload) j WHERE j.type NOT IN ('OBJECT', 'NULL') AND NOT contains(j.path, '[') AND NOT regexp_matches(j.fullkey, '\\]$')),
 dr AS (SELECT *, lag(drop_no) OVER (PARTITION BY install_id, feed ORDER BY drop_no) AS prev FROM (SELECT DISTINCT install_id, feed, drop_no FROM f)), p AS (SELECT install_id, feed, drop_no, path, list_sort(list(DISTINCT type)) AS types FROM t GROUP BY ALL),
 b AS (SELECT coalesce(o.install_id, n.install_id) AS install_id, coalesce(o.feed, n.feed) AS feed, coalesce(o.now, n.drop_no) AS drop_no, coalesce(o.path, n.path) AS path, o.types AS t1, n.types AS t2, coalesce(o.prev, n.prev) AS prev
  FROM (SELECT p.*, dr.drop_no AS now, dr.prev FROM p JOIN dr ON p.install_id = dr.install_id AND p.feed = dr.feed AND p.drop_no = dr.prev) o FULL JOIN (SELECT p.*, dr.prev FROM p JOIN dr USING (install_id, feed, drop_no) WHERE dr.prev IS NOT NULL) n ON o.install_id = n.install_id AND o.feed = n.feed AND o.now = n.drop_no AND o.path = n.path),
 v AS (SELECT install_id, feed, drop_no, entity_id, path, list_sort(list(DISTINCT type || value)) AS vs FROM t GROUP BY ALL),
 r AS (SELECT g.install_id, g.feed, g.drop_no, g.path AS field, h.path AS new_field FROM b g JOIN b h ON g.install_id = h.install_id AND g.feed = h.feed AND g.drop_no = h.drop_no AND g.t2 IS NULL AND h.t1 IS NULL
  JOIN v x ON x.install_id = g.install_id AND x.feed = g.feed AND x.drop_no = g.prev AND x.path = g.path JOIN v y ON y.install_id = h.install_id AND y.feed = h.feed AND y.drop_no = h.drop_no AND y.path = h.path AND y.entity_id = x.entity_id GROUP BY ALL HAVING bool_and(x.vs = y.vs))
 SELECT install_id, feed, drop_no, field, 'renamed' AS change_type, new_field FROM r UNION ALL SELECT install_id, feed, drop_no, path, 'removed', '' FROM b WHERE t2 IS NULL AND (install_id, feed, drop_no, path) NOT IN (SELECT (install_id, feed, drop_no, field) FROM r)
 UNION ALL SELECT install_id, feed, drop_no, path, 'added', '' FROM b WHERE t1 IS NULL AND (install_id, feed, drop_no, path) NOT IN (SELECT (install_id, feed, drop_no, new_field) FROM r) UNION ALL SELECT install_id, feed, drop_no, path, 'type', '' FROM b WHERE t1 <> t2""",
}
_LINES = "x AS (SELECT *, CASE WHEN json_valid(raw) THEN raw END AS w FROM transcript_lines), y AS (SELECT *, CASE WHEN json_type(w) = 'OBJECT' THEN w WHEN json_type(w) = 'VARCHAR' AND json_valid(json_extract_string(w, '$')) AND json_type(json_extract_string(w, '$')) = 'OBJECT' THEN json_extract_string(w, '$') END AS j FROM x)"
SQL["p6_lines"] = f"""WITH {_LINES} SELECT line_id, session_id, line_no, CASE WHEN j IS NOT NULL THEN 'record' WHEN w IS NULL THEN 'damaged' ELSE 'other' END AS state, json_extract_string(j, '$.role') AS role, json_extract_string(j, '$.type') AS type, json_extract_string(j, '$.error') AS error,
 json_extract_string(j, '$.parentMessageId') AS parent_message_id, TRY_CAST(json_extract_string(j, '$.isSidechain') AS BOOLEAN) AS is_sidechain FROM y"""
SQL["q58_tool_usage"] = SQL["p6_found"].replace(
    "SELECT line_id, part_path, coalesce(json_extract_string(part, '$.type'), '') AS part_type, coalesce(json_extract_string(part, '$.name'), '') AS part_name FROM p",
    """, c AS (SELECT session_id, json_extract_string(part, '$.id') AS call_id, json_extract_string(part, '$.name') AS name FROM p JOIN transcript_lines USING (line_id) WHERE json_extract_string(part, '$.type') = 'tool_use'), a AS (SELECT DISTINCT json_extract_string(part, '$.tool_use_id') AS call_id FROM p WHERE json_extract_string(part, '$.type') = 'tool_result')
 SELECT name, count(*) AS n_calls, count(a.call_id) AS n_answered, count(DISTINCT session_id) AS n_sessions FROM c LEFT JOIN a USING (call_id) GROUP BY name""",
)
SQL["q79_block_evidence"] = f"""WITH {_LINES}, p AS (SELECT line_id, unnest(CASE json_type(j, '$.message.content') WHEN 'ARRAY' THEN CAST(json_extract(j, '$.message.content[*]') AS JSON[]) WHEN 'VARCHAR' THEN [CAST('{{"type":"text","text":""}}' AS JSON)] END) AS part FROM y)
 SELECT line_id, count(*) AS n_parts, count(*) FILTER (WHERE NOT coalesce(json_extract_string(part, '$.type') = 'text' AND json_extract_string(part, '$.text') IS NOT NULL OR json_extract_string(part, '$.type') = 'tool_use' AND json_extract_string(part, '$.name') IS NOT NULL, false)) AS n_unsupported,
 count(*) FILTER (WHERE json_extract_string(part, '$.type') = 'tool_use' AND json_extract_string(part, '$.name') IS NOT NULL) AS n_tools FROM p GROUP BY line_id"""
