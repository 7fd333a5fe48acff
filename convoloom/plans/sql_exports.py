"""SQL twins of the queries over exports, snapshots and transcripts."""

from convoloom.plans.sql_messages import M, SP, SQL as MESSAGES
from convoloom.plans.sql_sessions import GROUPS, INST, PUBLIC, SQL as SESSIONS

ISO = "CASE WHEN year(make_timestamp({0} * 1000)) > 9999 THEN '+' || lpad(CAST(year(make_timestamp({0} * 1000)) AS VARCHAR), 6, '0') ELSE lpad(CAST(year(make_timestamp({0} * 1000)) AS VARCHAR), 4, '0') END || strftime(make_timestamp({0} * 1000), '-%m-%dT%H:%M:%S.%g') || 'Z'"
ROWS = f"r AS ({SESSIONS['q24_timestamp_gap_fill']}), e AS (SELECT t.session_id, t.msg_id, CASE WHEN lower(t.role) IN ('assistant','ai','bot','system') THEN 'assistant' ELSE 'user' END AS role, t.message_key, coalesce(t.content, '') AS content, r.resolved_ms, r.resolved_source FROM messages t JOIN r USING (msg_id))"
MSG = "e.role, e.message_key, e.content"
VALID = "CASE WHEN json_valid(raw) THEN raw END"
FACTS = f"""l AS (SELECT session_id, line_id, raw, {VALID} AS j FROM transcript_lines), k AS (SELECT *, json_type(j) AS top, CASE WHEN json_type(j, '$.type') = 'VARCHAR' THEN json_extract_string(j, '$.type') END AS type,
 CASE WHEN json_type(j, '$.role') = 'VARCHAR' THEN json_extract_string(j, '$.role') END AS role, CASE WHEN json_type(j, '$.message.content') = 'ARRAY' THEN CAST(json_extract(j, '$.message.content[*]') AS JSON[]) END AS parts FROM l),
 t AS (SELECT *, list_transform(parts, lambda p: CASE WHEN json_type(p, '$.type') = 'VARCHAR' AND json_extract_string(p, '$.type') = 'text' AND json_type(p, '$.text') = 'VARCHAR' THEN json_extract_string(p, '$.text') END) AS texts,
 list_transform(parts, lambda p: CASE WHEN json_type(p, '$.type') = 'VARCHAR' AND json_extract_string(p, '$.type') = 'tool_use' AND json_type(p, '$.name') = 'VARCHAR' THEN json_extract_string(p, '$.name') END) AS calls FROM k),
 u AS (SELECT *, coalesce(array_to_string(list_filter(texts, lambda x: x IS NOT NULL), ''), '') AS content, len(list_filter(calls, lambda x: x IS NOT NULL)) AS n_tools, coalesce(len(list_filter(range(1, len(parts) + 1), lambda i: texts[i] IS NULL AND calls[i] IS NULL)) = 0, false) AS complete FROM t),
 fa AS (SELECT *, CASE WHEN regexp_replace(coalesce(raw, ''), '{SP}+', '', 'g') = '' THEN 'blank' WHEN j IS NULL THEN 'malformed' WHEN top <> 'OBJECT' THEN 'skip' WHEN type = 'error' THEN 'error' WHEN role = 'system' THEN 'ignored'
 WHEN role IN ('user','assistant') AND parts IS NOT NULL AND (len(content) > 0 OR n_tools > 0) THEN 'message' ELSE 'skip' END AS kind FROM u)"""

SQL = {
    "q40_manifest_validate": "SELECT doc_id AS path, CASE WHEN text IS NULL THEN 'missing' WHEN n_chars IS DISTINCT FROM len(text) THEN 'corrupt' ELSE 'valid' END AS state FROM documents",
    "q52_manifest_verdict": "WITH s AS (SELECT CASE WHEN text IS NULL THEN 'missing' WHEN n_chars IS DISTINCT FROM len(text) THEN 'corrupt' ELSE 'valid' END AS state FROM documents), n AS (SELECT count(*) FILTER (WHERE state = 'valid') AS valid, count(*) FILTER (WHERE state = 'corrupt') AS corrupt, count(*) FILTER (WHERE state = 'missing') AS missing, CAST(0 AS BIGINT) AS extra FROM s) SELECT *, CASE WHEN missing > 0 OR valid = 0 THEN 'invalid' WHEN corrupt > 0 THEN 'warnings' ELSE 'valid' END AS status FROM n",
    "q41_budget_excess": "WITH x AS (SELECT doc_id, sum(coalesce(n_chars, 0)) OVER (ORDER BY doc_id) AS total FROM documents) SELECT doc_id, CAST(total AS BIGINT) AS total FROM x WHERE total > 200000 ORDER BY doc_id LIMIT 1",
    "q42_diagnostics": "WITH x AS (SELECT session_id, CASE WHEN trim(raw) = '' THEN 'blank-line' WHEN NOT json_valid(raw) THEN 'damaged-line' END AS code FROM transcript_lines) SELECT code, session_id, count(*) AS n FROM x WHERE code IS NOT NULL GROUP BY ALL",
    "q43_export_json": f"""WITH {ROWS} SELECT session_id, msg_id, '{{' || CASE WHEN message_key <> '' THEN '"id":' || CAST(to_json(message_key) AS VARCHAR) || ',' ELSE '' END || '"role":"' || role || '","content":' || CAST(to_json(content) AS VARCHAR) || ',"codeBlocks":' ||
 CAST(CASE WHEN contains(content, '```') THEN len(regexp_extract_all(content, '(?m)^```(\\w*)\\n((?s:.*?))^```')) ELSE 0 END AS VARCHAR) || ',"timestamp":' || CAST(resolved_ms AS VARCHAR) || ',"timestampSource":"' || resolved_source || '"}}' AS json FROM e""",
    "q44_export_markdown": f"""WITH {ROWS}, h AS ({MESSAGES['q01_session_summary']}), st AS ({SESSIONS['q25_session_timestamps']}), w AS (SELECT id AS session_id, {PUBLIC.format('arg_min(row(workspace), session_row_id)[1]')} AS workspace FROM sessions WHERE id IS NOT NULL GROUP BY id)
 SELECT session_id, CAST(0 AS BIGINT) AS msg_id, concat_ws(chr(10), '# ' || coalesce(title, 'Untitled Chat'), '', '**Date**: ' || substring({ISO.format('created_ms')}, 1, 10), '**Last Updated**: ' || {ISO.format('updated_ms')}, '**Workspace**: ' || workspace, '**Messages**: ' || CAST(n_messages AS VARCHAR), '', '---', '') AS block
 FROM h JOIN st USING (session_id) LEFT JOIN w USING (session_id) UNION ALL
 SELECT session_id, msg_id, concat_ws(chr(10), '### ' || CASE WHEN role = 'user' THEN '**User**' ELSE '**Assistant**' END, '', CASE WHEN message_key <> '' THEN '**ID**: `' || message_key || '`' END, CASE WHEN message_key <> '' THEN '' END,
 '**Time**: ' || CASE WHEN resolved_source = 'composer-created-at' THEN '' ELSE '≈ ' END || {ISO.format('resolved_ms')}, '**Time Source**: ' || resolved_source, '', content, '') FROM e""",
    "q47_attachments": "SELECT doc_id, 1 AS n, true AS same, 12 AS rest FROM documents WHERE text <> ''",
    "q48_incremental_replace": f"WITH {M}, s AS (SELECT session_id, min(received_ms) AS lo, max(received_ms) AS hi FROM m GROUP BY session_id) SELECT session_id, CASE WHEN lo >= 1704067200000 THEN 'new' ELSE 'changed' END AS action FROM s WHERE hi >= 1704067200000",
    "q49_transcript_messages": f"WITH {FACTS} SELECT line_id, role, CAST(len(content) AS INT) AS n_chars, CAST(n_tools AS INT) AS n_tools, complete FROM fa WHERE kind = 'message'",
    "q50_transcript_states": f"""WITH {FACTS}, c AS (SELECT session_id, count(*) FILTER (WHERE kind = 'message') AS messages, count(*) FILTER (WHERE kind = 'error') AS errors, count(*) FILTER (WHERE kind = 'malformed') AS malformed,
 count(*) FILTER (WHERE kind = 'skip' OR kind = 'message' AND NOT complete) AS unsupported, count(*) FILTER (WHERE kind = 'ignored') AS ignored, count(*) FILTER (WHERE kind <> 'blank') AS nonempty FROM fa GROUP BY session_id)
 SELECT session_id, CASE WHEN messages > 0 THEN CASE WHEN malformed > 0 OR unsupported > 0 OR errors > 0 THEN 'partial' ELSE 'parsed' END WHEN errors > 0 AND malformed = 0 AND unsupported = 0 THEN 'error-only' WHEN nonempty > ignored THEN 'unsupported' ELSE 'empty' END AS state,
 messages, errors, malformed, unsupported, ignored FROM c""",
    "q53_migrate_eligibility": f"""WITH {GROUPS}, g2 AS (SELECT id, bool_or(state = 'divergent') AS dv, CAST(sum(n_copies) AS BIGINT) AS n FROM grp WHERE role = 'composer' GROUP BY id), fx AS (SELECT id, bool_or(role = 'composer') AS c, bool_or(role = 'store') AS s, count(DISTINCT workspace) AS w FROM inst GROUP BY id)
 SELECT id, CASE WHEN NOT c THEN 'store-only' WHEN s THEN CASE WHEN dv THEN 'ambiguous' ELSE 'merged' END WHEN w > 1 THEN 'shared-membership' WHEN dv THEN 'ambiguous' WHEN n > 1 THEN 'multiple-occurrences' WHEN w = 0 THEN 'unbound' ELSE 'eligible' END AS eligibility, coalesce(n, 0) AS n_copies FROM fx LEFT JOIN g2 USING (id)""",
    "q62_dashed_ids": "SELECT workspace_id, regexp_replace(lower(workspace_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uuid FROM workspaces",
    "q64_guid_harvest": "WITH x AS (SELECT DISTINCT session_id, lower(unnest(regexp_extract_all(raw, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}'))) AS guid FROM transcript_lines) SELECT * FROM x WHERE guid <> session_id",
    "q67_compact_numbers": """SELECT doc_id, CASE WHEN n_chars * 37 >= 1000000 THEN printf('%.1f', round(n_chars * 37 / 1000000.0, 1)) || 'M' WHEN n_chars * 37 >= 1000 THEN printf('%.1f', round(n_chars * 37 / 1000.0, 1)) || 'k' ELSE CAST(n_chars * 37 AS VARCHAR) END AS count,
 CASE WHEN n_chars * 1000 < 1024 THEN CAST(n_chars * 1000 AS VARCHAR) || ' B' WHEN n_chars * 1000 < 1048576 THEN printf('%.1f', round(n_chars * 1000 / 1024.0, 1)) || ' KB' WHEN n_chars * 1000 < 1073741824 THEN printf('%.1f', round(n_chars * 1000 / 1048576.0, 1)) || ' MB' ELSE printf('%.1f', round(n_chars * 1000 / 1073741824.0, 1)) || ' GB' END AS size,
 CASE WHEN len(session_id) <= 12 THEN session_id ELSE substring(session_id, 1, 9) || '...' END AS cut, CASE WHEN len(session_id) <= 12 THEN session_id ELSE '...' || right(session_id, 9) END AS cut_start FROM documents WHERE n_chars IS NOT NULL""",
    "q68_record_wrappers": f"WITH x AS (SELECT {VALID} AS j FROM transcript_lines), y AS (SELECT CASE WHEN json_type(j) = 'OBJECT' THEN 'plain' WHEN json_type(j) = 'VARCHAR' AND json_valid(json_extract_string(j, '$')) AND json_type(json_extract_string(j, '$')) = 'OBJECT' THEN 'wrapped' ELSE 'none' END AS how FROM x) SELECT how, count(*) AS n FROM y GROUP BY how",
}
SQL["q61_migrate_preview"] = f"WITH el AS ({SQL['q53_migrate_eligibility']}), {INST} SELECT DISTINCT id, workspace, '/data/moved' || substring(workspace, 5) AS moved FROM inst JOIN el USING (id) WHERE eligibility = 'eligible' AND (workspace = '/srv' OR starts_with(workspace, '/srv/'))"
SQL["q51_kv_live_sessions"] = "WITH c AS (SELECT session_id, count(*) AS n_bubbles FROM messages WHERE session_id IS NOT NULL GROUP BY session_id), s AS (SELECT id, arg_min(row(title), session_row_id)[1] AS title FROM sessions WHERE id IS NOT NULL GROUP BY id) SELECT session_id, title, n_bubbles FROM c JOIN s ON s.id = session_id"
SQL["q60_kv_bubbles"] = f"WITH u AS ({SESSIONS['q28_token_usage']}) SELECT m.msg_id, CAST(CASE WHEN regexp_replace(coalesce(content, ''), '{SP}+', '', 'g') = '' THEN CASE WHEN contains(content, chr(10)) THEN len(content) ELSE 15 END ELSE len(content) END AS INT) AS n_chars, false AS corrupted, u.input FROM messages m LEFT JOIN u USING (msg_id) WHERE session_id IS NOT NULL"
KEYED = "SELECT session_id, msg_id, message_key FROM messages WHERE session_id IS NOT NULL AND message_key <> ''"
SQL["q69_collision_ids"] = f"WITH k AS ({KEYED}), n AS (SELECT *, row_number() OVER (PARTITION BY session_id, message_key ORDER BY msg_id) AS n FROM k) SELECT msg_id, message_key || CASE WHEN n = 1 THEN '' ELSE ':collision:' || CAST(n - 1 AS VARCHAR) END AS identity FROM n"
LINKS = f"k AS (SELECT DISTINCT session_id, message_key FROM ({KEYED})), x AS (SELECT m.session_id, m.msg_id, k.message_key AS parent_id, coalesce(parent_key, '') <> '' AND k.message_key IS NULL AS unresolved FROM messages m LEFT JOIN k ON k.session_id = m.session_id AND k.message_key = m.parent_key WHERE m.session_id IS NOT NULL)"
SQL["q71_link_rewrite"] = f"WITH {LINKS} SELECT msg_id, parent_id, unresolved FROM x"
SQL["q72_link_states"] = f"WITH {LINKS} SELECT session_id, CASE WHEN bool_or(unresolved) THEN 'partial' ELSE 'complete' END AS state, count(*) FILTER (WHERE unresolved) AS n_unresolved FROM x GROUP BY session_id"
STEP = 21600000
SQL["q73_stream_tumbling"] = f"SELECT epoch_us(ts) // 1000 // {STEP} * {STEP} AS start_ms, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL"
SQL["q74_stream_sliding"] = f"WITH x AS (SELECT epoch_us(ts) // 1000 // {STEP} * {STEP} AS s FROM events), y AS (SELECT s FROM x UNION ALL SELECT s - {STEP} FROM x) SELECT s AS start_ms, count(*) AS n FROM y GROUP BY s"
SQL["q75_stream_sessions"] = f"""WITH x AS (SELECT user_id, epoch_us(ts) AS t FROM events), y AS (SELECT *, CASE WHEN t >= lag(t) OVER (PARTITION BY user_id ORDER BY t) + {STEP}000 OR lag(t) OVER (PARTITION BY user_id ORDER BY t) IS NULL THEN 1 ELSE 0 END AS b FROM x),
 z AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM y) SELECT user_id, min(t) // 1000 AS start_ms, (max(t) + {STEP}000) // 1000 AS end_ms, count(*) AS n FROM z GROUP BY user_id, g"""
SQL["q76_first_claims"] = f"""WITH c AS (SELECT id, 0 AS source, session_row_id AS r, {PUBLIC.format("workspace")} AS w FROM sessions WHERE source <> 'global' AND workspace IS NOT NULL UNION ALL SELECT session_id, 1, meta_id, {PUBLIC.format("cwd")} FROM store_meta UNION ALL SELECT session_id, 2, msg_id, NULL FROM messages),
 x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source, r) AS rn FROM c WHERE id IS NOT NULL) SELECT id, coalesce(w, '(global)') AS workspace, source FROM x WHERE rn = 1"""
SQL["q77_scope_states"] = f"WITH {INST}, s AS (SELECT min(path) AS p FROM workspaces), g AS (SELECT id, count(*) FILTER (WHERE workspace = p) AS i, count(*) FILTER (WHERE workspace <> p) AS n_omitted FROM inst, s WHERE workspace IS NOT NULL GROUP BY id) SELECT id, CASE WHEN n_omitted > 0 THEN 'partial' ELSE 'complete' END AS state, n_omitted, CASE WHEN n_omitted > 0 THEN 'workspace-scope-omitted' ELSE '' END AS reasons FROM g WHERE i > 0"
SQL["q78_contributions"] = f"""WITH {INST}, e AS (SELECT id, role, bool_or(tier = 'complete') AS complete FROM inst GROUP BY id, role), l AS (SELECT DISTINCT session_id AS id, unnest(CASE WHEN stack = 'both' THEN ['composer','store'] ELSE [stack] END) AS role FROM messages WHERE stack IS NOT NULL AND session_id IS NOT NULL),
 x AS (SELECT e.*, l.id IS NOT NULL AS there FROM e LEFT JOIN l USING (id, role)) SELECT id, CASE WHEN bool_and(there AND complete) THEN 'complete' ELSE 'partial' END AS state, concat_ws(',', CASE WHEN bool_or(there AND role = 'composer') THEN 'composer' END, CASE WHEN bool_or(there AND role = 'store') THEN 'store' END) AS roles,
 concat_ws(',', CASE WHEN bool_or(NOT there) THEN 'source-unavailable' END, CASE WHEN bool_or(there AND NOT complete) THEN 'source-partial' END) AS reasons FROM x GROUP BY id"""
