"""SQL twins of the queries over copies, times, usage and workspaces."""

from convoloom.plans.sql_messages import M

# drive letters in lower case, as the workspaces' paths have them; no other forms occur in the tables
NORM = "rtrim(CASE WHEN regexp_matches({0}, '^[a-zA-Z]:/') THEN lower({0}) ELSE {0} END, '/')"
PUBLIC = "CASE WHEN coalesce({0}, '') <> '' AND NOT regexp_matches(trim({0}), '(?i)^(global|unknown|\\((global|unknown workspace|workspace:\\s*[^)]*)\\))$') THEN CASE WHEN trim({0}, '/') = '' THEN '/' ELSE " + NORM + " END END"
INST = f"""i AS (SELECT id, session_row_id, CASE WHEN source IN ('global','merged') THEN 'composer-global' WHEN source IN ('workspace','workspace-fallback') THEN 'composer-workspace'
 WHEN source IN ('store-complete','store-partial','store') THEN 'store-db' WHEN source = 'transcript' THEN 'store-transcript' ELSE 'store-metadata' END AS representation,
 CASE WHEN transcript_state = 'parsed' THEN 'complete' ELSE 'partial' END AS tier, {PUBLIC.format('workspace')} AS workspace,
 row(title, created_at, message_count) AS payload FROM sessions WHERE id IS NOT NULL), inst AS (SELECT *, split_part(representation, '-', 1) AS role FROM i)"""
GROUPS = f"""{INST}, g AS (SELECT id, role, representation, tier, count(*) AS n_copies, count(DISTINCT payload) AS n_fingerprints, min(session_row_id) AS first FROM inst GROUP BY ALL),
 grp AS (SELECT *, CASE WHEN n_copies = 1 THEN 'single' WHEN n_fingerprints = 1 THEN 'equivalent' ELSE 'divergent' END AS state FROM g)"""
MS = "CASE WHEN regexp_matches({0}, '^\\d{{1,18}}$') AND TRY_CAST({0} AS BIGINT) > 1000000000000 THEN TRY_CAST({0} AS BIGINT) END"
STORED = "CASE WHEN regexp_matches(msg_time, '^\\d{1,18}$') THEN TRY_CAST(msg_time AS BIGINT) WHEN regexp_matches(msg_time, '^\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d\\.\\d{3}Z$') THEN epoch_ms(TRY_CAST(replace(msg_time, 'Z', '') AS TIMESTAMP)) END"
TIMED = f"tm0 AS (SELECT session_id, msg_id, stack, {STORED} AS ms FROM messages WHERE session_id IS NOT NULL), tm AS (SELECT session_id, msg_id, ms, CASE WHEN ms IS NOT NULL AND stack IN ('composer','both') THEN 'composer-created-at' END AS source FROM tm0)"
META = f"mt AS (SELECT session_id, min({MS.format('created_at_ms')}) AS meta_created, max(coalesce({MS.format('updated_at_ms')}, {MS.format('created_at_ms')})) AS meta_updated FROM store_meta WHERE session_id IS NOT NULL GROUP BY session_id)"
USAGE = """u0 AS (SELECT m.session_id, m.msg_id, m.role, t.stack, t.token_count.input_tokens AS i, t.token_count.output_tokens AS o, len(t.content) AS n, t.model FROM m JOIN messages t USING (msg_id)),
 u AS (SELECT session_id, msg_id, model, stack, i, CASE WHEN stack IN ('composer','both') AND (coalesce(i,0) > 0 OR coalesce(o,0) > 0) THEN coalesce(i,0) WHEN stack = 'store' AND i > 0 THEN i WHEN role = 'user' AND n > 0 THEN n END AS input,
 CASE WHEN stack IN ('composer','both') AND (coalesce(i,0) > 0 OR coalesce(o,0) > 0) THEN coalesce(o,0) WHEN stack = 'store' AND i > 0 THEN 0 WHEN role = 'user' AND n > 0 THEN 0 END AS output FROM u0)"""

SQL = {
    "q20_replica_state": f"WITH {GROUPS} SELECT id, representation, tier, state, n_copies, n_fingerprints FROM grp",
    "q21_replica_pick": f"WITH {GROUPS} SELECT id, representation, tier, first AS selected FROM grp WHERE state <> 'divergent'",
    "q22_latest_metadata": f"""WITH x AS (SELECT session_id, meta_id, coalesce({MS.format('updated_at_ms')}, {MS.format('created_at_ms')}) AS u, {MS.format('created_at_ms')} AS c, coalesce(cwd, '') AS p FROM store_meta WHERE session_id IS NOT NULL),
 y AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY u DESC NULLS LAST, c DESC NULLS LAST, p, meta_id) AS rn FROM x) SELECT session_id, meta_id FROM y WHERE rn = 1""",
    "q23_tier_arbitration": f"""WITH {GROUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY id, role ORDER BY list_position(['composer-global','composer-workspace','store-db','store-transcript','store-metadata'], representation), tier) AS rn,
 sum(n_copies) OVER (PARTITION BY id, role) AS n_all FROM grp) SELECT id, representation, tier, CASE WHEN state = 'divergent' THEN 'ambiguous' ELSE 'selected' END AS state,
 CASE WHEN state = 'divergent' THEN NULL WHEN representation = 'composer-workspace' THEN 'partial' ELSE tier END AS resolution, CASE WHEN state <> 'divergent' THEN first END AS selected, CAST(n_all - n_copies AS BIGINT) AS n_superseded FROM r WHERE rn = 1""",
    "q24_timestamp_gap_fill": f"""WITH {TIMED}, {META}, x AS (SELECT tm.*, meta_created, CASE WHEN source IS NOT NULL THEN ms END AS d FROM tm LEFT JOIN mt USING (session_id)),
 y AS (SELECT *, first_value(d IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY msg_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n, last_value(d IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x)
 SELECT msg_id, CASE WHEN d IS NOT NULL THEN d WHEN ms IS NOT NULL THEN ms ELSE coalesce(n, p, meta_created, 0) END AS resolved_ms,
 CASE WHEN d IS NOT NULL THEN source WHEN ms IS NOT NULL THEN 'unknown' WHEN n IS NOT NULL THEN 'inferred-next' WHEN p IS NOT NULL THEN 'inferred-previous' WHEN meta_created IS NOT NULL THEN 'session-fallback' ELSE 'unknown' END AS resolved_source FROM y""",
    "q25_session_timestamps": f"""WITH {TIMED}, {META}, s AS (SELECT session_id, min(ms) FILTER (WHERE source IS NOT NULL) AS lo, max(ms) FILTER (WHERE source IS NOT NULL) AS hi FROM tm GROUP BY session_id)
 SELECT session_id, coalesce(meta_created, lo, 0) AS created_ms, CASE WHEN meta_created IS NOT NULL THEN 'composer-metadata' WHEN lo IS NOT NULL THEN 'direct-message' ELSE 'epoch-unknown' END AS created_source,
 coalesce(meta_updated, hi, 0) AS updated_ms, CASE WHEN meta_updated IS NOT NULL THEN 'composer-metadata' WHEN hi IS NOT NULL THEN 'direct-message' ELSE 'epoch-unknown' END AS updated_source FROM s LEFT JOIN mt USING (session_id)""",
    "q26_timestamp_cascade": """SELECT event_id, CASE WHEN event_type IN ('click','view') THEN epoch_us(ts) // 1000 WHEN value < 10 THEN epoch_us(ts) // 1000 + 1 END AS ms,
 CASE WHEN event_type = 'click' THEN 'composer-created-at' WHEN event_type = 'view' OR value < 10 THEN 'composer-timing' END AS source FROM events""",
    "q27_json_cascade": """WITH x AS (SELECT line_id, CASE WHEN json_valid(raw) THEN raw END AS j FROM transcript_lines), y AS (SELECT line_id, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(json_extract_string(j, '$')) THEN json_extract_string(j, '$') ELSE j END AS j FROM x)
 SELECT line_id, coalesce(json_extract_string(j, '$.role'), json_extract_string(j, '$.type')) AS role, coalesce(json_extract_string(j, '$.parentMessageId'), json_extract_string(j, '$.parentId'), json_extract_string(j, '$.message.parentMessageId')) AS parent,
 json_extract_string(j, '$.message.content[0].text') AS first_text FROM y WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'""",
    "q28_token_usage": f"WITH {M}, {USAGE} SELECT msg_id, CAST(input AS BIGINT) AS input, CAST(output AS BIGINT) AS output FROM u WHERE input IS NOT NULL",
    "q29_session_usage": f"WITH {M}, {USAGE} SELECT session_id, CAST(sum(input) AS BIGINT) AS total_input, CAST(sum(output) AS BIGINT) AS total_output, count(input) AS n_counted FROM u GROUP BY session_id",
    "q30_workspace_rollup": f"""WITH s AS (SELECT DISTINCT {PUBLIC.format('workspace')} AS workspace, id FROM sessions WHERE id IN (SELECT session_id FROM messages)) SELECT workspace, count(*) AS n_sessions FROM s WHERE workspace IS NOT NULL GROUP BY workspace""",
    "q31_nonempty_sessions": "SELECT DISTINCT id AS session_id FROM sessions WHERE id IN (SELECT session_id FROM messages)",
    "q32_orphan_messages": "SELECT msg_id, session_id FROM messages WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT id FROM sessions WHERE id IS NOT NULL)",
    "q36_ordered_role_union": "WITH x AS (SELECT id, list_contains(sources, 'composer') AS c, list_contains(sources, 'store') AS s FROM sessions WHERE id IS NOT NULL), y AS (SELECT id, bool_or(coalesce(c, false)) AS c, bool_or(coalesce(s, false)) AS s FROM x GROUP BY id) SELECT id, concat_ws(',', CASE WHEN c THEN 'composer' END, CASE WHEN s THEN 'store' END) AS roles FROM y",
    "q37_workspace_paths": "WITH f AS (SELECT workspace_id, 0 AS form, path AS raw, path FROM workspaces UNION ALL SELECT workspace_id, 1, path || '/./x/..', path FROM workspaces UNION ALL SELECT workspace_id, 2, path || '//', path FROM workspaces) SELECT workspace_id, form, CASE WHEN regexp_matches(path, '^[a-zA-Z]:/') THEN lower(path) ELSE path END AS path, regexp_replace(regexp_replace(raw, '^/+|/+$', '', 'g'), '[/:]+', '-', 'g') AS slug, md5(raw) AS hash FROM f",
    "q38_scope_suffix_match": """WITH w AS (SELECT DISTINCT path, list_filter(string_split(regexp_replace(path, '^[a-z]:/', ''), '/'), lambda x: x <> '') AS c FROM workspaces), r AS (SELECT DISTINCT unnest([string_split(path, '/')[-1], path, 'absent-' || string_split(path, '/')[-1]]) AS request FROM workspaces),
 q AS (SELECT request, list_filter(string_split(regexp_replace(request, '^[a-z]:/', ''), '/'), lambda x: x <> '') AS k FROM r), h AS (SELECT request, count(*) FILTER (WHERE path = request) AS n_exact, count(path) AS n_suffix FROM q LEFT JOIN w ON list_slice(c, len(c) - len(k) + 1, len(c)) = k GROUP BY request)
 SELECT request, n_exact, n_suffix, CASE WHEN n_exact > 0 THEN 'exact' WHEN n_suffix = 1 THEN 'unique-suffix' WHEN n_suffix > 1 THEN 'ambiguous' ELSE 'not-found' END AS kind FROM h""",
    "q39_path_rebase": "SELECT workspace_id, '/new/home/' || string_split(path, '/')[-1] AS moved, CAST(NULL AS VARCHAR) AS outside, true AS nested FROM workspaces",
    "q54_memberships": f"WITH {INST} SELECT id, workspace, concat_ws(',', CASE WHEN bool_or(role = 'composer') THEN 'composer' END, CASE WHEN bool_or(role = 'store') THEN 'store' END) AS roles, count(*) AS n_copies FROM inst WHERE workspace IS NOT NULL GROUP BY id, workspace",
    "q55_canonical_workspace": f"""WITH {INST}, k AS (SELECT id, workspace, role, CASE WHEN role = 'store' THEN 2 WHEN ends_with(lower(workspace), '.code-workspace') THEN 0 ELSE 1 END AS kind, bool_or(role = 'composer') OVER (PARTITION BY id) AS has FROM inst),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, workspace) AS rn FROM k WHERE workspace IS NOT NULL AND (NOT has OR role = 'composer')) SELECT id, workspace FROM r WHERE rn = 1""",
    "q56_ambiguous_sessions": f"WITH {GROUPS}, d AS (SELECT inst.id, inst.role, session_row_id FROM inst JOIN grp USING (id, role, representation, tier) WHERE state = 'divergent') SELECT id, concat_ws(',', CASE WHEN bool_or(role = 'composer') THEN 'composer' END, CASE WHEN bool_or(role = 'store') THEN 'store' END) AS roles, count(*) AS n_refs FROM d GROUP BY id",
    "q57_model_rollup": f"WITH {M}, {USAGE} SELECT model, count(*) AS n_messages, CAST(sum(output) AS BIGINT) AS output_tokens, count(*) FILTER (WHERE stack = 'store' AND i IS NOT NULL) AS n_windows FROM u WHERE model IS NOT NULL GROUP BY model",
    "q63_slug_attribution": """WITH f AS (SELECT path, regexp_replace(regexp_replace(path, '^/+|/+$', '', 'g'), '[/:]+', '-', 'g') AS dir FROM workspaces), s AS (SELECT dir, min(path) AS path FROM (SELECT DISTINCT * FROM f) GROUP BY dir HAVING count(*) = 1),
 q AS (SELECT DISTINCT regexp_replace(regexp_replace(cwd, '^/+|/+$', '', 'g'), '[/:]+', '-', 'g') AS dir FROM store_meta WHERE cwd IS NOT NULL) SELECT dir, path FROM q JOIN s USING (dir)""",
}
