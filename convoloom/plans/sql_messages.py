"""SQL twins of the queries over messages, listing and search."""

M = """m AS (SELECT session_id, msg_id, CASE WHEN lower(role) IN ('assistant','ai','bot','system') THEN 'assistant' ELSE 'user' END AS role,
 role AS raw_role, content, stack, message_key, epoch_ms(received_at) AS received_ms FROM messages WHERE session_id IS NOT NULL)"""
CAT = "cat AS (SELECT session_id, min(received_ms) AS created_ms, min(msg_id) FILTER (WHERE stack IN ('composer','both')) AS composer_order FROM m GROUP BY session_id)"
SP = r"[\t\n\x0b\x0c\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
Q = "the error"
FOUND = f"""f AS (SELECT *, list_filter(list_transform(range(1, len(content) - {len(Q)} + 2), lambda i: CASE WHEN substring(lower(content), i, {len(Q)}) = '{Q}' THEN i - 1 END), lambda x: x IS NOT NULL) AS positions
 FROM m WHERE contains(lower(content), '{Q}'))"""
SNIP = f"""s AS (SELECT *, greatest(0, positions[1] - 50) AS a, least(len(content), positions[1] + {len(Q)} + 50) AS b FROM f),
t AS (SELECT *, CASE WHEN a > 0 THEN '...' ELSE '' END || substring(content, CAST(a AS INT) + 1, CAST(b - a AS INT)) || CASE WHEN b < len(content) THEN '...' ELSE '' END AS text,
 list_transform(list_filter(positions, lambda p: p >= a AND p + {len(Q)} <= b), lambda p: p - a + CASE WHEN a > 0 THEN 3 ELSE 0 END) AS inside FROM s)"""
TYPED = """ty AS (SELECT msg_id, CASE WHEN role = 'user' THEN 'user' WHEN starts_with(coalesce(content,''), '[Tool:') THEN 'tool' WHEN starts_with(coalesce(content,''), '[Thinking]') THEN 'thinking'
 WHEN starts_with(coalesce(content,''), '[Error]') THEN 'error' WHEN stack = 'store' AND contains(content, '[Tool:') THEN 'tool' ELSE 'assistant' END AS type FROM m)"""

SQL = {
    "q01_session_summary": f"""WITH {M}, h AS (SELECT session_id, count(*) AS n_messages, arg_min(content, msg_id) FILTER (WHERE role = 'user' AND content IS NOT NULL) AS ut0,
 arg_min(struct_pack(c := content), msg_id) FILTER (WHERE role = 'user') AS us, arg_min(struct_pack(c := content), msg_id) AS fs FROM m GROUP BY session_id),
 u AS (SELECT session_id, n_messages, us.c AS ut, fs.c AS ft, split_part(us.c, chr(10), 1) AS line,
 regexp_replace(regexp_replace(regexp_replace(us.c, '(?s)```.*?```', '[code]', 'g'), '\\n+', ' ', 'g'), '^{SP}+|{SP}+$', '', 'g') AS p FROM h)
 SELECT session_id, n_messages, CASE WHEN len(line) = 0 THEN NULL WHEN len(line) <= 50 THEN line ELSE substring(line, 1, 47) || '...' END AS title,
 coalesce(CASE WHEN len(p) <= 100 THEN p ELSE substring(p, 1, 97) || '...' END, '') AS preview, coalesce(substring(ft, 1, 100), '(Empty session)') AS listing_preview FROM u""",
    "q02_catalog_index": f"WITH {M}, {CAT} SELECT session_id, created_ms, row_number() OVER (ORDER BY created_ms DESC, composer_order ASC NULLS LAST, session_id) AS index FROM cat",
    "q03_list_limit": f"WITH {M}, {CAT} SELECT session_id, created_ms FROM cat ORDER BY created_ms DESC, composer_order ASC NULLS LAST, session_id LIMIT 20",
    "q04_page": f"WITH {M}, {CAT}, p AS (SELECT session_id FROM cat ORDER BY created_ms DESC, composer_order ASC NULLS LAST, session_id LIMIT 25 OFFSET 50), n AS (SELECT count(*) AS total FROM cat) SELECT p.session_id, n.total, n.total > 75 AS has_more FROM p, n",
    "q05_message_type": f"WITH {M}, {TYPED} SELECT type, count(*) AS n FROM ty GROUP BY type",
    "q06_message_filter": f"WITH {M}, {TYPED} SELECT msg_id, type FROM ty WHERE type IN ('tool','user')",
    "q07_role_normalize": f"WITH {M} SELECT msg_id, role FROM m",
    "q08_store_roles": f"WITH {M} SELECT msg_id, raw_role AS role FROM m WHERE raw_role IN ('user','assistant')",
    "q10_search_positions": f"WITH {M}, {FOUND} SELECT msg_id, CAST(generate_subscripts(positions, 1) - 1 AS INT) AS match_no, CAST(unnest(positions) AS INT) AS position FROM f",
    "q11_search_snippets": f"WITH {M}, {FOUND}, {SNIP} SELECT msg_id, role, CAST(len(positions) AS INT) AS n_matches, text, CAST(len(inside) AS INT) AS n_inside, CAST(inside[1] AS INT) AS first_inside FROM t",
    "q12_search_topk": f"WITH {M}, {CAT}, {FOUND}, {SNIP}, c AS (SELECT session_id, CAST(sum(len(inside)) AS BIGINT) AS match_count, count(*) AS n_snippets FROM t GROUP BY session_id) SELECT session_id, match_count, n_snippets, created_ms FROM c JOIN cat USING (session_id) ORDER BY match_count DESC, created_ms DESC, composer_order ASC NULLS LAST, session_id LIMIT 10",
    "q13_search_line_context": f"""WITH {M}, {FOUND}, l AS (SELECT msg_id, len(substring(content, 1, CAST(positions[1] AS INT))) - len(replace(substring(content, 1, CAST(positions[1] AS INT)), chr(10), '')) AS no,
 list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '\\r$', '')) AS ls FROM f)
 SELECT msg_id, CAST(no AS INT) AS line_no, ls[no + 1] AS line, CASE WHEN no > 0 THEN ls[no] END AS before, ls[no + 2] AS after FROM l""",
    "q14_code_blocks": f"""WITH {M}, x AS (SELECT msg_id, content, regexp_extract_all(content, '(?m)^```(\\w*)\\n((?s:.*?))^```', 1) AS langs, regexp_extract_all(content, '(?m)^```(\\w*)\\n((?s:.*?))^```', 2) AS bodies,
 string_split(regexp_replace(content, '(?m)^```(\\w*)\\n((?s:.*?))^```', chr(1), 'g'), chr(1)) AS outs FROM m WHERE contains(content, '```')),
 y AS (SELECT msg_id, unnest(range(1, len(bodies) + 1)) AS i, langs, bodies, outs FROM x)
 SELECT msg_id, CAST(i - 1 AS INT) AS block_no, CASE WHEN langs[i] <> '' THEN langs[i] END AS language, regexp_replace(bodies[i], '{SP}+$', '') AS content,
 CAST(coalesce(list_sum(list_transform(outs[1:i], lambda o: len(o) - len(replace(o, chr(10), '')))), 0) + coalesce(list_sum(list_transform(bodies[1:i-1], lambda o: len(o) - len(replace(o, chr(10), '')) + 1)), 0) AS INT) AS start_line FROM y""",
    "q15_normalize_text": f"""WITH {M}, u AS (SELECT msg_id, content, CASE WHEN regexp_matches(content, '(?is)^{SP}*<user_query>{SP}*(.*?){SP}*</user_query>{SP}*$') THEN regexp_extract(content, '(?is)^{SP}*<user_query>{SP}*(.*?){SP}*</user_query>{SP}*$', 1) ELSE content END AS t FROM m)
 SELECT msg_id, trim(regexp_replace(t, '{SP}+', ' ', 'g')) AS text, CASE WHEN content = '[corrupted message]' THEN 'corrupt' WHEN content = '' OR content = '[empty message]' OR content IS NULL THEN 'empty' ELSE 'real' END AS class FROM u""",
    "q16_composer_ids": f"WITH {M} SELECT msg_id, coalesce(nullif(message_key, ''), 'msg:' || CAST(row_number() OVER (PARTITION BY session_id ORDER BY msg_id) - 1 AS VARCHAR)) AS message_id FROM m",
    "q17_store_ids": "SELECT doc_id, 'store:v1:db:' || sha256(text) || ':' || CAST(row_number() OVER (PARTITION BY coalesce(source, ''), text ORDER BY doc_id) AS VARCHAR) AS store_id FROM documents WHERE text IS NOT NULL",
    "q18_parent_chain": f"WITH {M} SELECT msg_id, lag(msg_id) OVER (PARTITION BY session_id ORDER BY msg_id) AS parent_id FROM m",
    "q19_active_branch": f"""WITH {M}, l AS (SELECT DISTINCT id AS session_id, unnest(active_branch_bubble_ids) AS message_key FROM sessions),
 k AS (SELECT m.session_id, msg_id FROM m SEMI JOIN (SELECT * FROM l WHERE message_key <> '') l USING (session_id, message_key)) SELECT session_id, msg_id, lag(msg_id) OVER (PARTITION BY session_id ORDER BY msg_id) AS parent_id FROM k""",
    "q65_search_utf16": f"WITH {M}, {FOUND}, p AS (SELECT msg_id, content, unnest(positions) AS p FROM f), u AS (SELECT msg_id, p + len(regexp_replace(substring(content, 1, CAST(p AS INT)), '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')) AS start FROM p) SELECT msg_id, CAST(start AS INT) AS start, CAST(start + {len(Q)} AS INT) AS \"end\" FROM u",
}
SQL["q09_derive_title"] = f"SELECT session_id, title FROM ({SQL['q01_session_summary']})"
