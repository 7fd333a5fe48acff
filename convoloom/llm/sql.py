"""SQL twins of those queries of this package that SQL can say."""

from convoloom.plans.sql_messages import SP
from convoloom.plans.sql_problems import instants

_STATES = "['parsed','partial','empty','error-only','unsupported','unreadable','missing']"
_COPIES = "SELECT session_row_id, 'c' AS what, created_at AS v, tz FROM sessions JOIN workspaces USING (workspace_id) UNION ALL SELECT session_row_id, 'm', metadata.last_modified, tz FROM sessions JOIN workspaces USING (workspace_id)"
_USERS, _ASSISTANTS = "('user','human','1','usr','person','prompter')", "('assistant','ai','model','2','bot','asst','gpt','agent')"


def without_blanks(c: str) -> str:
    return "regexp_replace(" + c + ", '" + SP + "+', '', 'g')"


SQL = {
    "p4_found": f"""WITH {instants(_COPIES)}, s AS (SELECT id, session_row_id, list_position({_STATES}, lower({without_blanks("coalesce(transcript_state, 'missing')")})) AS r1, -coalesce(len(list_distinct(sources)), 0) AS r2,
 CASE preferred_source WHEN 'composer' THEN 0 WHEN 'store' THEN 1 ELSE 2 END AS r3, title, workspace, message_count, count(*) OVER (PARTITION BY id) AS n FROM sessions WHERE id IS NOT NULL),
 x AS (SELECT s.*, c.ms AS created, m.ms AS modified FROM s JOIN (SELECT * FROM tm WHERE what = 'c') c USING (session_row_id) JOIN (SELECT * FROM tm WHERE what = 'm') m USING (session_row_id) WHERE n > 1),
 v AS (SELECT *, 'title' AS field, {without_blanks("title")} <> '' AS ok FROM x UNION ALL SELECT *, 'workspace', {without_blanks("workspace")} <> '' FROM x UNION ALL SELECT *, 'created_at', created IS NOT NULL FROM x UNION ALL SELECT *, 'message_count', message_count IS NOT NULL FROM x),
 r AS (SELECT *, row_number() OVER (PARTITION BY id, field ORDER BY r1, r2, r3, modified DESC NULLS LAST, session_row_id) AS rn FROM v WHERE ok) SELECT id, field, session_row_id FROM r WHERE rn = 1""",
    "p5_found": f"""WITH RECURSIVE {instants("SELECT msg_id, msg_time AS v, tz FROM messages JOIN workspaces USING (workspace_id)")}, d AS (SELECT m.*, tm.ms, row_number() OVER (PARTITION BY session_id, CASE WHEN coalesce(message_key, '') = '' THEN '#' || msg_id ELSE 'k' || message_key END ORDER BY m.msg_id) AS dup FROM messages m JOIN tm USING (msg_id) WHERE session_id IS NOT NULL),
 e AS (SELECT session_id, msg_id, nullif(message_key, '') AS message_key, parent_key, ms, content, lower({without_blanks("role")}) AS r FROM d WHERE dup = 1),
 o AS (SELECT session_id, msg_id, message_key, ms AS a, msg_id AS i, CAST([] AS BIGINT[]) AS path FROM e WHERE ms IS NOT NULL UNION ALL SELECT e.session_id, e.msg_id, e.message_key, o.a, o.i, list_append(o.path, e.msg_id) FROM e JOIN o ON e.session_id = o.session_id AND e.parent_key = o.message_key WHERE e.ms IS NULL),
 l AS (SELECT DISTINCT id AS session_id, unnest(active_branch_bubble_ids) AS message_key FROM sessions), hl AS (SELECT DISTINCT session_id FROM l),
 k AS (SELECT e.*, o.a, o.i, o.path FROM e JOIN o USING (session_id, msg_id) LEFT JOIN l ON l.session_id = e.session_id AND l.message_key = e.message_key LEFT JOIN hl ON hl.session_id = e.session_id
  WHERE {without_blanks("coalesce(content, '')")} <> '' AND (e.message_key IS NULL OR hl.session_id IS NULL OR l.message_key IS NOT NULL)),
 w AS (SELECT *, CASE WHEN r IN {_USERS} THEN 1 WHEN r IN {_ASSISTANTS} THEN 2 ELSE 0 END AS who, row_number() OVER ord AS pos FROM k WINDOW ord AS (PARTITION BY session_id ORDER BY a, i, path)),
 g AS (SELECT *, lead(who) OVER (PARTITION BY session_id ORDER BY pos) AS nxt FROM w), bad AS (SELECT DISTINCT session_id FROM g WHERE who = 0 OR pos = 1 AND who = 2 OR who = 1 AND coalesce(nxt, 1) = 1 UNION SELECT l.session_id FROM l ANTI JOIN e ON e.session_id = l.session_id AND e.message_key = l.message_key)
 SELECT session_id, CAST(pos AS INT) AS pos, msg_id FROM w WHERE session_id NOT IN (SELECT session_id FROM bad)""",
}
SQL["p5_conversations"] = f"WITH kept AS ({SQL['p5_found']}) SELECT kept.session_id, pos, msg_id, CASE WHEN lower({without_blanks('role')}) IN {_USERS} THEN 'user' ELSE 'assistant' END AS speaker, content FROM kept JOIN messages USING (msg_id)"
