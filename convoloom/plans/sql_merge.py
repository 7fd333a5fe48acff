"""SQL twins of the queries over joins of two sides."""

from convoloom.plans.sql_messages import M
from convoloom.plans.sql_sessions import INST, META, TIMED

SQL = {
    "q33_last_result": """WITH r AS (SELECT l_orderkey, count(*) AS n, arg_max(l_partkey, row(l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity) AS BIGINT))) AS result FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, coalesce(n, 0) AS n_results, result FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""",
    "q34_range_join": f"WITH {TIMED}, {META} SELECT tm.session_id, msg_id, ms FROM tm JOIN mt USING (session_id) WHERE ms IS NOT NULL AND (meta_created IS NULL OR ms >= meta_created) AND (meta_updated IS NULL OR ms <= meta_updated + 60000)",
    "q35_summary_merge": f"""WITH {INST}, f AS (SELECT id, role, min(session_row_id) AS r FROM inst GROUP BY id, role), x AS (SELECT f.id, f.role, title, message_count FROM f JOIN sessions s ON s.session_row_id = f.r), c AS (SELECT * FROM x WHERE role = 'composer'), s AS (SELECT * FROM x WHERE role = 'store')
 SELECT coalesce(c.id, s.id) AS id, CASE WHEN len(c.title) > 0 THEN c.title ELSE s.title END AS title, coalesce(c.message_count, s.message_count) AS message_count, concat_ws(',', c.role, s.role) AS sources FROM c FULL JOIN s ON c.id = s.id""",
    "q45_lcs_align": f"WITH {M} SELECT session_id, msg_id FROM m WHERE stack = 'both'",
}
