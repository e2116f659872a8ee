"""Operators whose plan is plain SQL: one text that Spark runs and that is its own oracle text.

Soft deletion, status and roles are columns of the driver's tables: a document is deleted where its
label is toxic, completed where its quality is 1; an order is a document of its owner; events are
searches, logs and metric samples; conversations are question sessions. Every order has a unique
tie-break, every page is deterministic, and times are anchored at the latest event.
"""

from __future__ import annotations

LIVE = "SELECT d.* FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) x ON d.doc_id = x.doc_id WHERE x.doc_id IS NULL"
ANCHOR = "(SELECT MAX(ts) FROM events)"
FAILED = """
SELECT 'document' AS task_type, d.doc_id AS task_id, d.source, CAST(NULL AS BIGINT) AS parent_id, d.n_chars AS size
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0
UNION ALL
SELECT 'order', o.o_orderkey, o.o_orderpriority, o.o_custkey, CAST(NULL AS BIGINT)
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F'
"""

PORTABLE: dict[str, str] = {
    # Sources and row operations
    "A01_scan_page": f"SELECT doc_id, lang, source, n_chars FROM ({LIVE}) v WHERE lang = 'en' ORDER BY doc_id LIMIT 50 OFFSET 50",
    "A02_point_lookup": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey = 42",
    "A03_update_overlay": """
        SELECT d.doc_id, COALESCE(CASE WHEN l.quality = 0 THEN 'rejected' END, d.lang) AS lang, d.source,
               COALESCE(l.toxic, 0) = 1 AS is_deleted
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "A19_delete_by_query": "SELECT e.vec_id, e.label FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id AND l.toxic = 1 WHERE l.doc_id IS NULL",
    "A29_chunk_fetch": "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 10000",
    "A30_content_addressed": """
        SELECT hash, doc_id FROM (
          SELECT md5(text) AS hash, doc_id, ROW_NUMBER() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents
        ) v WHERE rn = 1""",
    # Filters
    "B02_kb_scope": "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src4', 'src7')",
    "B03_category_filter": "SELECT doc_id, lang FROM documents WHERE lang = 'fr'",
    "B05_exclude_self": "SELECT vec_id, label FROM embeddings WHERE vec_id <> 7",
    "B06_soft_delete": f"SELECT doc_id, source FROM ({LIVE}) v",
    "B07_time_range": "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-06 00:00:00'",
    "B08_event_filter": "SELECT event_id, user_id, event_type FROM events WHERE user_id < 40 AND event_type = 'error' ORDER BY ts DESC, event_id LIMIT 1000",
    "B09_period_filter": f"SELECT event_type, COUNT(*) AS n FROM events WHERE ts >= {ANCHOR} - INTERVAL '7' DAY GROUP BY event_type",
    "B12_citation_projection": """
        SELECT doc_id, COALESCE(source, 'untitled') AS title,
               CASE WHEN LENGTH(text) > 200 THEN SUBSTRING(text, 1, 200) || '...' ELSE text END AS snippet
        FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10""",
    "B14_permission": """
        WITH role_actions AS (
          SELECT * FROM (VALUES ('system', 'kb:view'), ('system', 'kb:edit'), ('system', 'doc:view'), ('system', 'doc:delete'),
            ('assistant', 'kb:view'), ('assistant', 'doc:view'), ('assistant', 'doc:edit'), ('user', 'kb:view'), ('user', 'doc:view')) AS t(role, action)
        ) SELECT c.conv_id, c.turn, a.action FROM conversations c JOIN role_actions a ON c.role = a.role""",
    "B17_retry_eligibility": f"SELECT event_id, value < 50 AND ts < {ANCHOR} - INTERVAL '60' MINUTE AS eligible FROM events WHERE event_type = 'error'",
    "B18_login_lockout": """
        SELECT user_id, event_id, fails, fails >= 5 AS locked FROM (
          SELECT user_id, event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS fails
          FROM events WHERE event_type = 'error') v""",
    "B21_valid_answer": """
        SELECT conv_id, MAX(CASE WHEN LENGTH(TRIM(text)) > 10 AND LOWER(text) NOT LIKE '%sorry%' THEN 1 ELSE 0 END) AS has_valid FROM (
          SELECT conv_id, text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'assistant'
        ) v WHERE rn <= 10 GROUP BY conv_id""",
    "B22_missing_type": "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE COALESCE(CAST(l.quality AS VARCHAR(9)), '') IN ('', 'unknown')",
    "B24_conflict": "SELECT d.doc_id, COALESCE(CASE l.quality WHEN 1 THEN 'idle' WHEN 0 THEN 'busy' END, 'idle') <> 'idle' AS conflict FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "B25_document_list": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND (o_custkey = 10 OR o_custkey IS NULL) ORDER BY o_orderkey LIMIT 100",
    "B26_delete_guard": """
        SELECT n.n_nationkey, COUNT(c.c_custkey) AS n_children, COUNT(c.c_custkey) > 0 AS blocked
        FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey""",
    # Joins
    "C01_members_users": "SELECT s.s_suppkey, s.s_name, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey",
    "C02_images_documents": f"SELECT e.vec_id, e.label, v.source FROM embeddings e JOIN ({LIVE}) v ON e.vec_id = v.doc_id",
    "C03_failure_join": "SELECT e.vec_id, d.source FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE e.label = 0",
    "C04_qa_sessions": "SELECT a.conv_id, a.turn AS q_turn, b.turn AS a_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'",
    "C05_kb_category": "SELECT c.c_custkey, c.c_name, n.n_name AS category FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1",
    "C06_owner_or_member": """
        SELECT c.c_custkey, o.o_orderkey FROM customer c
        LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'
        WHERE c.c_nationkey = 3 OR o.o_orderkey IS NOT NULL""",
    "C07_counts_per_kb": """
        SELECT c.c_custkey, COALESCE(a.n, 0) AS n_docs, COALESCE(b.n, 0) AS n_done FROM customer c
        LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) a ON a.o_custkey = c.c_custkey
        LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) b ON b.o_custkey = c.c_custkey""",
    "C08_semi_join": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "C09_semi_chained": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5))",
    "C10_anti_join": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "C11_merge_ranked": """
        SELECT COALESCE(a.user_id, b.user_id) AS user_id, COALESCE(a.n, 0) AS clicks, COALESCE(b.n, 0) AS errors FROM
        (SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) a FULL OUTER JOIN
        (SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id) b ON a.user_id = b.user_id""",
    "C12_merge_images": """
        SELECT user_id, ROUND(MAX(a), 4) AS best_click, ROUND(MAX(b), 4) AS best_view, COUNT(DISTINCT kind) AS kinds FROM (
          SELECT user_id, value AS a, CAST(NULL AS DOUBLE) AS b, 'click' AS kind FROM events WHERE event_type = 'click'
          UNION ALL SELECT user_id, NULL, value, 'view' FROM events WHERE event_type = 'view') v GROUP BY user_id""",
    "C15_nearest_in_kb": """
        SELECT o_orderkey, near_key FROM (
          SELECT o.o_orderkey, l.l_linenumber AS near_key, ROW_NUMBER() OVER (PARTITION BY o.o_orderkey ORDER BY ABS(l.l_linenumber - 3), l.l_linenumber) AS rn
          FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey) v WHERE rn = 1""",
    "C16_self_join_versions": "SELECT a.conv_id, LENGTH(b.text) - LENGTH(a.text) AS delta FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id WHERE a.turn = 0 AND b.turn = 1",
    "C18_map_enrichment": "SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey",
    "C20_cooccurrence": """
        WITH t AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS tag FROM lineitem)
        SELECT tag, n FROM (SELECT b.tag, COUNT(*) AS n FROM t a JOIN t b ON a.k = b.k WHERE a.tag = 7 AND b.tag <> 7 GROUP BY b.tag) v
        ORDER BY n DESC, tag LIMIT 5""",
    "C24_archive_lookup": "SELECT d.doc_id, COALESCE(NULLIF(TRIM(d.text), ''), c.text) AS content FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id AND c.turn = 0",
    "C25_latest_version": """
        SELECT d.doc_id, COALESCE(GREATEST(v.latest, 1), 1) AS version FROM documents d
        LEFT JOIN (SELECT conv_id, MAX(turn) AS latest FROM conversations GROUP BY conv_id) v ON v.conv_id = d.doc_id""",
    "C26_cascading_delete": "SELECT l.l_orderkey, l.l_linenumber FROM lineitem l LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_custkey = 7) g ON l.l_orderkey = g.o_orderkey WHERE g.o_orderkey IS NULL",
    # Aggregation
    "F01_count": "SELECT COUNT(*) AS n FROM documents",
    "F02_count_distinct_outer": "SELECT COUNT(DISTINCT c.c_custkey) AS n_kb, COUNT(DISTINCT o.o_custkey) AS n_used FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey",
    "F03_group_count": "SELECT source, COUNT(*) AS n FROM documents GROUP BY source",
    "F04_filtered_count": "SELECT d.source, COUNT(*) FILTER (WHERE l.quality = 1) AS n_done FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source",
    "F05_sum": "SELECT COALESCE(CAST(SUM(turn) AS BIGINT), 0) AS total FROM conversations WHERE role = 'user'",
    "F06_next_version": "SELECT conv_id, MAX(turn) + 1 AS next_version FROM conversations GROUP BY conv_id",
    "F07_histogram": "SELECT COALESCE(CAST(l.quality AS VARCHAR(9)), 'unknown') AS kind, COUNT(*) AS n, CAST(SUM(d.n_chars) AS BIGINT) AS bytes FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1",
    "F08_histogram_lower": "SELECT LOWER(c_mktsegment) AS kind, COUNT(*) AS n FROM customer GROUP BY 1",
    "F09_tag_usage": "SELECT l_returnflag || l_linestatus AS tag, COUNT(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, tag LIMIT 20",
    "F11_growth": """
        WITH d AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1),
        e AS (SELECT MIN_BY(n, day) AS first_n, MAX_BY(n, day) AS last_n FROM d)
        SELECT ROUND(g, 2) AS growth, CASE WHEN g > 5 THEN 'increasing' WHEN g < -5 THEN 'decreasing' ELSE 'stable' END AS trend
        FROM (SELECT CASE WHEN first_n > 0 THEN (last_n - first_n) * 100.0E0 / first_n WHEN last_n > 0 THEN 100.0E0 ELSE 0.0E0 END AS g FROM e) v""",
    "F12_heatmap": """
        SELECT c.c_custkey, COALESCE(s.n, 0) AS searches, COALESCE(o.n, 0) AS docs, s.last_ts FROM customer c
        LEFT JOIN (SELECT user_id, COUNT(*) AS n, MAX(ts) AS last_ts FROM events GROUP BY user_id) s ON s.user_id = c.c_custkey
        LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""",
    "F13_hot_words": "SELECT TRIM(event_type) AS word, COUNT(*) AS n, MAX(ts) AS last_ts FROM events GROUP BY 1",
    "F14_hot_words_read": f"SELECT event_type, COUNT(*) AS n FROM events WHERE ts >= {ANCHOR} - INTERVAL '7' DAY GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3",
    "F15_batch_rollup": """
        SELECT o_custkey, total, failed, CASE WHEN done >= total AND failed = 0 THEN 'completed' WHEN done >= total AND good > 0 THEN 'completed_with_errors'
          WHEN done >= total THEN 'failed' WHEN done > 0 THEN 'processing' ELSE 'pending' END AS status
        FROM (SELECT o_custkey, COUNT(*) AS total, COUNT(*) FILTER (WHERE o_orderstatus <> 'O') AS done,
          COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS failed, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS good FROM orders GROUP BY o_custkey) v""",
    "F16_log_levels": "SELECT COALESCE(LOWER(event_type), 'unknown') AS level, COUNT(*) AS n FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 500) v GROUP BY 1",
    "F17_metric_summary": """
        SELECT user_id, ROUND(MAX(value), 4) AS max_value, ROUND(AVG(value), 4) AS avg_value,
          CASE WHEN MAX(value) > 80 THEN 'abnormal' WHEN MAX(value) > 60 THEN 'high' ELSE 'normal' END AS state FROM events GROUP BY user_id""",
    "F18_log_error_counts": "SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'error') AS errors, COUNT(*) FILTER (WHERE event_type <> 'error' AND event_type LIKE '%click%') AS warnings FROM events GROUP BY user_id",
    "F19_severity_counts": "SELECT COUNT(*) FILTER (WHERE value > 90) AS critical, COUNT(*) FILTER (WHERE value > 70 AND value <= 90) AS warning, COUNT(*) FILTER (WHERE value <= 70) AS other FROM events",
    "F20_answered_page": "SELECT COUNT(*) FILTER (WHERE role = 'assistant') AS answered, COUNT(*) FILTER (WHERE role <> 'assistant') AS unanswered FROM (SELECT role FROM conversations ORDER BY conv_id, turn LIMIT 50) v",
    "F21_child_count": "SELECT n.n_nationkey, n.n_name, COUNT(c.c_custkey) AS n FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey, n.n_name",
    "F22_size_class": "SELECT conv_id, CASE WHEN COUNT(*) <= 5 THEN 'small' WHEN COUNT(*) <= 20 THEN 'medium' ELSE 'large' END AS size_class FROM conversations GROUP BY conv_id",
    "F23_health_score": """
        SELECT user_id, ROUND(s, 4) AS score, CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 60 THEN 'good' WHEN s >= 40 THEN 'fair' ELSE 'poor' END AS label FROM (
          SELECT user_id, 0.3E0 * (100 - AVG(value)) + 0.3E0 * (100 - MIN(value)) + 0.2E0 * (100 - MAX(value)) + 0.2E0 * 100 AS s FROM events GROUP BY user_id) v""",
    "F24_rate": """
        SELECT user_id, ROUND(SUM(CASE WHEN value < prev THEN value ELSE value - prev END) / 2592000.0E0, 9) AS rate FROM (
          SELECT user_id, value, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) v WHERE prev IS NOT NULL GROUP BY user_id""",
    "F25_max_by_instance": "SELECT user_id AS instance, ROUND(MAX(value), 4) AS peak FROM events GROUP BY user_id",
    "F26_search_statistics": "SELECT COUNT(*) AS total, CAST(CEIL(COUNT(*) / 20.0E0) AS BIGINT) AS pages FROM conversations WHERE LOWER(text) LIKE '%the%'",
    "F27_period_compare": f"""
        SELECT user_id, ROUND(p1 - p2, 4) AS diff, CASE WHEN p2 <> 0 THEN ROUND((p1 - p2) / p2 * 100, 2) END AS pct FROM (
          SELECT user_id, AVG(CASE WHEN ts > {ANCHOR} - INTERVAL '24' HOUR THEN value END) AS p1,
            AVG(CASE WHEN ts <= {ANCHOR} - INTERVAL '24' HOUR AND ts > {ANCHOR} - INTERVAL '48' HOUR THEN value END) AS p2 FROM events GROUP BY user_id) v""",
    "F28_key_points": "SELECT event_type, ROUND(MAX(value), 4) AS max_value, ROUND(AVG(value), 4) AS avg_value, COUNT(*) AS n FROM events GROUP BY event_type",
    # Order, windows, sets, hierarchy
    "G01_newest_page": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20",
    "G02_page_envelope": "SELECT total, CAST(CEIL(total / 20.0E0) AS BIGINT) AS pages, 3 * 20 < total AS has_next, 3 > 1 AS has_prev FROM (SELECT COUNT(*) AS total FROM orders) v",
    "G03_filter_then_page": "SELECT c_custkey, (SELECT COUNT(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS total FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20",
    "G04_latest_per_key": "SELECT user_id, event_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) v WHERE rn = 1",
    "G05_latest_version": "SELECT conv_id, MAX_BY(role, turn) AS role, MAX(turn) AS version FROM conversations GROUP BY conv_id",
    "G06_previous_version": "SELECT conv_id, turn, LAG(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_version FROM conversations",
    "G07_top_k": "SELECT event_id, ROUND(value, 6) AS score FROM events ORDER BY value DESC, event_id LIMIT 25",
    "G08_distinct_ordered": "SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL ORDER BY c_mktsegment",
    "G09_union_all": "SELECT c_custkey AS kb FROM customer WHERE c_nationkey = 3 UNION ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "G10_failure_view": FAILED,
    "G12_failure_queue": f"SELECT task_type, task_id, source FROM ({FAILED}) v WHERE task_type = 'order' ORDER BY task_id DESC LIMIT 20",
    "G13_retry_queue": "SELECT event_id, ts FROM events WHERE event_type = 'error' AND value < 50 ORDER BY ts, event_id LIMIT 10",
    "G14_neighbour_window": "SELECT conv_id, turn, COUNT(*) OVER w AS near, CAST(SUM(LENGTH(text)) OVER w AS BIGINT) AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "G15_log_context": """
        SELECT user_id, event_id, near FROM (
          SELECT user_id, event_id, MAX(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near
          FROM events) v WHERE near = 1""",
    "G16_category_tree": """
        WITH RECURSIVE edges AS (
          SELECT 'r' || CAST(r_regionkey AS VARCHAR(9)) AS id, CAST(NULL AS VARCHAR(9)) AS parent FROM region
          UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR(9)), 'r' || CAST(n_regionkey AS VARCHAR(9)) FROM nation
        ), tree AS (
          SELECT id, 1 AS lvl, CAST(id AS VARCHAR(99)) AS path FROM edges WHERE parent IS NULL
          UNION ALL SELECT e.id, t.lvl + 1, CAST(t.path || '/' || e.id AS VARCHAR(99)) FROM edges e JOIN tree t ON e.parent = t.id
        ) SELECT id, lvl, path FROM tree""",
    "G17_category_level": "SELECT c.c_custkey, CASE WHEN r.r_regionkey IS NOT NULL THEN 3 WHEN n.n_nationkey IS NOT NULL THEN 2 ELSE 1 END AS level FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey",
    "G18_iteration_number": "SELECT conv_id, COUNT(*) + 1 AS next_iteration FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "G19_memory_log": "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn",
    "G20_session_prefix": "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) v WHERE rn <= 3",
    "G21_cleanup": f"SELECT event_id FROM events WHERE NOT ts < {ANCHOR} - INTERVAL '10' DAY",
    "G22_element_order": """
        SELECT doc, kind, id, ROW_NUMBER() OVER (PARTITION BY doc ORDER BY CASE WHEN idx IS NULL THEN 1 ELSE 0 END, idx, kind, id) AS pos FROM (
          SELECT conv_id AS doc, 'chunk' AS kind, turn AS id, CASE WHEN role = 'system' THEN NULL ELSE turn END AS idx FROM conversations
          UNION ALL SELECT vec_id % 100, 'image', vec_id, CAST(label AS BIGINT) FROM embeddings) v""",
    "G23_type_filter_page": "SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY conv_id, turn LIMIT 20 OFFSET 20",
    "G25_recent_snapshots": f"SELECT user_id, event_id, rn <= 5 AS timeline FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts >= {ANCHOR} - INTERVAL '24' HOUR) v WHERE rn <= 10",
    "G26_iteration_list": "SELECT conv_id, turn FROM conversations WHERE conv_id = 2 ORDER BY turn",
    "G27_session_page": "WITH v AS (SELECT conv_id, COUNT(*) AS n FROM conversations GROUP BY conv_id HAVING COUNT(*) > 2) SELECT conv_id, n, (SELECT COUNT(*) FROM v) AS total FROM v ORDER BY conv_id LIMIT 20",
    "G28_latest_questions": "SELECT conv_id, turn FROM (SELECT conv_id, turn, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'user') v WHERE rn <= 10",
    "G29_snapshot_page": "WITH v AS (SELECT event_id, ts FROM events WHERE user_id = 5 AND event_type = 'view') SELECT event_id, (SELECT COUNT(*) FROM v) AS total FROM v ORDER BY ts DESC, event_id LIMIT 50",
    "G30_export_page": "SELECT o_orderkey FROM orders WHERE o_custkey = 10 AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "G31_user_page": "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40",
    # Observability
    "H01_snapshot_diff": """
        WITH h AS (SELECT MIN(ts) + (MAX(ts) - MIN(ts)) / 2 AS mid FROM events),
        a AS (SELECT user_id, MAX_BY(event_type, event_id) AS state FROM events WHERE ts < (SELECT mid FROM h) GROUP BY user_id),
        b AS (SELECT user_id, MAX_BY(event_type, event_id) AS state FROM events WHERE ts >= (SELECT mid FROM h) GROUP BY user_id)
        SELECT COALESCE(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'created' WHEN b.user_id IS NULL THEN 'deleted'
          WHEN a.state IS DISTINCT FROM b.state THEN 'updated' ELSE 'none' END AS change
        FROM a FULL OUTER JOIN b ON a.user_id = b.user_id""",
    "H02_change_test": "SELECT event_id, prev IS DISTINCT FROM event_type AS changed FROM (SELECT event_id, event_type, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) v",
    "H04_tombstones": f"SELECT DISTINCT user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id AND n.ts >= {ANCHOR} - INTERVAL '1' DAY)",
    "H07_resume_cursor": "SELECT event_type, MAX(event_id) AS cursor FROM events GROUP BY event_type",
    "H09_event_query": "SELECT event_id FROM events WHERE user_id = 3 AND event_type IN ('error', 'view') ORDER BY ts DESC, event_id LIMIT 100",
    "H10_log_page": "SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id LIMIT 100 OFFSET 100",
    "H14_pod_rules": """
        SELECT event_id, rule FROM (
          SELECT event_id, CASE WHEN event_type = 'error' THEN 'POD_UNHEALTHY' END AS rule FROM events
          UNION ALL SELECT event_id, CASE WHEN value > 80 THEN 'HIGH_CPU_USAGE' END FROM events
          UNION ALL SELECT event_id, CASE WHEN value > 95 THEN 'RESTART_LOOP' END FROM events) v WHERE rule IS NOT NULL""",
    "H15_node_rules": "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'NODE_NOT_READY' WHEN s_acctbal > 8000 THEN 'NODE_HIGH_CPU' END AS rule FROM supplier WHERE s_acctbal < 0 OR s_acctbal > 8000",
    "H16_service_rule": "SELECT c.c_custkey, 'SERVICE_NO_CONNECTIONS' AS rule FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey HAVING COUNT(o.o_orderkey) = 0",
    "H17_deployment_rule": "SELECT conv_id, 'DEPLOYMENT_REPLICAS_NOT_READY' AS rule FROM conversations GROUP BY conv_id HAVING COUNT(*) FILTER (WHERE role = 'assistant') < COUNT(*) FILTER (WHERE role = 'user')",
    "H18_latest_sample": "SELECT user_id, ROUND(MAX_BY(value, event_id), 6) AS latest FROM events GROUP BY user_id",
    "H21_knowledge_choice": "SELECT event_id, CASE WHEN value >= 50 THEN 'kb' WHEN event_type = 'view' THEN 'llm' ELSE 'rules' END AS source FROM events",
    "H22_user_rate_limit": "SELECT user_id, CAST(ts AS DATE) AS day, EXTRACT(HOUR FROM ts) AS hour, COUNT(*) AS n, COUNT(*) > 3 AS limited FROM events GROUP BY 1, 2, 3",
    "H24_metrics_history": f"SELECT event_id, ROUND(value, 6) AS value FROM events WHERE ts >= {ANCHOR} - INTERVAL '6' HOUR ORDER BY ts, event_id",
    "H25_consistency": "SELECT d.source, COUNT(*) AS n_docs, COUNT(e.vec_id) AS n_indexed, COUNT(*) = COUNT(e.vec_id) AS consistent FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.source",
}
