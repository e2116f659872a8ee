"""Further operators as SQL that both engines run: association, confidence, layout and scalar rules."""

from __future__ import annotations

PORTABLE: dict[str, str] = {
    "C13_range_join": """
        SELECT o_orderkey, l_linenumber, strategy FROM (
          SELECT o.o_orderkey, l.l_linenumber, CASE WHEN l.l_linenumber BETWEEN 2 AND 3 THEN 'within_range' WHEN l.l_linenumber > 3 AND l.l_linenumber - 3 <= 2 THEN 'same_page' END AS strategy
          FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey) v WHERE strategy IS NOT NULL""",
    "C14_reverse_range_join": """
        WITH hit AS (SELECT l_orderkey, COUNT(*) AS n FROM lineitem WHERE l_linenumber BETWEEN 5 AND 7 GROUP BY l_orderkey)
        SELECT l.l_orderkey, l.l_linenumber, CASE WHEN l.l_linenumber BETWEEN 5 AND 7 THEN 'within' ELSE 'fallback' END AS strategy
        FROM lineitem l LEFT JOIN hit h ON h.l_orderkey = l.l_orderkey WHERE l.l_linenumber BETWEEN 5 AND 7 OR h.n IS NULL""",
    "D16_numeric_columns": "SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE TRY_CAST(p_brand AS DOUBLE) IS NOT NULL) * 2 > COUNT(*) AS brand_numeric, COUNT(*) FILTER (WHERE TRY_CAST(CAST(p_size AS VARCHAR(20)) AS DOUBLE) IS NOT NULL) * 2 > COUNT(*) AS size_numeric FROM part",
    "D18_page_noise": "SELECT text, COUNT(DISTINCT conv_id) AS pages FROM conversations WHERE LENGTH(text) <= 80 GROUP BY text HAVING COUNT(DISTINCT conv_id) >= 2",
    "D25_heading_parent": """
        WITH h AS (SELECT conv_id, turn AS pos, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS lvl FROM conversations)
        SELECT conv_id, pos, CASE WHEN lvl = 2 THEN l1 WHEN lvl = 3 THEN GREATEST(COALESCE(l1, l2), COALESCE(l2, l1)) END AS parent_pos FROM (
          SELECT conv_id, pos, lvl, MAX(CASE WHEN lvl = 1 THEN pos END) OVER w AS l1, MAX(CASE WHEN lvl = 2 THEN pos END) OVER w AS l2
          FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) v""",
    "D32_row_windows": """
        WITH r AS (SELECT p_brand, p_partkey, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part)
        SELECT p_brand, w, COUNT(*) AS n FROM (
          SELECT p_brand, CAST(FLOOR(i / 40.0E0) AS BIGINT) AS w FROM r
          UNION ALL SELECT p_brand, CAST(FLOOR(i / 40.0E0) AS BIGINT) - 1 FROM r WHERE i % 40 < 10 AND i >= 40) v GROUP BY p_brand, w""",
    "D62_slide_toc": "SELECT conv_id, turn, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS toc_pos FROM conversations WHERE role = 'user' AND turn > 0 AND TRIM(text) <> ''",
    "E04_image_knn_bounds": "SELECT vec_id, LEAST(GREATEST(2 * label, 20), 100) AS k FROM embeddings",
    "E06_rerank_default": "SELECT event_id, ROUND(COALESCE(NULLIF(value, 0), 0), 6) AS score FROM events ORDER BY value DESC, event_id LIMIT 100",
    "E11_weighted_fields": "SELECT p_partkey, score FROM (SELECT p_partkey, 2.0E0 * CASE WHEN p_name LIKE '%a%' THEN 1 ELSE 0 END + 1.5E0 * CASE WHEN p_type LIKE '%S%' THEN 1 ELSE 0 END + 1.0E0 * CASE WHEN p_brand LIKE '%1%' THEN 1 ELSE 0 END AS score FROM part) v WHERE score > 0",
    "E12_image_fusion": """
        SELECT user_id, ROUND(CASE WHEN v IS NOT NULL AND k IS NOT NULL THEN 0.7E0 * v + 0.3E0 * k ELSE COALESCE(v, k) END, 4) AS score FROM (
          SELECT user_id, MAX(CASE WHEN event_type = 'view' THEN value END) AS v, MAX(CASE WHEN event_type = 'error' THEN value END) AS k FROM events GROUP BY user_id) s
        WHERE v IS NOT NULL OR k IS NOT NULL""",
    "E17_strategy": "SELECT event_id, CASE WHEN value > 80 THEN 'direct' WHEN value > 50 THEN 'augmented' WHEN value > 30 THEN 'cautious' ELSE 'fallback' END AS strategy, ROUND(LEAST(value / 100 + 0.2E0, 1.0E0), 6) AS confidence FROM events",
    "E24_context_budget": """
        SELECT conv_id, turn FROM (SELECT conv_id, turn, SUM(LENGTH(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS total FROM conversations) v WHERE total <= 1500""",
    "E26_association_confidence": "SELECT l_orderkey, l_linenumber, ROUND(LEAST(CASE WHEN l_linenumber <= 3 THEN 0.85E0 WHEN l_linenumber <= 5 THEN 0.75E0 ELSE 0.65E0 END * CASE WHEN l_returnflag = 'A' THEN 1.1E0 ELSE 1.0E0 END, 1.0E0), 6) AS confidence FROM lineitem",
    "E27_box_iou": """
        SELECT l_orderkey, l_linenumber, ROUND(CASE WHEN u <= 0 THEN 0 ELSE i / u END, 6) AS iou FROM (
          SELECT l_orderkey, l_linenumber, GREATEST(LEAST(l_tax + 0.5E0, 0.6E0) - GREATEST(l_tax, 0.1E0), 0) * GREATEST(LEAST(l_discount + 0.5E0, 0.6E0) - GREATEST(l_discount, 0.1E0), 0) AS i,
            0.5E0 - GREATEST(LEAST(l_tax + 0.5E0, 0.6E0) - GREATEST(l_tax, 0.1E0), 0) * GREATEST(LEAST(l_discount + 0.5E0, 0.6E0) - GREATEST(l_discount, 0.1E0), 0) AS u FROM lineitem) v""",
    "G11_set_operations": "SELECT c_custkey AS k FROM customer WHERE c_nationkey < 10 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
    "H03_field_diff": """
        SELECT user_id, event_id, CASE WHEN prev_type IS DISTINCT FROM event_type THEN 'event_type:' || COALESCE(prev_type, '') || '>' || event_type ELSE '' END AS diff FROM (
          SELECT user_id, event_id, event_type, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_type FROM events) v""",
    "I04_time_diff": "SELECT user_id, MAX(ts) - MIN(ts) > INTERVAL '3' DAY AS long_span FROM events GROUP BY user_id",
    "I05_is_expired": "SELECT event_id, (SELECT MAX(ts) FROM events) > ts + INTERVAL '24' HOUR AS expired FROM events",
    "I11_number_to_string": "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) AS s FROM lineitem",
    "I24_range_checks": "SELECT p_partkey, p_size BETWEEN 1 AND 50 AS in_range, LENGTH(p_name) BETWEEN 1 AND 255 AS name_ok FROM part",
    "I26_validators": "SELECT conv_id, turn, LENGTH(TRIM(text)) > 0 AND LENGTH(text) <= 1000 AS ok FROM conversations",
}
