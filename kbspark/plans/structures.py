"""Queries on moving ranges, intervals and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import intervals, ranges, trees
from kbspark.plans.native import query
from kbspark.sources.tables import load

# Rates over overlapping ranges: six-hour steps, a day each
RATE = """
    WITH e AS (SELECT {by} AS k, epoch_us(ts) / 1000000.0 AS s, max(value) AS v FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
    c AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY s) AS prior FROM e), g AS (SELECT k, s, v, CASE WHEN prior IS NULL THEN 0 WHEN v >= prior THEN v - prior ELSE v END AS gain FROM c),
    steps AS (SELECT k, CAST(unnest(range(CAST(ceil((SELECT min(s) FROM e) / 21600) AS BIGINT) * 21600, CAST(floor((SELECT max(s) FROM e) / 21600) AS BIGINT) * 21600 + 1, 21600)) AS DOUBLE) AS t FROM (SELECT DISTINCT k FROM e)),
    w AS (SELECT steps.k, t, count(*) AS n, min(s) AS a, max(s) AS z, arg_min(v, s) AS first, sum(gain) - arg_min(gain, s) AS gain FROM steps JOIN g ON g.k = steps.k AND s >= t - 86400 AND s <= t GROUP BY steps.k, t),
    x AS (SELECT k, t, gain, z - a AS span, (z - a) / (n - 1) AS mean, a - (t - 86400) AS l, t - z AS r, first FROM w WHERE n > 1),
    y AS (SELECT k, t, gain, span, CASE WHEN l < mean * 1.1 THEN l ELSE mean / 2 END AS l, CASE WHEN r < mean * 1.1 THEN r ELSE mean / 2 END AS r, CASE WHEN gain > 0 AND first >= 0 THEN span * first / gain END AS zero FROM x),
    rate AS (SELECT k, t, gain * (span + CASE WHEN zero < l THEN zero ELSE l END + r) / span / 86400 AS rate FROM y)"""


def _rates(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    return ranges.range_rate(load(spark, sf_dir, "events"), by, 86_400, 21_600)


@query("F24_range_rate", RATE.format(by="user_id") + " SELECT k AS user_id, CAST(t AS BIGINT) AS t, round(rate, 8) AS rate FROM rate")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir, ["user_id"]).select("user_id", F.col("t").cast("long").alias("t"), F.round("rate", 8).alias("rate"))


@query("F25_range_rate_by_instance", RATE.format(by="{'u': user_id, 'i': event_type}") + " SELECT k.i AS instance, CAST(t AS BIGINT) AS t, round(sum(rate), 7) AS rate FROM rate GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of each series first, then their sum by instance: a sum of counters has no resets to find."""
    found = ranges.by_label(_rates(spark, sf_dir, ["user_id", "event_type"]), F.col("event_type"), "instance", "rate")
    return found.select("instance", F.col("t").cast("long").alias("t"), F.round("rate", 7).alias("rate"))


@query("F25_gauge_max", """
    WITH e AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS s, max(value) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL),
    steps AS (SELECT CAST(unnest(range(CAST(ceil((SELECT min(s) FROM e) / 3600) AS BIGINT) * 3600, CAST(floor((SELECT max(s) FROM e) / 3600) AS BIGINT) * 3600 + 1, 3600)) AS DOUBLE) AS t),
    p AS (SELECT t, user_id, arg_max(v, s) AS v FROM steps JOIN e ON s <= t AND s > t - 300 GROUP BY t, user_id)
    SELECT CAST(t AS BIGINT) AS t, round(max(v), 6) AS value FROM p GROUP BY t""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest of the users' present values at each hour; a value older than five minutes is stale."""
    held = ranges.instant(load(spark, sf_dir, "events"), ["user_id"], 3600)
    return held.groupBy("t").agg(F.max("value").alias("value")).select(F.col("t").cast("long").alias("t"), F.round("value", 6).alias("value"))


# Associations through bins and one sort; all lines
IMAGES = "SELECT l_orderkey AS d, l_partkey AS i, CAST(l_quantity AS BIGINT) % 20 AS e, 1 + (CAST(l_quantity AS BIGINT) % 20) // 9 AS page FROM lineitem"
PARTS = "SELECT l_orderkey AS d, l_linenumber AS c, l_linenumber * 3 AS first, l_linenumber * 3 + 1 AS last, 1 + l_linenumber // 3 AS page FROM lineitem"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines, place, n = load(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long") % 20, F.col("l_linenumber")
    i = lines.select(F.col("l_orderkey").alias("d"), F.col("l_partkey").alias("i"), place.alias("e"), (F.floor(place / 9) + 1).alias("image_page"))
    return lines.select(F.col("l_orderkey").alias("d"), n.alias("c"), (n * 3).alias("first"), (n * 3 + 1).alias("last"), (F.floor(n / 3) + 1).alias("page")), i


@query("C13_binned_ranges", f"""
    WITH c AS ({PARTS}), i AS ({IMAGES})
    SELECT * FROM (SELECT c.d, c.c, i.i, CASE WHEN e BETWEEN first AND last THEN 'within_range' WHEN c.page = i.page AND e - last > 0 AND e - last <= 10 THEN 'nearby_same_page'
      WHEN i.page = c.page + 1 AND e <= 5 THEN 'adjacent_page' END AS strategy FROM c JOIN i USING (d)) WHERE strategy IS NOT NULL""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.chunk_images(*_sides(spark, sf_dir))


@query("C14_binned_ranges", f"""
    WITH i AS ({IMAGES}), c AS ({PARTS}),
    b AS (SELECT i.d, i.i, i.e, c.c, CASE WHEN e BETWEEN first AND last THEN 'within_range' WHEN c.page = i.page AND e > last AND e - last <= 10 THEN 'before_image' WHEN c.page = i.page AND first > e AND first - e <= 10 THEN 'after_image' END AS s, c.page = i.page AS same FROM i JOIN c USING (d)),
    hit AS (SELECT DISTINCT d, i, e FROM b WHERE s IS NOT NULL)
    SELECT d, i, e, c, s AS strategy FROM b WHERE s IS NOT NULL UNION ALL SELECT b.d, b.i, b.e, b.c, 'fallback' FROM b ANTI JOIN hit ON hit.d = b.d AND hit.i = b.i AND hit.e = b.e WHERE same""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, i = _sides(spark, sf_dir)
    return intervals.image_chunks(i, c)


@query("C15_nearest_sweep", """
    WITH a AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'), p AS (SELECT user_id, event_id AS near_id, epoch_us(ts) AS near_t FROM events WHERE event_type = 'click')
    SELECT user_id, event_id, near_id FROM (SELECT a.user_id, a.event_id, p.near_id, row_number() OVER (PARTITION BY a.user_id, a.event_id ORDER BY abs(t - near_t), near_t, near_id) AS rn FROM a LEFT JOIN p ON p.user_id = a.user_id) WHERE rn = 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error the click of the same user that is nearest in time."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    points = rows.where("event_type = 'click'").select("user_id", F.col("event_id").alias("near_id"), F.col("t").alias("near_t"))
    return intervals.nearest(rows.where("event_type = 'error'").drop("event_type"), points, ["user_id"], "t", "near_t", "near_id").select("user_id", "event_id", "near_id")


# Trees by pointer jumping: regions, nations, customers, orders
NODES = """SELECT 'r' || r_regionkey AS id, NULL AS parent, 0.0 AS value FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0 FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_acctbal FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_totalprice FROM orders"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    parts = [("region", "r_regionkey", None, None, None), ("nation", "n_nationkey", "r", "n_regionkey", None), ("customer", "c_custkey", "n", "c_nationkey", "c_acctbal"), ("orders", "o_orderkey", "c", "o_custkey", "o_totalprice")]
    out = None
    for table, key, above, parent, value in parts:
        up = name(above, parent) if parent else F.lit(None).cast("string")
        rows = load(spark, sf_dir, table).select(name(table[0], key).alias("id"), up.alias("parent"), (F.col(value) if value else F.lit(0.0)).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("G16_tree_paths", f"""
    WITH RECURSIVE e AS ({NODES}), t AS (SELECT id, 1 AS level, id AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.id, t.level + 1, t.path || '/' || e.id FROM e JOIN t ON e.parent = t.id)
    SELECT id, level, path FROM t""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.paths(_nodes(spark, sf_dir))


@query("G17_tree_levels", f"""
    WITH RECURSIVE e AS ({NODES}), t AS (SELECT id, id AS root, 1 AS level FROM e WHERE parent IS NULL UNION ALL SELECT e.id, t.root, t.level + 1 FROM e JOIN t ON e.parent = t.id)
    SELECT id, root, least(level, 3) AS level FROM t""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.levels(_nodes(spark, sf_dir)).select("id", "root", F.least("level", F.lit(3)).alias("level"))


@query("D26_subtree_totals", """
    SELECT 'c' || c_custkey AS id, round(c_acctbal + coalesce(o, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey
    UNION ALL SELECT 'n' || n_nationkey, round(coalesce(s, 0), 2) FROM nation LEFT JOIN (SELECT c_nationkey, sum(c_acctbal + coalesce(o, 0)) AS s FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1) ON c_nationkey = n_nationkey""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs on each customer and each nation, summed."""
    found = trees.subtree_sums(_nodes(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(20,2)")), F.col("value"))
    return found.where("id LIKE 'c%' OR id LIKE 'n%'").select("id", F.round(F.col("total").cast("double"), 2).alias("total"))


CASCADE = [
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("events", "user_id", "customer", "c_custkey"),
    ("documents", "doc_id", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("embeddings", "vec_id", "documents", "doc_id"),
]


@query("C26_cascade_six", """
    WITH g AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 = 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT k FROM g)), d AS (SELECT doc_id FROM documents WHERE doc_id IN (SELECT k FROM g))
    SELECT 'customer' AS part_of, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT k FROM g) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT k FROM g)
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o) UNION ALL SELECT 'events', count(*) FROM events WHERE user_id IS NULL OR user_id NOT IN (SELECT k FROM g)
    UNION ALL SELECT 'documents', count(*) FROM documents WHERE doc_id NOT IN (SELECT k FROM g) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM d)
    UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM d)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers go, with them all that hangs on them in six tables, over one and two links."""
    tables = {t: load(spark, sf_dir, t) for t in ("customer", *[c for c, *_ in CASCADE])}
    left = trees.cascade(tables, CASCADE, "customer", tables["customer"].where("c_custkey % 7 = 0").select("c_custkey"))
    out = None
    for name, rows in left.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part_of"), "n")
        out = one if out is None else out.unionByName(one)
    return out
