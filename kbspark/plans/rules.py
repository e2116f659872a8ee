"""Queries on pages, permissions, logs and associations, each the whole rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.functions import rules as R
from kbspark.functions import text as T
from kbspark.operators import filters, pages, retrieval
from kbspark.plans.native import doc, on, query
from kbspark.sources import sinks
from kbspark.sources.tables import load


# Pages
@query("D10_page_elements")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.elements(load(spark, sf_dir, "pages")).select("page_id", "element_index", "type", "text", "level", F.array_join("path", " > ").alias("path"), "semantic", "language")


@query("D11_page_facts", "SELECT page_id, CAST(len(regexp_extract_all(html, '<h[1-6][ >]')) AS BIGINT) AS headings, CAST(len(regexp_extract_all(html, '<a [^>]*href=')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<form')) AS BIGINT) AS forms FROM pages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.facts(load(spark, sf_dir, "pages")).select("page_id", "headings", "links", "forms")


@query("D12_page_links")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(load(spark, sf_dir, "pages"))


@query("D13_html_tables")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a document as an HTML table in a page, read back."""
    cell = lambda x: F.concat(F.lit("<tr><td>"), F.array_join(F.split(F.replace(x, F.lit("&"), F.lit("&amp;")), " "), "</td><td>"), F.lit("</td></tr>"))
    html = F.concat(F.lit("<h1>t</h1><table>"), F.array_join(F.transform(F.split("text", "\n"), cell), ""), F.lit("</table>"))
    few = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), html.alias("html"), F.lit("http://a.b/").alias("url"))
    return pages.tables(few).select("page_id", F.size("rows").alias("n_rows"), F.size(F.get("rows", F.lit(0))).alias("n_cols"))


# Writes and permissions
@query("A03_insert_update", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_size % 2 = 0 THEN 'new' ELSE p_name END AS p_name, CASE WHEN p_partkey % 4 = 0 THEN 7 ELSE p_size END AS p_size FROM part UNION ALL SELECT 1000000000 + p_partkey, 'new', 7 FROM part WHERE p_partkey % 4 = 0 AND p_size % 2 = 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates whose null fields leave the old value, and inserts of new keys."""
    old = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    some = old.where("p_partkey % 4 = 0")
    changes = some.select("p_partkey", F.when(F.col("p_size") % 2 == 0, "new").alias("p_name"), F.lit(7).alias("p_size"))
    merged = changes.join(old.select("p_partkey", F.col("p_name").alias("n_"), F.col("p_size").alias("s_")), "p_partkey", "left").select("p_partkey", F.coalesce("p_name", "n_").alias("p_name"), F.coalesce("p_size", "s_").alias("p_size"))
    added = some.where("p_size % 2 = 0").select((F.col("p_partkey") + 1000000000).alias("p_partkey"), F.lit("new").alias("p_name"), F.lit(7).alias("p_size"))
    return sinks.upsert(old, merged.unionByName(added), ["p_partkey"])


MATRIX = ", ".join(f"('{r}', '{a}')" for r, actions in R.ROLE_ACTIONS.items() for a in actions)


@query("B14_role_matrix", f"SELECT c_custkey, count(*) AS actions, bool_or(action = 'kb:delete') AS may_delete FROM customer JOIN (VALUES {MATRIX}) m(role, action) ON role = CASE c_nationkey % 4 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' WHEN 2 THEN 'editor' ELSE 'viewer' END GROUP BY c_custkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, R.ROLE_ACTIONS)), (F.col("c_nationkey") % 4 + 1).cast("int"))
    members = load(spark, sf_dir, "customer").select("c_custkey", role.alias("role"))
    found = members.join(F.broadcast(R.role_actions(spark)), "role")  # the matrix, 21 rows
    return found.groupBy("c_custkey").agg(F.count("*").alias("actions"), F.bool_or(F.col("action") == "kb:delete").alias("may_delete"))


@query("B18_lockout", """
    WITH RECURSIVE e AS (SELECT user_id, event_id AS id, epoch_us(ts) AS t, event_id % 3 = 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f AS (SELECT user_id, id, i, CASE WHEN ok THEN 0 ELSE 1 END AS fails, 0::BIGINT AS until, false AS locked FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.id, e.i, CASE WHEN e.t < f.until THEN f.fails WHEN e.ok OR f.fails + 1 >= 5 THEN 0 ELSE f.fails + 1 END,
        CASE WHEN e.t < f.until THEN f.until WHEN NOT e.ok AND f.fails + 1 >= 5 THEN e.t + 1800000000 ELSE 0 END, e.t < f.until FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, id, locked FROM f""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lockouts(load(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("id"), (F.col("event_id") % 3 == 0).alias("ok")))


on("B15_image_kind", "part", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' ELSE 'unknown' END AS kind FROM part",
    lambda: ["p_partkey", F.lower(F.replace(F.coalesce(F.when(F.col("p_size") % 3 == 0, ".PNG"), F.nullif(F.regexp_extract(F.when(F.col("p_size") % 3 == 1, "a/b.JPEG").otherwise("plain"), r"\.([^./]+)$", 1), F.lit("")), F.lit("unknown")), F.lit("."), F.lit(""))).alias("kind")])
on("B20_hedges", "events", "SELECT event_id, CASE WHEN value >= 80 THEN 'disk full' ELSE '可能 disk 似乎full' END AS text FROM events", lambda: ["event_id", R.without_hedges(F.lit("可能 disk 似乎full"), F.col("value") / 100).alias("text")])
on("B23_intent_json", "events", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'tech' WHEN event_id % 3 = 1 THEN 'news' ELSE 'general' END AS intent FROM events",
    lambda: ["event_id", _intent(F.element_at(F.array(F.lit('{"intent": "tech"}'), F.lit("some News"), F.lit('{"intent": "other"}')), (F.col("event_id") % 3 + 1).cast("int"))).alias("intent")])


def _intent(text) -> object:
    told = F.get_json_object(F.when(F.try_parse_json(text).isNotNull(), text), "$.intent")
    fallback = F.when(F.lower(text).contains("news"), "news").when(F.lower(text).contains("tech"), "tech").otherwise("general")
    return F.when(told.isin("news", "tech", "general"), told).otherwise(fallback)


@query("B26_forced_delete_guard", "SELECT n_nationkey, NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < -900) AND (n_regionkey = 1 OR NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)) AS may_delete FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child blocks, a knowledge base blocks unless the delete is forced (here in one region)."""
    kids = load(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("n_nationkey"), F.lit(True).alias("kid")).distinct()
    bases = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(True).alias("base")).distinct()
    both = load(spark, sf_dir, "nation").join(kids, "n_nationkey", "left").join(bases, "n_nationkey", "left")
    return both.select("n_nationkey", (F.col("kid").isNull() & ((F.col("n_regionkey") == 1) | F.col("base").isNull())).alias("may_delete"))


# Associations
@query("C13_chunk_image_ranges", """
    WITH c AS (SELECT l_orderkey AS d, l_linenumber AS c, l_linenumber * 3 AS first, l_linenumber * 3 + 1 AS last, 1 + l_linenumber // 3 AS page FROM lineitem WHERE l_linenumber <= 4),
    i AS (SELECT l_orderkey AS d, l_partkey AS i, CAST(l_quantity AS BIGINT) % 20 AS e, 1 + (CAST(l_quantity AS BIGINT) % 20) // 9 AS page FROM lineitem)
    SELECT * FROM (SELECT c.d, c.c, i.i, CASE WHEN e BETWEEN first AND last THEN 'within_range' WHEN c.page = i.page AND e - last > 0 AND e - last <= 10 THEN 'nearby_same_page'
      WHEN i.page = c.page + 1 AND e <= 5 THEN 'adjacent_page' END AS strategy FROM c JOIN i USING (d)) WHERE strategy IS NOT NULL""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, place = load(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long") % 20
    n = F.col("l_linenumber")
    c = lines.where("l_linenumber <= 4").select(F.col("l_orderkey").alias("d"), n.alias("c"), (n * 3).alias("first"), (n * 3 + 1).alias("last"), (F.floor(n / 3) + 1).alias("page"))
    i = lines.select(F.col("l_orderkey").alias("d"), F.col("l_partkey").alias("i"), place.alias("e"), (F.floor(place / 9) + 1).alias("image_page"))
    gap = F.col("e") - F.col("last")
    strategy = (
        F.when(F.col("e").between(F.col("first"), F.col("last")), "within_range")
        .when((F.col("page") == F.col("image_page")) & (gap > 0) & (gap <= 10), "nearby_same_page")
        .when((F.col("image_page") == F.col("page") + 1) & (F.col("e") <= 5), "adjacent_page")
    )
    return c.join(i, "d").select("d", "c", "i", strategy.alias("strategy")).where("strategy IS NOT NULL")


@query("C12_image_union", """
    WITH s AS (SELECT user_id, 'vector' AS kind, value FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, 'keyword', value FROM events WHERE event_type = 'error')
    SELECT user_id, round(max(CASE WHEN kind = 'vector' THEN value END), 6) AS v, round(max(CASE WHEN kind = 'keyword' THEN value END), 6) AS k, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM s GROUP BY user_id""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "vector").when(F.col("event_type") == "error", "keyword")
    hits = load(spark, sf_dir, "events").select("user_id", kind.alias("kind"), "value").where("kind IS NOT NULL")
    best = lambda k: F.round(F.max(F.when(F.col("kind") == k, F.col("value"))), 6)
    return hits.groupBy("user_id").agg(best("vector").alias("v"), best("keyword").alias("k"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query("C20_tag_recommendation", """
    WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part), own AS (SELECT DISTINCT tag FROM t WHERE p_partkey = 5),
    near AS (SELECT DISTINCT t.p_partkey FROM t JOIN own USING (tag) WHERE t.p_partkey <> 5)
    SELECT tag, count(DISTINCT p_partkey) AS n FROM t JOIN near USING (p_partkey) WHERE tag NOT IN (SELECT tag FROM own) GROUP BY tag ORDER BY n DESC, tag LIMIT 5""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of documents that share a tag with one document, its own left out, the five most frequent."""
    tags = load(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("tag")).distinct()
    own = tags.where("p_partkey = 5").select("tag")
    near = tags.where("p_partkey <> 5").join(own, "tag", "left_semi").select("p_partkey").distinct()
    found = tags.join(near, "p_partkey", "left_semi").join(own, "tag", "left_anti")
    return found.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(5)


@query("C26_cascade", "SELECT 'lineitem' AS part_of, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 7 <> 0 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 7 <> 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers go, with them their orders, with these their lines: one anti join for each table."""
    gone = load(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = load(spark, sf_dir, "orders")
    gone_orders = orders.join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    left = {
        "lineitem": load(spark, sf_dir, "lineitem").join(gone_orders, "l_orderkey", "left_anti"), "orders": orders.join(gone, "o_custkey", "left_anti"),
        "customer": load(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey").join(gone, "o_custkey", "left_anti"),
    }
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part_of"), "n") for name, rows in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# Texts
@query("D18_noise_removed", r"""
    WITH n AS (SELECT conv_id, turn, text, CASE WHEN length(text) <= 80 THEN trim(regexp_replace(regexp_replace(lower(text), '[0-9]', '', 'g'), '\s+', ' ', 'g')) END AS k FROM conversations),
    o AS (SELECT k FROM n WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT conv_id) >= 2) SELECT conv_id, turn FROM n WHERE k IS NULL OR k NOT IN (SELECT k FROM o)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.noise(load(spark, sf_dir, "conversations"), "conv_id").select("conv_id", "turn")


on("D39_intent_confidence", "conversations", "SELECT conv_id, turn, CASE WHEN contains(lower(text), '什么') OR contains(lower(text), 'what') THEN 'factual_qa' WHEN regexp_matches(lower(text), '如何|怎么|how') THEN 'operation_guide' WHEN regexp_matches(lower(text), '比较|对比|compare') THEN 'comparison_analysis' ELSE 'factual_qa' END AS intent, CASE WHEN regexp_matches(lower(text), '什么|what|如何|怎么|how') THEN 0.8::DOUBLE WHEN regexp_matches(lower(text), '比较|对比|compare') THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM conversations",
    lambda: ["conv_id", "turn", F.when(_has("什么|what"), "factual_qa").when(_has("如何|怎么|how"), "operation_guide").when(_has("比较|对比|compare"), "comparison_analysis").otherwise("factual_qa").alias("intent"), F.when(_has("什么|what|如何|怎么|how"), 0.8).when(_has("比较|对比|compare"), 0.7).otherwise(0.5).alias("confidence")])


def _has(words: str) -> object:
    return F.lower(doc()).rlike(words)


on("D46_risk_label", "lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.5 THEN 'high' WHEN l_quantity + l_linenumber * 100 >= 1000 THEN 'high' WHEN l_linenumber * 20 > 100 THEN 'medium' WHEN l_quantity + l_linenumber * 100 > 50 THEN 'medium' ELSE 'low' END AS risk FROM lineitem",
    lambda: ["l_orderkey", "l_linenumber", _risk(F.col("l_discount") * 10, F.col("l_quantity") + F.col("l_linenumber") * 100, F.col("l_linenumber") * 20).alias("risk")])


def _risk(ratio, changes, removed) -> object:
    return F.when(ratio >= 0.5, "high").when(changes >= 1000, "high").when(removed > 100, "medium").when(changes > 50, "medium").otherwise("low")


@query("D49_fragments", """
    SELECT doc_id, array_to_string(list_transform(list_filter(list_distinct(list_transform(range(1, 4), lambda k: length(array_to_string(string_split(text, 'License')[1:k], 'License')) + 1)), lambda p: p + 6 <= length(text)).list_sort(),
      lambda p: replace(substring(text, greatest(p - 30, 1), 150), 'License', '<mark>License</mark>')), '|') AS fragments FROM documents WHERE contains(text, 'License')""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.fragments(doc(), "License")
    return load(spark, sf_dir, "documents").where(F.contains("text", F.lit("License"))).select("doc_id", F.array_join(found, "|").alias("fragments"))


on("D51_answer_without_thinking", "conversations", r"SELECT conv_id, turn, md5(trim(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'))) AS h FROM conversations",
    lambda: ["conv_id", "turn", F.md5(F.trim(F.regexp_replace(F.replace(F.regexp_replace(F.concat(F.lit("<think>a\nb</think>"), doc()), r"(?s)<think>.*?</think>", ""), F.lit("\r"), F.lit("")), r"\n{3,}", "\n\n"))).alias("h")])


# Search
@query("E09_all_parts", r"""
    SELECT doc_id FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS k FROM documents)
    WHERE lang = 'en' AND list_contains(k, 'the') AND (list_contains(k, 'rights') OR list_contains(k, 'license')) AND contains(' ' || array_to_string(k, ' ') || ' ', ' rights reserved ')
      AND len(list_filter(k, lambda w: regexp_full_match(w, 'res.*d'))) > 0 AND len(list_filter(k, lambda w: regexp_full_match(w, 'a[lm]+'))) > 0""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match, Boolean, phrase, wildcard and regular expression at once, with a filter."""
    docs = load(spark, sf_dir, "documents").where(filters.compile_filters({"lang": "en"}))
    parts = lambda k: F.array_contains(k, "the") & filters.boolean_query("rights OR license", k) & T.has_phrase(k, ["rights", "reserved"]) & filters.any_term(k, "res*d") & F.exists(k, lambda w: w.rlike("^a[lm]+$"))
    return docs.where(retrieval.let(T.tokens(doc()), parts)).select("doc_id")


on("E14_completeness_score", "conversations", "SELECT conv_id, turn, round((least(length(text) / 500, 1) + least((length(text) - length(replace(replace(text, '.', ''), '。', ''))) / 3, 1)) / 2, 6) AS score FROM conversations",
    lambda: ["conv_id", "turn", F.round((F.least(F.length("text") / 500, F.lit(1.0)) + F.least((F.length("text") - F.length(F.regexp_replace("text", "[.。]", ""))) / 3, F.lit(1.0))) / 2, 6).alias("score")])
on("E26_image_confidence", "lineitem", """
    SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, (CASE WHEN l_linenumber = 1 THEN 0.95::DOUBLE + CASE WHEN l_tax > 0.03 THEN 0.05 ELSE 0 END WHEN l_linenumber <= 6 THEN
      CASE WHEN l_quantity <= 3 THEN 0.85::DOUBLE WHEN l_quantity <= 5 THEN 0.75::DOUBLE WHEN l_quantity <= 10 THEN 0.65::DOUBLE ELSE 0.55::DOUBLE END + CASE WHEN l_tax > 0.02 THEN 0.1::DOUBLE ELSE 0 END ELSE 0.4::DOUBLE END) * CASE WHEN l_returnflag = 'A' THEN 1.1::DOUBLE ELSE 1 END)), 6) AS confidence FROM lineitem""",
    lambda: ["l_orderkey", "l_linenumber", F.round(_association(F.when(F.col("l_linenumber") == 1, "within_range").when(F.col("l_linenumber") <= 6, "nearby_same_page").otherwise("fallback"), F.col("l_quantity"), F.col("l_tax") * 10, F.col("l_returnflag") == "A"), 6).alias("confidence")])


def _association(strategy, gap, iou, same_page) -> object:
    near = F.when(gap <= 3, 0.85).when(gap <= 5, 0.75).when(gap <= 10, 0.65).otherwise(0.55) + F.when(iou > 0.2, 0.1).otherwise(0.0)
    base = F.when(strategy == "within_range", 0.95 + F.when(iou > 0.3, 0.05).otherwise(0.0)).when(strategy == "nearby_same_page", near).otherwise(0.4)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * F.when(same_page, 1.1).otherwise(1.0)))


@query("E11_weighted_bm25", """
    WITH RECURSIVE f AS (SELECT p_partkey, unnest(['name', 'type', 'brand']) AS f, unnest([p_name, p_type, p_brand]) AS x FROM part), k AS (SELECT p_partkey, f, regexp_extract_all(lower(x), '[\\p{L}\\p{N}_]+') AS k FROM f),
    s AS (SELECT f, count(*) AS n, avg(len(k)) AS avgdl, count(*) FILTER (WHERE list_contains(k, 'steel')) AS df FROM k GROUP BY f),
    b AS (SELECT p_partkey, CASE k.f WHEN 'name' THEN 2.0 WHEN 'type' THEN 1.5 ELSE 1.0 END * ln(1 + (n - df + 0.5) / (df + 0.5)) * len(list_filter(k, lambda w: w = 'steel')) * 2.2 / (len(list_filter(k, lambda w: w = 'steel')) + 1.2 * (0.25 + 0.75 * len(k) / avgdl)) AS v FROM k JOIN s USING (f) WHERE list_contains(k, 'steel'))
    SELECT p_partkey, round(sum(v), 6) AS score FROM b GROUP BY p_partkey""".replace("\\\\", "\\"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of each field times its weight, summed; at least one field must match."""
    part = load(spark, sf_dir, "part")
    parts = [retrieval.bm25(part, ["steel"], "p_partkey", c).select(F.col("doc_id").alias("p_partkey"), (F.col("score") * w).alias("v")) for c, w in (("p_name", 2.0), ("p_type", 1.5), ("p_brand", 1.0))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("p_partkey").agg(F.round(F.sum("v"), 6).alias("score"))


# Aggregates and windows
@query("F09_tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = load(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


@query("F18_log_errors_with_messages", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, coalesce(array_to_string((list(event_id ORDER BY event_id) FILTER (WHERE event_type = 'error'))[1:3], ','), '') AS first_ids FROM events GROUP BY user_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three first messages of each user are cut to three before they meet."""
    bad = load(spark, sf_dir, "events").withColumn("bad", F.col("event_type") == "error")
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    first = bad.where("bad").withColumn("rn", rank).where("rn <= 3").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("first_ids"))
    counts = bad.groupBy("user_id").agg(F.count_if("bad").alias("errors"))
    return counts.join(first, "user_id", "left").select("user_id", "errors", F.coalesce("first_ids", F.lit("")).alias("first_ids"))


@query("F23_health", "SELECT user_id, s AS score, CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 60 THEN 'good' WHEN s >= 40 THEN 'warning' ELSE 'critical' END AS label FROM (SELECT user_id, round(greatest(0, 100 - c) * 0.3 + greatest(0, 100 - m) * 0.3 + greatest(0, 100 - d) * 0.2 + greatest(0, 100 - r) * 0.2, 6) AS s FROM (SELECT user_id, max(value) AS c, min(value) AS m, CAST(count(*) AS DOUBLE) % 100 AS d, CAST(user_id % 100 AS DOUBLE) AS r FROM events GROUP BY user_id))")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = load(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("cpu"), F.min("value").alias("memory"), (F.count("*").cast("double") % 100).alias("disk")).withColumn("cache", (F.col("user_id") % 100).cast("double"))
    scored = use.select("user_id", R.health(6, **{k: F.col(k) for k in R.SCORES}).alias("score"))
    return scored.select("user_id", "score", R.health_label(F.col("score")).alias("label"))


@query("G15_log_window", """
    WITH e AS (SELECT user_id, event_type = 'error' AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
    n AS (SELECT *, count(*) OVER w AS n, bool_or(p) OVER w AS any_p, (SELECT min(abs(x.pos - e.pos)) FROM e x WHERE x.user_id = e.user_id AND x.p) AS far FROM e WINDOW w AS (PARTITION BY user_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN far <= 3 THEN far ELSE 4 END, CASE WHEN far <= 3 THEN pos ELSE -pos END) AS rk, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS lst FROM n)
    SELECT user_id, pos FROM r WHERE n <= 30 OR (NOT any_p AND lst <= 30) OR (any_p AND rk <= 30)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    lines = load(spark, sf_dir, "events").select("user_id", pos.alias("pos"), (F.col("event_type") == "error").alias("priority"))
    return R.log_context(lines, 30).select("user_id", F.col("pos").cast("long").alias("pos"))


on("G11_array_sets", "part", "SELECT p_partkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS n FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type || ' ' || p_name), ' ')) AS b FROM part)",
    lambda: ["p_partkey", F.array_join(F.array_sort(F.array_intersect(F.split("p_name", " "), F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " "))), ",").alias("both"), F.size(F.array_union(F.split("p_name", " "), F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " "))).cast("long").alias("n")])


@query("G23_page_after_double_fetch", "SELECT conv_id, turn FROM (SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 40) WHERE role = 'user' ORDER BY conv_id, turn LIMIT 20")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the service does it: twice the page is fetched, then filtered, so a page may stay short."""
    fetched = load(spark, sf_dir, "conversations").orderBy("conv_id", "turn").limit(40)
    return fetched.where("role = 'user'").orderBy("conv_id", "turn").limit(20).select("conv_id", "turn")


# Streams of changes and logs
FIELDS = ["event_type", "value", "props", "ts", "event_id"]


@query("H03_fields_diff", "SELECT user_id, event_id, array_to_string(list_filter([CASE WHEN prior IS NOT NULL AND prior.event_type IS DISTINCT FROM event_type THEN 'event_type' END, CASE WHEN prior IS NOT NULL AND prior.v IS DISTINCT FROM v THEN 'value' END, CASE WHEN prior IS NOT NULL AND prior.props IS DISTINCT FROM props THEN 'props' END], lambda x: x IS NOT NULL), ',') AS changed FROM (SELECT user_id, event_id, event_type, props, floor(value / 50) AS v, lag({'event_type': event_type, 'v': floor(value / 50), 'props': props}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the fields in which a resource differs from its state before."""
    now = F.struct("event_type", F.floor(F.col("value") / 50).alias("value"), "props")
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", now.alias("now"))
    rows = rows.withColumn("prior", F.lag("now").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    changed = F.filter(F.array(*[F.when(F.col("prior").isNotNull() & ~F.col(f"prior.{c}").eqNullSafe(F.col(f"now.{c}")), F.lit(c)) for c in ("event_type", "value", "props")]), lambda x: x.isNotNull())
    return rows.select("user_id", "event_id", F.array_join(changed, ",").alias("changed"))


@query("H01_snapshot_upsert", """
    WITH s AS (SELECT user_id, event_id, ts, event_type AS state, event_type = 'error' AS gone FROM events), p AS (SELECT *, lag({'state': state, 'gone': gone}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM s)
    SELECT user_id, event_id, CASE WHEN gone THEN CASE WHEN prior IS NULL OR prior.gone THEN 'none' ELSE 'deleted' END WHEN prior IS NULL OR prior.gone THEN 'created' WHEN prior.state = state THEN 'none' ELSE 'updated' END AS change FROM p""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each state against the one before; a row that comes back after a deletion counts as created."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("state"), (F.col("event_type") == "error").alias("gone"))
    rows = rows.withColumns({"before": F.lag("state").over(w), "was_gone": F.coalesce(F.lag("gone").over(w), F.lit(True))})
    change = F.when(F.col("gone"), F.when(F.col("was_gone"), "none").otherwise("deleted")).when(F.col("was_gone"), "created").when(F.col("before") == F.col("state"), "none").otherwise("updated")
    return rows.select("user_id", "event_id", change.alias("change"))


on("H12_error_lines", "events", "SELECT event_id, event_id % 5 IN (0, 1, 3) AS is_error FROM events",
    lambda: ["event_id", R.is_error_line(F.element_at(F.array(F.lit("x [error] y"), F.lit("Caused by: java.lang.Foo"), F.lit("no error found"), F.lit("warning late"), F.lit("all fine")), (F.col("event_id") % 5 + 1).cast("int"))).alias("is_error")])


@query("H19_windowed_metrics", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets as wide as the range asked for says: here the whole period, so a quarter of an hour."""
    from kbspark.streaming.changes import resolution, windowed_counts

    events = load(spark, sf_dir, "events")
    hours = events.agg((F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))) / 3600).first()[0] or 0
    return windowed_counts(events, width=resolution(hours)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("H25_three_checks", """
    SELECT 'count' AS check, count(*) AS bad FROM (SELECT d.source FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.source HAVING count(*) <> count(e.vec_id))
    UNION ALL SELECT 'version', count(*) FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.n_chars % 10 <> e.label UNION ALL SELECT 'missing', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source, versions, and presence in the index, from one join."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") % 10).alias("version"))
    both = docs.join(load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left")
    by_source = both.groupBy("source").agg(F.count("*").alias("n"), F.count("label").alias("m"), F.count_if(F.col("version") != F.col("label")).alias("v"), F.count_if(F.col("label").isNull()).alias("x"))
    total = by_source.agg(F.count_if(F.col("n") != F.col("m")).alias("count"), F.sum("v").alias("version"), F.sum("x").alias("missing"))
    return total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("bad")) for c in ("count", "version", "missing")])).alias("r")).select("r.*")
