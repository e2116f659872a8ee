"""Further whole rules: images, metrics, estimates, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.functions.vectors import feature_similarity
from kbspark.operators import cluster, search
from kbspark.plans.native import TERMS, _probe, doc, on, query
from kbspark.plans.search import HYBRID
from kbspark.sources.tables import load

POINTS = "list_transform(range(8), lambda i: CAST(embedding[i * 8 + 1:i * 8 + 8] AS DOUBLE[]))"


@query("E34_feature_points", f"""
    WITH f AS (SELECT vec_id, {POINTS} AS p FROM embeddings), q AS (SELECT p AS q FROM f WHERE vec_id = 0),
    d AS (SELECT vec_id, list_transform(p, lambda x: list_sort(list_transform(q, lambda y: list_distance(x, y)))) AS d FROM f, q)
    SELECT vec_id, round(len(list_filter(d, lambda x: x[1] < 0.7 * x[2])) / 8, 6) AS score FROM d""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in eight parts as the feature points of images, against those of one."""
    points = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, 8))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", points.alias("p"))
    probe = F.broadcast(rows.where("vec_id = 0").select(F.col("p").alias("q")))  # one row
    return rows.crossJoin(probe).select("vec_id", F.round(feature_similarity(F.col("p"), F.col("q")), 6).alias("score"))


@query("E12_image_scores", "SELECT user_id, round(CASE WHEN v IS NULL THEN k WHEN k IS NULL THEN v ELSE 0.7 * v + 0.3 * k END, 6) AS score FROM (SELECT user_id, max(value) FILTER (WHERE event_type = 'view') AS v, max(value) FILTER (WHERE event_type = 'error') AS k FROM events GROUP BY user_id) WHERE v IS NOT NULL OR k IS NOT NULL ORDER BY score DESC, user_id LIMIT 20")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("value")))
    both = load(spark, sf_dir, "events").groupBy("user_id").agg(best("view").alias("v"), best("error").alias("k"))
    score = F.coalesce(0.7 * F.col("v") + 0.3 * F.col("k"), "v", "k")
    return both.where("v IS NOT NULL OR k IS NOT NULL").select("user_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "user_id").limit(20)


@query("E36_diagnosis_knowledge", f"SELECT h.doc_id, h.score, md5(substring(d.text, 1, 2000)) AS h FROM ({HYBRID.replace('LIMIT 10', 'LIMIT 5').replace('score >= 0.3', 'score >= 0.0')}) h JOIN documents d USING (doc_id)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best hits over all knowledge bases, their contents cut at 2000 characters."""
    docs = load(spark, sf_dir, "documents")
    hits = search.hybrid_search(docs, load(spark, sf_dir, "embeddings"), TERMS, _probe(spark, sf_dir), 5)
    return docs.join(F.broadcast(hits), "doc_id").select("doc_id", F.round("score", 5).alias("score"), F.md5(F.substring("text", 1, 2000)).alias("h"))  # five rows


# Metrics
@query("F25_rate_by_instance", """
    WITH c AS (SELECT user_id, event_type, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, value) AS prior FROM events)
    SELECT event_type AS instance, round(sum(CASE WHEN value >= prior THEN value - prior WHEN prior IS NOT NULL THEN value ELSE 0 END) / 2592000, 8) AS rate, round(max(value), 6) AS peak FROM c GROUP BY event_type""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = F.lag("value").over(W.partitionBy("user_id", "event_type").orderBy("ts", "value"))
    up = F.when(F.col("value") >= prior, F.col("value") - prior).when(prior.isNotNull(), F.col("value")).otherwise(F.lit(0.0))
    rows = load(spark, sf_dir, "events").withColumn("up", up)
    return rows.groupBy(F.col("event_type").alias("instance")).agg(F.round(F.sum("up") / 2592000, 8).alias("rate"), F.round(F.max("value"), 6).alias("peak"))


@query("F27_stepped_compare", """
    WITH s AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS step, avg(value) AS v FROM events GROUP BY ALL), m AS (SELECT max(step) AS top FROM s),
    p AS (SELECT event_type, avg(v) FILTER (WHERE step > top - INTERVAL 24 HOUR) AS a, avg(v) FILTER (WHERE step <= top - INTERVAL 24 HOUR AND step > top - INTERVAL 48 HOUR) AS b FROM s, m GROUP BY event_type)
    SELECT event_type, round(a - b, 5) AS diff, round(CASE WHEN b <> 0 THEN (a - b) / b * 100 END, 4) AS pct FROM p""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of quarter-hour steps of the last day and of the day before."""
    step = F.window(F.col("ts").cast("timestamp"), "15 minutes")["start"]
    steps = load(spark, sf_dir, "events").groupBy("event_type", step.alias("step")).agg(F.avg("value").alias("v"))
    top = F.broadcast(steps.agg(F.max("step").alias("top")))  # one row
    age = F.col("top") - F.col("step")
    day = F.expr("INTERVAL 24 HOUR")
    means = steps.crossJoin(top).groupBy("event_type").agg(F.avg(F.when(age < day, F.col("v"))).alias("a"), F.avg(F.when((age >= day) & (age < day * 2), F.col("v"))).alias("b"))
    diff = F.col("a") - F.col("b")
    return means.select("event_type", F.round(diff, 5).alias("diff"), F.round(F.when(F.col("b") != 0, diff / F.col("b") * 100), 4).alias("pct"))


@query("F28_key_facts", """
    SELECT 'metric' AS fact, event_type AS name, round(max(value), 4) AS top, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY event_type
    UNION ALL SELECT 'log', CASE WHEN event_type = 'error' THEN 'error' ELSE 'other' END, NULL, NULL, count(*) FROM events GROUP BY 2
    UNION ALL SELECT 'severity', CASE WHEN value > 80 THEN 'critical' WHEN value > 50 THEN 'warning' ELSE 'info' END, NULL, NULL, count(*) FROM events GROUP BY 2""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics, log levels and severities in one pass: each row counts once for each fact."""
    severity = F.when(F.col("value") > 80, "critical").when(F.col("value") > 50, "warning").otherwise("info")
    names = {"metric": F.col("event_type"), "log": F.when(F.col("event_type") == "error", "error").otherwise("other"), "severity": severity}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), n.alias("name")) for k, n in names.items()]))
    rows = load(spark, sf_dir, "events").select(each.alias("f"), "value").select("f.*", F.when(F.col("f.fact") == "metric", F.col("value")).alias("value"))
    return rows.groupBy("fact", "name").agg(F.round(F.max("value"), 4).alias("top"), F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))


@query("H22_ttl_rate_limit", """
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    g AS (SELECT user_id, event_id, i, t AS begun, 1 AS n FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.t >= g.begun + 3600000000 THEN e.t ELSE g.begun END, CASE WHEN e.t >= g.begun + 3600000000 THEN 1 ELSE g.n + 1 END FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1)
    SELECT event_id, n > 2 AS limited FROM g""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter per user that starts with a request and is forgotten an hour later."""
    asked = load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return cluster.limited(asked, 2).select(F.col("id").alias("event_id"), "limited")


@query("H02_tracked_fields", "SELECT event_id, prior IS NULL OR prior <> {'a': event_type, 'b': props, 'c': floor(value), 'd': user_id, 'e': CAST(ts AS DATE), 'f': event_id % 2} AS changed FROM (SELECT *, lag({'a': event_type, 'b': props, 'c': floor(value), 'd': user_id, 'e': CAST(ts AS DATE), 'f': event_id % 2}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any of six tracked fields differs from the state before; a first state is a change."""
    state = F.struct(F.col("event_type").alias("a"), F.col("props").alias("b"), F.floor("value").alias("c"), F.col("user_id").alias("d"), F.to_date("ts").alias("e"), (F.col("event_id") % 2).alias("f"))
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", state.alias("now"))
    prior = F.lag("now").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.select("event_id", (~F.col("now").eqNullSafe(prior)).alias("changed"))


# Texts and tables
@query("D35_table_partitions", """
    WITH r AS (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, i // 400 AS part_index, CAST(ceil(any_value(n) / 400) AS BIGINT) AS part_count, min(i) || '-' || max(i) AS row_range, count(*) AS n FROM r GROUP BY l_returnflag, i // 400""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of more than 400 rows in parts that know their number and range. Rows are numbered by sorted
    ranges: each range counts its rows, and adds those of the ranges before it."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", *order).withColumn("band", F.floor(F.col("l_orderkey") / 100_000))
    before = F.sum("m").over(W.partitionBy("l_returnflag").orderBy("band").rowsBetween(W.unboundedPreceding, -1))
    bands = rows.groupBy("l_returnflag", "band").agg(F.count("*").alias("m"))
    bands = bands.select("l_returnflag", "band", F.coalesce(before, F.lit(0)).alias("skip"), F.sum("m").over(W.partitionBy("l_returnflag")).alias("total"))
    place = F.row_number().over(W.partitionBy("l_returnflag", "band").orderBy(*order)) - 1
    numbered = rows.withColumn("j", place).join(bands, ["l_returnflag", "band"]).withColumn("i", F.col("skip") + F.col("j"))
    parts = numbered.groupBy("l_returnflag", F.floor(F.col("i") / 400).alias("part_index"))
    ranges = F.concat(F.min("i").cast("string"), F.lit("-"), F.max("i").cast("string"))
    return parts.agg(F.ceil(F.max("total") / 400).alias("part_count"), ranges.alias("row_range"), F.count("*").alias("n"))


@query("D38_entities_with_confidence", r"""
    WITH e AS (SELECT conv_id, turn, 'PERSON' AS kind, 0.8::DOUBLE AS confidence, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+'))) AS entity FROM conversations
      UNION ALL SELECT conv_id, turn, 'PLACE', 0.7::DOUBLE, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'))) FROM conversations) SELECT * FROM e""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda pattern, kind, c: F.transform(F.array_distinct(F.regexp_extract_all(doc(), F.lit(f"({pattern})"), F.lit(1))), lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("confidence"), x.alias("entity")))
    both = F.concat(found("[A-Z][a-z]+ [A-Z][a-z]+", "PERSON", 0.8), found("[A-Z][a-z]+(?: [A-Z][a-z]+)*", "PLACE", 0.7))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(both).alias("e")).select("conv_id", "turn", "e.*")


on("D47_duration", "documents", "SELECT doc_id, CASE WHEN t < 60 THEN CAST(CAST(floor(t) AS BIGINT) AS VARCHAR) || 's' WHEN t < 3600 THEN CAST(CAST(floor(t / 60) AS BIGINT) AS VARCHAR) || 'm' ELSE CAST(CAST(floor(t / 3600) AS BIGINT) AS VARCHAR) || 'h' END AS estimate FROM (SELECT doc_id, 10 + n_chars * 97 / 1000 + 30 * (1 - (doc_id % 10) / 10) AS t FROM documents)",
    lambda: ["doc_id", _duration(10 + F.col("n_chars") * 97 / 1000 + 30 * (1 - F.col("doc_id") % 10 / 10)).alias("estimate")])


def _duration(t) -> object:
    whole = lambda unit, name: F.concat(F.floor(t / unit).cast("string"), F.lit(name))
    return F.when(t < 60, whole(1, "s")).when(t < 3600, whole(60, "m")).otherwise(whole(3600, "h"))


on("D04_han_keywords", "conversations", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '测试,系统' ELSE '' END AS words FROM conversations",
    lambda: ["conv_id", "turn", F.array_join(F.transform(_han(F.when(F.col("turn") % 2 == 0, "测试 系统, 测试, 系统 测试 单次").otherwise(doc())), lambda t: t["term"]), ",").alias("words")])


def _han(text) -> object:
    from kbspark.functions.text import counted_terms

    return counted_terms(text, 10, 2, token="[一-鿿]{2,4}")


on("I14_to_boolean", "orders", "SELECT o_orderkey, o_orderkey % 6 < 4 AS flag FROM orders", lambda: ["o_orderkey", F.lower(F.element_at(F.array(*map(F.lit, ("true", "1", "YES", "On", "f", "no"))), (F.col("o_orderkey") % 6 + 1).cast("int"))).isin("true", "1", "yes", "on").alias("flag")])


# Associations
@query("C14_image_chunk_ranges", """
    WITH i AS (SELECT l_orderkey AS d, l_partkey AS i, CAST(l_quantity AS BIGINT) % 20 AS e, 1 + (CAST(l_quantity AS BIGINT) % 20) // 9 AS page FROM lineitem),
    c AS (SELECT l_orderkey AS d, l_linenumber AS c, l_linenumber * 3 AS first, l_linenumber * 3 + 1 AS last, 1 + l_linenumber // 3 AS page FROM lineitem WHERE l_linenumber <= 4),
    b AS (SELECT i.d, i.i, i.e, c.c, CASE WHEN e BETWEEN first AND last THEN 'within_range' WHEN c.page = i.page AND e > last AND e - last <= 10 THEN 'before_image' WHEN c.page = i.page AND first > e AND first - e <= 10 THEN 'after_image' END AS s, c.page = i.page AS same FROM i JOIN c USING (d)),
    hit AS (SELECT DISTINCT d, i, e FROM b WHERE s IS NOT NULL)
    SELECT d, i, e, c, s AS strategy FROM b WHERE s IS NOT NULL UNION ALL SELECT b.d, b.i, b.e, b.c, 'fallback' FROM b ANTI JOIN hit ON hit.d = b.d AND hit.i = b.i AND hit.e = b.e WHERE same""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each image: around it, before or behind it on its page; where none is, all of the page."""
    lines, place, n = load(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long") % 20, F.col("l_linenumber")
    i = lines.select(F.col("l_orderkey").alias("d"), F.col("l_partkey").alias("i"), place.alias("e"), (F.floor(place / 9) + 1).alias("image_page"))
    c = lines.where("l_linenumber <= 4").select(F.col("l_orderkey").alias("d"), n.alias("c"), (n * 3).alias("first"), (n * 3 + 1).alias("last"), (F.floor(n / 3) + 1).alias("page"))
    e, first, last, same = F.col("e"), F.col("first"), F.col("last"), F.col("page") == F.col("image_page")
    strategy = F.when(e.between(first, last), "within_range").when(same & (e > last) & (e - last <= 10), "before_image").when(same & (first > e) & (first - e <= 10), "after_image")
    both = i.join(c, "d").select("d", "i", "e", "c", strategy.alias("strategy"), same.alias("same"))
    hits = both.where("strategy IS NOT NULL")
    left = both.where("same").join(hits.select("d", "i", "e").distinct(), ["d", "i", "e"], "left_anti")
    return hits.drop("same").unionByName(left.select("d", "i", "e", "c", F.lit("fallback").alias("strategy")))


@query("C16_version_pairs", "SELECT a.conv_id, a.turn AS old_version, b.turn AS new_version, md5(a.text || '|' || b.text) AS h FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version with the next one: a self join on the key, as neighbours in one sort."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, sf_dir, "conversations").withColumns({"new_version": F.lead("turn").over(w), "next_text": F.lead("text").over(w)})
    return rows.where("new_version = turn + 1").select("conv_id", F.col("turn").alias("old_version"), "new_version", F.md5(F.concat("text", F.lit("|"), "next_text")).alias("h"))


# What was left of scalar rules and searches
@query("D56_markdown_fallback", r"SELECT conv_id, turn, CAST(len(list_filter(string_split(regexp_replace(text, '[.] ', '.' || chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda x: trim(regexp_replace(x, '\s', '', 'g')) <> '')) AS BIGINT) AS n FROM conversations WHERE NOT contains(text, chr(10))")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph runs, for texts that no Markdown parser takes apart."""
    from kbspark.operators.chunks import paragraphs

    turns = load(spark, sf_dir, "conversations").where(~F.contains("text", F.lit("\n")))
    return turns.select("conv_id", "turn", F.size(paragraphs(F.regexp_replace("text", "[.] ", ".\n\n"))).cast("long").alias("n"))


@query("E04_image_search", "SELECT * FROM (SELECT vec_id, round(s, 6) AS score FROM (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY s DESC, vec_id LIMIT 30) WHERE s >= 0.25 ORDER BY s DESC, vec_id LIMIT 15)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen images: twice as many are recalled, 20 at least and 100 at most, then threshold and cut."""
    from kbspark.operators.retrieval import vector_search

    limit = 15
    found = vector_search(load(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), min(max(2 * limit, 20), 100), 0.25)
    return found.orderBy(F.desc("score"), "vec_id").limit(limit).select("vec_id", F.round("score", 6).alias("score"))


on("B16_title_stem", "events", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'given' WHEN 1 THEN 'named' ELSE 'report.final' END AS title FROM events",
    lambda: ["event_id", _title(F.element_at(F.array(F.lit('{"title": "given", "name": "n"}'), F.lit('{"name": "named"}'), F.lit("{}")), (F.col("event_id") % 3 + 1).cast("int"))).alias("title")])


def _title(meta) -> object:
    from kbspark.functions.values import stem

    return F.coalesce(F.get_json_object(meta, "$.title"), F.get_json_object(meta, "$.name"), stem(F.lit("in/box/report.final.pdf")))


on("E28_missing_bounds", "part", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 10 WHEN p_size > 40 THEN 15 WHEN p_size < 10 THEN 7 ELSE 10 END AS threshold FROM part",
    lambda: ["p_partkey", _threshold(F.when(F.col("p_size") % 5 != 0, F.col("p_size"))).alias("threshold")])


def _threshold(span) -> object:
    """Ten; more for wide chunks, less for narrow ones; ten as well where a bound is missing."""
    return F.when(span.isNull(), 10).when(span > 40, 15).when(span < 10, 7).otherwise(10)


on("I04_time_parts", "orders", "SELECT o_orderkey, CAST(86400 * (o_orderkey % 5) + 61 AS BIGINT) AS seconds FROM orders", lambda: ["o_orderkey", (F.unix_timestamp((F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 5).cast("int"), F.lit(0), F.lit(1), F.lit(1))).cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("seconds")])
on("I06_epoch_back", "events", "SELECT event_id, date_trunc('second', ts) AS t FROM events", lambda: ["event_id", F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp"))).cast("timestamp_ntz").alias("t")])
on("I17_unique_list", "conversations", "SELECT conv_id, turn, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), ' ') AS words FROM (SELECT conv_id, turn, string_split(text, ' ') AS k FROM conversations)", lambda: ["conv_id", "turn", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words")])
on("I16_flatten_nested", "part", "SELECT p_partkey, p_name || '|' || p_brand || '|' || p_type AS s FROM part", lambda: ["p_partkey", F.array_join(F.flatten(F.flatten(F.array(F.array(F.array("p_name"), F.array("p_brand")), F.array(F.array("p_type"))))), "|").alias("s")])
on("I20_sha512", "part", "SELECT p_partkey, 128 AS n FROM part", lambda: ["p_partkey", F.length(F.sha2("p_name", 512)).alias("n")])
on("I24_length_rule", "part", "SELECT p_partkey, p_size % 4 <> 0 AS at_least_one, true AS at_least_none FROM part",
    lambda: ["p_partkey", *[_length_ok(F.when(F.col("p_size") % 4 != 0, F.col("p_name")), least).alias(n) for least, n in ((1, "at_least_one"), (0, "at_least_none"))]])


def _length_ok(text, least: int, most: int = 255) -> object:
    """Inclusive bounds; a null is valid only where nothing is asked for."""
    return F.coalesce(F.length(text).between(least, most), F.lit(least == 0))


on("I26_three_validators", "conversations", "SELECT conv_id, turn, trim(text) <> '' AND length(text) <= 255 AS name_ok, trim(text) <> '' AND length(text) <= 500 AS title_ok, trim(text) <> '' AND length(text) <= 1000 AS query_ok FROM conversations",
    lambda: ["conv_id", "turn", *[((F.trim("text") != "") & (F.length("text") <= n)).alias(c) for c, n in (("name_ok", 255), ("title_ok", 500), ("query_ok", 1000))]])
