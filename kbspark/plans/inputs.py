"""Scalar rules on text and values spliced together from the tables, so that every row has an input of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.functions import rules as R
from kbspark.functions import values as V
from kbspark.operators import search
from kbspark.plans.more_rules import _han
from kbspark.plans.native import BM25, TERMS, TOK, _probe, on, query
from kbspark.plans.rules import _intent
from kbspark.plans.search import HYBRID, NEAR
from kbspark.sources import files, pdfpages, sinks
from kbspark.sources.tables import load


def text(*parts: object) -> Column:
    """Columns and literals in a row."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


c = F.col

# Web results: the first ten with an address, the title of the page or else the address
@query("B13_result_page", r"""
    SELECT page_id, url, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), url) AS title, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS source
    FROM pages WHERE coalesce(url, '') <> '' ORDER BY page_id LIMIT 10""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("")), c("url"))
    rows = load(spark, sf_dir, "pages").where(F.coalesce("url", F.lit("")) != "").orderBy("page_id").limit(10)
    return rows.select("page_id", "url", title.alias("title"), F.parse_url("url", F.lit("HOST")).alias("source"))


on("B15_image_names", "part", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN lower(replace(p_brand, '#', '')) ELSE 'unknown' END AS kind FROM part",
    lambda: ["p_partkey", F.lower(F.replace(F.coalesce(F.when(c("p_size") % 3 == 0, text(".", c("p_type"))), F.nullif(F.regexp_extract(F.when(c("p_size") % 3 == 1, text("a/", c("p_name"), ".", F.replace("p_brand", F.lit("#"), F.lit("")))).otherwise(c("p_name")), r"\.([^./]+)$", 1), F.lit("")), F.lit("unknown")), F.lit("."), F.lit(""))).alias("kind")])
on("B16_titles", "part", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_type || '.' || p_size END AS title FROM part",
    lambda: ["p_partkey", F.coalesce(_given(c("p_size")), V.stem(text("in/box/", c("p_type"), ".", c("p_size"), ".pdf"))).alias("title")])


def _given(size: Column) -> Column:
    """The title or name of a part's metadata, of which a third has the first, a third the second, a third neither."""
    meta = F.when(size % 3 == 0, F.to_json(F.struct(c("p_name").alias("title"), c("p_brand").alias("name")))).when(size % 3 == 1, F.to_json(F.struct(c("p_brand").alias("name")))).otherwise("{}")
    return F.coalesce(F.get_json_object(meta, "$.title"), F.get_json_object(meta, "$.name"))


on("B20_hedged_turns", "conversations", r"SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ +| +$', '', 'g') ELSE '可能 ' || text || ' 似乎' END) AS h FROM conversations",
    lambda: ["conv_id", "turn", F.md5(R.without_hedges(text("可能 ", c("text"), " 似乎"), F.when(c("turn") % 2 == 0, 0.9).otherwise(0.5))).alias("h")])
on("B23_intents", "events", """
    SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN CASE event_type WHEN 'view' THEN 'news' ELSE 'tech' END WHEN event_type = 'error' THEN 'tech' WHEN event_type = 'purchase' THEN 'news' ELSE 'general' END AS intent FROM events""",
    lambda: ["event_id", _intent(F.when(c("event_type") == "view", text('{"intent": "news", "props": ', c("props"), "}")).when(c("event_type") == "click", text('{"intent": "tech", "id": ', c("event_id"), "}"))
        .when(c("event_type") == "error", text('{"intent": "', c("event_type"), '", "of": "Tech"}')).when(c("event_type") == "purchase", text("some News of ", c("user_id"), " ", c("props"))).otherwise(c("event_type"))).alias("intent")])
on("H12_spliced_lines", "events", """
    SELECT event_id, event_type IN ('error', 'view', 'purchase') AS is_error FROM events""",
    lambda: ["event_id", R.is_error_line(F.when(c("event_type") == "error", text(c("ts"), " [", c("event_type"), "] ", c("props"))).when(c("event_type") == "view", text(c("props"), " caused by: java.net.Timeout ", c("value")))
        .when(c("event_type") == "purchase", text("warning of user ", c("user_id"))).when(c("event_type") == "click", text("no error in ", c("props"), " [error")).otherwise(text(c("user_id"), " all is well ", c("props")))).alias("is_error")])

# Keywords of Han runs: letters of the turns written as Han ones
LATIN, HAN = "abcdefghijklmnopqrstuvwxyz", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"


@query("D04_written_keywords", f"""
    WITH r AS (SELECT conv_id, turn, regexp_extract_all(translate(lower(text), '{LATIN}', '{HAN}'), '[一-鿿]{{2,4}}') AS k FROM conversations),
    e AS (SELECT conv_id, turn, unnest(k) AS term, unnest(range(len(k))) AS i FROM r), n AS (SELECT conv_id, turn, term, count(*) AS n, min(i) AS i FROM e GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, i) AS rank FROM n)
    SELECT conv_id, turn, coalesce((SELECT string_agg(term, ',' ORDER BY rank) FROM t WHERE t.conv_id = r.conv_id AND t.turn = r.turn AND rank <= 10 AND n >= 2), '') AS words FROM r""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.translate(F.lower("text"), LATIN, HAN)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(_han(written), lambda t: t["term"]), ",").alias("words"))


# Times, truth values, files, digests
@query("I04_order_to_ship", "SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days, epoch(l_shipdate) - epoch(o_orderdate) AS seconds FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), c("o_orderkey") == c("l_orderkey"))
    seconds = F.unix_timestamp(c("l_shipdate").cast("timestamp")) - F.unix_timestamp(c("o_orderdate").cast("timestamp"))
    return both.select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"), seconds.cast("double").alias("seconds"))


def truth(value: Column, number: Column | None = None) -> Column:
    """Of a string by its words, of a number by its being other than zero."""
    words = F.coalesce(F.lower(value).isin("true", "1", "yes", "on"), F.lit(False))
    return words if number is None else F.when(number.isNotNull(), number != 0).otherwise(words)


on("I14_truths", "lineitem", "SELECT l_orderkey, l_linenumber, l_tax <> 0 AS by_number, substring(CAST(l_quantity AS VARCHAR), 1, 1) = '1' AS by_digit, l_linestatus = 'O' AS by_word FROM lineitem",
    lambda: ["l_orderkey", "l_linenumber", truth(F.lit("no"), c("l_tax")).alias("by_number"), truth(F.substring(c("l_quantity").cast("string"), 1, 1)).alias("by_digit"), truth(text(c("l_linestatus"), F.when(c("l_linestatus") == "O", "N").otherwise("FF"))).alias("by_word")])
on("I20_sha512_digest", "part", None, lambda: ["p_partkey", V.hashed(c("p_name"), "sha512").alias("sha512")])
on("I22_page_files", "pages", r"SELECT page_id, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1) || '.' || CASE WHEN length(url) % 2 = 0 THEN 'PDF' ELSE 'exe' END, '[^/]\.([^./]+)$', 1)) AS ext, length(url) % 2 = 0 AND regexp_extract(url, '([^/]*)$', 1) <> '' AS allowed FROM pages",
    lambda: ["page_id", *[f(text("d/", F.regexp_extract("url", "([^/]*)$", 1), ".", F.when(F.length("url") % 2 == 0, "PDF").otherwise("exe"))).alias(n) for n, f in (("ext", V.extension), ("allowed", V.allowed_type))]])
on("A14_varied_schemas", "orders", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '{"properties": {"a": {"items": {"type": "integer"}, "type": "array"}}, "type": "object"}' WHEN 'O' THEN '{"properties": {"s": {"type": "string"}}, "type": "object"}' ELSE '{"properties": {"n": {"type": "number"}}, "type": "object"}' END AS schema FROM orders""",
    lambda: ["o_orderkey", files.json_schema(F.when(c("o_orderstatus") == "F", text('{"a": [', c("o_custkey"), "]}")).when(c("o_orderstatus") == "O", text('{"s": "', c("o_orderpriority"), '"}')).otherwise(text('{"n": ', c("o_custkey"), ".5}"))).alias("schema")])

# A resource's five fields against its state before, with both values of those that differ
def _fields() -> dict[str, Column]:
    return {"event_type": c("event_type"), "value": F.floor(c("value") / 50).cast("string"), "props": c("props"), "day": F.dayofmonth("ts").cast("string"), "parity": (c("event_id") % 2).cast("string")}


@query("H03_five_fields", """
    WITH s AS (SELECT user_id, event_id, ts, [event_type, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR), props, CAST(day(ts) AS VARCHAR), CAST(event_id % 2 AS VARCHAR)] AS now FROM events),
    p AS (SELECT *, lag(now) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM s)
    SELECT user_id, event_id, CASE WHEN prior IS NULL THEN '' ELSE array_to_string(list_filter(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN prior[i] IS DISTINCT FROM now[i]
      THEN ['event_type', 'value', 'props', 'day', 'parity'][i] || ':' || coalesce(prior[i], '') || '>' || coalesce(now[i], '') END), lambda x: x IS NOT NULL), ';') END AS changed FROM p""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _fields()
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.struct(*[v.alias(n) for n, v in fields.items()]).alias("now"))
    rows = rows.withColumn("prior", F.lag("now").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.select("user_id", "event_id", F.array_join(R.field_changes(c("prior"), c("now"), list(fields)), ";").alias("changed"))


# The rows of every search mode, none of them typed in
@query("E31_search_modes", f"""
    WITH x AS ({BM25.strip()[5:].join(["WITH ", " SELECT doc_id, s FROM b ORDER BY s DESC, doc_id LIMIT 10"])}),
    v AS (SELECT doc_id, v FROM (SELECT doc_id, greatest(0, least(1, v)) AS v FROM ({NEAR}) ORDER BY v DESC, doc_id LIMIT 30) ORDER BY v DESC, doc_id LIMIT 10), h AS ({HYBRID}),
    e AS (SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOK}, ' ') || ' ', ' the thing license ') ORDER BY doc_id LIMIT 10)
    SELECT 'keyword' AS mode, doc_id, round(s, 5) AS score FROM x UNION ALL SELECT 'vector', doc_id, round(v, 5) FROM v UNION ALL SELECT 'any other', doc_id, score FROM h UNION ALL SELECT 'exact', doc_id, 1.0 FROM e""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows, probe = load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings"), _probe(spark, sf_dir)
    least = {"any other": 0.3}
    found = [search.search(docs, rows, " ".join(TERMS), probe, mode, 10, least.get(mode, 0.0)).select(F.lit(mode).alias("mode"), "doc_id", F.round("score", 5).alias("score")) for mode in ("keyword", "vector", "any other", "exact")]
    return reduce(DataFrame.unionByName, found)


@query("A10_pdf_pages", r"SELECT conv_id, turn, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS lines, md5(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS h FROM conversations WHERE regexp_matches(text, '[A-Za-z0-9]')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a page of lines, written and read again in reading order."""
    turns = load(spark, sf_dir, "conversations").where(c("text").rlike("[A-Za-z0-9]"))
    made = turns.select(text(c("conv_id"), "/", c("turn")).alias("path"), sinks.pdf_file(F.split("text", "\n")).alias("content"))
    read = pdfpages.page_lines(made).groupBy("path").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("page", "line", "text"))).alias("l"))
    body = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["text"]), ""), "[^A-Za-z0-9]", "")
    part = lambda i: F.split("path", "/")[i].cast("long")
    return read.select(part(0).alias("conv_id"), part(1).alias("turn"), "lines", F.md5(body).alias("h"))
