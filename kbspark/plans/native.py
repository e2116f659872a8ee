"""Queries through the library's own functions and operators, each with an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.functions import text as T
from kbspark.operators import filters, retrieval
from kbspark.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TERMS = ["the", "thing", "license"]
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    if name in QUERIES:
        raise ValueError(f"{name} is registered already")

    def put(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return put


def on(name: str, table: str, sql: str, columns: Callable[[], list]) -> None:
    """A query that is one projection of a table; its columns are made when it runs."""
    query(name, sql)(lambda spark, sf_dir: load(spark, sf_dir, table).select(*columns()))


def doc() -> Column:
    return F.col("text")

# Filters and predicates
query("B01_filter_compiler", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 500 AND n_chars < 4000 AND source IN ('src1', 'src2', 'src3')")(
    lambda s, d: load(s, d, "documents").where(filters.compile_filters({"lang": "en", "n_chars": {"gte": 500, "lt": 4000}, "source": {"in": ["src1", "src2", "src3"]}})).select("doc_id", "lang", "n_chars")
)
query("B04_threshold_after_top_k", "SELECT * FROM (SELECT event_id, round(value, 6) AS score FROM events ORDER BY value DESC, event_id LIMIT 50) WHERE score >= 99.9")(
    lambda s, d: load(s, d, "events").orderBy(F.desc("value"), "event_id").limit(50).select("event_id", F.round("value", 6).alias("score")).where("score >= 99.9")
)
query("B10_lexical_match", f"SELECT doc_id FROM documents WHERE list_has_any({TOK}, ['license', 'reserved'])")(
    lambda s, d: load(s, d, "documents").where(F.arrays_overlap(T.tokens(doc()), F.array(F.lit("license"), F.lit("reserved")))).select("doc_id")
)
query("B11_phrase_match", f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({TOK}, ' ') || ' ' AS k FROM documents) WHERE contains(k, ' all rights reserved ')")(
    lambda s, d: load(s, d, "documents").where(T.has_phrase(T.tokens(doc()), ["all", "rights", "reserved"])).select("doc_id")
)
on("B13_result_normalise", "pages", r"SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages WHERE url IS NOT NULL", lambda: ["page_id", "url", F.parse_url("url", F.lit("HOST")).alias("host")])
on("B15_image_type", "part", "SELECT p_partkey, lower(replace(coalesce(nullif(p_type, ''), 'unknown'), '.', '')) AS kind FROM part", lambda: ["p_partkey", F.lower(F.replace(F.coalesce(F.nullif("p_type", F.lit("")), F.lit("unknown")), F.lit("."), F.lit(""))).alias("kind")])
on("B16_title", "events", "SELECT event_id, coalesce(json_extract_string(props, '$.title'), json_extract_string(props, '$.k'), 'untitled') AS title FROM events", lambda: ["event_id", F.coalesce(F.get_json_object("props", "$.title"), F.get_json_object("props", "$.k"), F.lit("untitled")).alias("title")])
RISKY = ["token", "password", "secret"]
on("B19_suspicious_keywords", "documents", "SELECT doc_id, array_to_string(list_filter(['token', 'password', 'secret'], lambda w: contains(lower(text), w)), ',') AS found FROM documents", lambda: ["doc_id", F.array_join(F.filter(F.array(*map(F.lit, RISKY)), lambda w: F.contains(F.lower(doc()), w)), ",").alias("found")])
on("B20_vague_words", "conversations", r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '(maybe|perhaps|the)', '', 'g'), '[ \t]+', ' ', 'g')) AS text FROM conversations", lambda: ["conv_id", "turn", F.trim(F.regexp_replace(F.regexp_replace(doc(), "(maybe|perhaps|the)", ""), "[ \t]+", " ")).alias("text")])
on("B23_intent", "conversations", "SELECT conv_id, turn, CASE WHEN lower(text) LIKE '%news%' THEN 'news' WHEN lower(text) LIKE '%tech%' THEN 'tech' ELSE 'general' END AS intent FROM conversations", lambda: ["conv_id", "turn", F.when(F.lower(doc()).contains("news"), "news").when(F.lower(doc()).contains("tech"), "tech").otherwise("general").alias("intent")])

# Text functions
BRACKETS = r"""[^\p{L}\p{N}_\s一-鿿.,!?;:()\[\]{}"''-]"""
on("D01_clean", "documents", rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '{BRACKETS}', '', 'g'))) AS h FROM documents", lambda: ["doc_id", F.md5(T.clean(doc())).alias("h")])
on("D02_bare", "documents", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))) AS h FROM documents", lambda: ["doc_id", F.md5(T.bare(doc())).alias("h")])


@query("D03_keywords", rf"""
    WITH t AS (SELECT doc_id, {TOK} AS k FROM documents),
    e AS (SELECT doc_id, unnest(k) AS term, unnest(range(len(k))) AS pos FROM t),
    c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first_pos FROM e WHERE length(term) > 2 AND NOT list_contains({STOPS}, term) GROUP BY ALL)
    SELECT doc_id, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rn FROM c) WHERE rn <= 5""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.counted_terms(F.lower(doc()), 5, longer=2, drop=T.STOP_WORDS)
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("t")).select("doc_id", "t.term", "t.n")


SHORT = "[" + ", ".join(f"'{w}'" for w in T.SHORT_STOP_WORDS) + "]"


@query("D05_keywords_en", rf"""
    WITH t AS (SELECT doc_id, list_filter({TOK}, lambda w: regexp_full_match(w, '[a-z]{{2,10}}')) AS k FROM documents WHERE lang = 'en'),
    e AS (SELECT doc_id, unnest(k) AS term, unnest(range(len(k))) AS pos FROM t),
    c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first_pos FROM e WHERE NOT list_contains({SHORT}, term) GROUP BY ALL)
    SELECT doc_id, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rn FROM c) WHERE rn <= 10 AND n > 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = T.counted_terms(F.lower(doc()), 10, 2, word="[a-z]{2,10}", drop=T.SHORT_STOP_WORDS)
    found = load(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.explode(terms).alias("t"))
    return found.select("doc_id", "t.term", "t.n")


SIX = ["的", "是", "在", "有", "和", "the", "is", "in", "and"]
on("D06_first_keywords", "conversations", "SELECT conv_id, turn, array_to_string(list_slice(list_filter(string_split(text, ' '), lambda w: length(w) > 1 AND NOT list_contains(['的','是','在','有','和','the','is','in','and'], w)), 1, 10), ' ') AS k FROM conversations", lambda: ["conv_id", "turn", F.array_join(F.slice(F.filter(F.split(doc(), " "), lambda w: (F.length(w) > 1) & ~w.isin(*SIX)), 1, 10), " ").alias("k")])
COUNT = "length(text) - length(regexp_replace(text, '{}', '', 'g'))"
on("D07_language_ratio", "documents", rf"""
    SELECT doc_id, CASE WHEN w = 0 THEN 'unknown' WHEN h / w > 0.3 THEN 'zh' WHEN l / w > 0.3 THEN 'en' ELSE 'mixed' END AS language FROM (
    SELECT doc_id, {COUNT.format(r'[\p{L}\p{N}_]')} AS w, {COUNT.format('[一-鿿]')} AS h, {COUNT.format('[a-zA-Z]')} AS l FROM documents)""", lambda: ["doc_id", T.language(doc()).alias("language")])
def _letters(kind: str) -> Column:
    return F.length(doc()) - F.length(F.regexp_replace(doc(), kind, ""))


on("D08_language_majority", "documents", f"SELECT doc_id, CASE WHEN h > l THEN 'zh' WHEN l > h THEN 'en' ELSE 'mixed' END AS language FROM (SELECT doc_id, {COUNT.format('[一-鿿]')} AS h, {COUNT.format('[a-zA-Z]')} AS l FROM documents)", lambda: ["doc_id", F.when(_letters("[一-鿿]") > _letters("[a-zA-Z]"), "zh").when(_letters("[a-zA-Z]") > _letters("[一-鿿]"), "en").otherwise("mixed").alias("language")])
on("D09_format_issues", "documents", rf"""
    SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) > 10000 THEN 'long' END, CASE WHEN trim(text) = '' THEN 'blank' END,
      CASE WHEN length(text) > 0 AND (length(text) - length(replace(text, chr(10), ''))) / length(text) > 0.5 THEN 'newlines' END,
      CASE WHEN length(text) > 0 AND (length(text) - length(regexp_replace(text, '{BRACKETS}', '', 'g'))) / length(text) > 0.1 THEN 'special' END], lambda x: x IS NOT NULL), ',') AS issues FROM documents""",
    lambda: ["doc_id", F.concat_ws(",", F.when(F.length(doc()) > 10000, "long"), F.when(F.trim(doc()) == "", "blank"),
      F.when((F.length(doc()) > 0) & ((F.length(doc()) - F.length(F.replace(doc(), F.lit("\n"), F.lit("")))) / F.length(doc()) > 0.5), "newlines"),
      F.when((F.length(doc()) > 0) & ((F.length(doc()) - F.length(F.regexp_replace(doc(), T.SPECIAL, ""))) / F.length(doc()) > 0.1), "special")).alias("issues")])
on("D19_decorative", "part", "SELECT p_partkey, length(t) <= 2 OR (length(t) >= 3 AND len(list_distinct(string_split(t, ''))) <= 2) AS decorative FROM (SELECT p_partkey, trim(p_brand) AS t FROM part)", lambda: ["p_partkey", ((F.length(F.trim("p_brand")) <= 2) | (F.size(F.array_distinct(F.split(F.trim("p_brand"), ""))) <= 2)).alias("decorative")])


@query("D23_line_count", r"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS n_lines FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split(doc(), "\n"), lambda x: F.trim(x) != "")).cast("long").alias("n_lines"))


@query("D24_section_hint", r"""
    SELECT hint, count(*) AS n FROM (SELECT CASE WHEN t = '' THEN 'paragraph' WHEN starts_with(t, '#') THEN 'heading' WHEN regexp_matches(t, '^[=-]{3,}$') THEN 'divider'
      WHEN regexp_matches(t, '^[0-9]+([.][0-9]+)*\s') THEN 'heading' WHEN length(t) <= 80 AND t = upper(t) AND t <> lower(t) THEN 'heading'
      WHEN length(t) <= 60 AND suffix(t, ':') THEN 'heading' ELSE 'paragraph' END AS hint
    FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS t FROM documents)) GROUP BY hint""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents").select(F.explode(F.split(doc(), "\n")).alias("line"))
    return lines.groupBy(T.section_hint(F.col("line")).alias("hint")).agg(F.count("*").alias("n"))


@query("D31_window_chunks", r"""
    SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, md5(c) AS h FROM (SELECT doc_id, unnest(k) AS c, unnest(range(len(k))) AS i FROM (
      SELECT doc_id, list_filter(list_transform(range(0, CAST(length(text) AS BIGINT), 800), lambda i: trim(substring(text, i + 1, 1000))), lambda x: x <> '') AS k FROM documents))""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.windows(doc(), 1000, 200)).alias("chunk_index", "c"))
    return chunks.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("c").alias("h"))


@query("D33_window_stats", """
    WITH r AS (SELECT l_orderkey, l_extendedprice, floor((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) / 2) AS w FROM lineitem)
    SELECT l_orderkey, CAST(w AS BIGINT) AS win, round(min(l_extendedprice), 4) AS lo, round(max(l_extendedprice), 4) AS hi, count(*) AS n FROM r GROUP BY ALL""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", F.floor((rn - 1) / 2).alias("win"))
    return rows.groupBy("l_orderkey", "win").agg(F.round(F.min("l_extendedprice"), 4).alias("lo"), F.round(F.max("l_extendedprice"), 4).alias("hi"), F.count("*").alias("n"))


@query("D35_table_parts", "SELECT p_brand, CAST(floor((rn - 1) / 40) AS BIGINT) AS part_index, count(*) AS n, min(p_partkey) AS first_key FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    rows = load(spark, sf_dir, "part").select("p_brand", "p_partkey", F.floor((rn - 1) / 40).alias("part_index"))
    return rows.groupBy("p_brand", "part_index").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


QUERIES["D36_first_element"] = lambda s, d: (
    load(s, d, "conversations").withColumn("rn", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).where("rn = 1").select("conv_id", "turn")
)
SQL["D36_first_element"] = "SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY conv_id"
DATES, NUMBERS = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", r"[0-9]+\.?[0-9]*"
#: Unicode letters count as word characters at the border of a name, as in the fixed patterns.
NAMES = [r"[A-Z][a-z]+ [A-Z][a-z]+", r"(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]+"]
PLACES = [r"[A-Z][a-z]+ (?:City|Town|State|Country|Province)"]
DAYS = [r"[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", DATES]
COUNTS = [NUMBERS, r"[0-9]{1,3}(?:,[0-9]{3})*"]


def _entities_sql(patterns: list[str], border: str = "") -> str:
    text = r"regexp_replace(text, '[^\x00-\x7F\P{L}]', '_', 'g')" if border else "text"
    every = ", ".join(f"regexp_extract_all({text}, '{border}{p}{border}')" for p in patterns)
    return f"array_to_string(list_sort(list_distinct(flatten([{every}]))), ',')"


def _entities(patterns: list[str], border: str = "") -> Column:
    every = [F.regexp_extract_all(doc(), F.lit(f"({border}{p}{border})"), F.lit(1)) for p in patterns]
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*every)))), ",")


on("D37_entities", "documents", rf"SELECT doc_id, {_entities_sql(COUNTS)} AS numbers, {_entities_sql(DAYS)} AS dates, {_entities_sql(NAMES, chr(92) + 'b')} AS persons, {_entities_sql(PLACES, chr(92) + 'b')} AS places FROM documents",
    lambda: ["doc_id", _entities(COUNTS).alias("numbers"), _entities(DAYS).alias("dates"), _entities(NAMES, r"\b").alias("persons"), _entities(PLACES, r"\b").alias("places")])
on("D38_person_place", "documents", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')) AS BIGINT) AS persons, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+( [A-Z][a-z]+)*')) AS BIGINT) AS places FROM documents", lambda: ["doc_id", F.size(F.regexp_extract_all(doc(), F.lit("([A-Z][a-z]+ [A-Z][a-z]+)"), F.lit(1))).cast("long").alias("persons"), F.size(F.regexp_extract_all(doc(), F.lit("([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), F.lit(1))).cast("long").alias("places")])
on("D39_intent", "conversations", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'what') THEN 'factual_qa' WHEN contains(lower(text), 'how') THEN 'operation_guide' WHEN contains(lower(text), 'compare') THEN 'comparison_analysis' ELSE 'factual_qa' END AS intent FROM conversations", lambda: ["conv_id", "turn", F.when(F.lower(doc()).contains("what"), "factual_qa").when(F.lower(doc()).contains("how"), "operation_guide").when(F.lower(doc()).contains("compare"), "comparison_analysis").otherwise("factual_qa").alias("intent")])
on("D40_mask", "documents", "SELECT doc_id, md5(replace(replace(text, 'idiot', '*****'), 'trash', '*****')) AS h FROM documents", lambda: ["doc_id", F.md5(T.mask(doc(), ["idiot", "trash"])).alias("h")])


@query("D41_jaccard", f"""
    WITH a AS (SELECT doc_id, list_distinct({TOK}) AS k FROM documents), q AS (SELECT list_distinct({TOK}) AS k FROM benchmark WHERE item_id = 0)
    SELECT a.doc_id, round(CASE WHEN len(a.k) + len(q.k) = 0 THEN 0 ELSE len(list_intersect(a.k, q.k)) / (len(a.k) + len(q.k) - len(list_intersect(a.k, q.k))) END, 6) AS sim FROM a, q""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = load(spark, sf_dir, "benchmark").where("item_id = 0").select(F.array_distinct(T.tokens(doc())).alias("q"))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.tokens(doc())).alias("k"))
    return docs.crossJoin(F.broadcast(probe)).select("doc_id", F.round(T.jaccard(F.col("k"), F.col("q")), 6).alias("sim"))  # one row


on("D42_sentences", "documents", r"SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS BIGINT) AS n FROM documents", lambda: ["doc_id", F.size(T.sentences(doc())).cast("long").alias("n")])
on("D46_risk", "lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.5 OR l_quantity >= 1000 THEN 'high' WHEN l_quantity > 40 THEN 'medium' ELSE 'low' END AS risk FROM lineitem", lambda: ["l_orderkey", "l_linenumber", F.when((F.col("l_discount") * 10 >= 0.5) | (F.col("l_quantity") >= 1000), "high").when(F.col("l_quantity") > 40, "medium").otherwise("low").alias("risk")])
def _time() -> Column:
    return 10 + F.col("n_chars") / 1000


on("D47_time_estimate", "documents", "SELECT doc_id, CASE WHEN t < 60 THEN CAST(CAST(floor(t) AS BIGINT) AS VARCHAR) || 's' ELSE CAST(CAST(floor(t / 60) AS BIGINT) AS VARCHAR) || 'm' END AS estimate FROM (SELECT doc_id, 10 + n_chars / 1000 AS t FROM documents)", lambda: ["doc_id", F.when(_time() < 60, F.concat(F.floor(_time()).cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(_time() / 60).cast("string"), F.lit("m"))).alias("estimate")])
on("D48_hashes", "documents", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents", lambda: ["doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256")])
query("D49_highlight", "SELECT doc_id, replace(substring(text, CAST(greatest(strpos(text, 'License') - 30, 1) AS BIGINT), 150), 'License', '<mark>License</mark>') AS fragment FROM documents WHERE contains(text, 'License')")(
    lambda s, d: load(s, d, "documents").where(doc().contains("License")).select("doc_id", F.replace(F.substring(doc(), F.greatest(F.instr(doc(), "License") - 30, F.lit(1)), F.lit(150)), F.lit("License"), F.lit("<mark>License</mark>")).alias("fragment"))
)
on("D50_literal_highlight", "conversations", "SELECT conv_id, turn, md5(replace(text, 'the', '<em>the</em>')) AS h FROM conversations", lambda: ["conv_id", "turn", F.md5(F.replace(doc(), F.lit("the"), F.lit("<em>the</em>"))).alias("h")])
on("D51_answer_cleanup", "documents", r"SELECT doc_id, md5(trim(regexp_replace(replace(text, chr(13), ''), '\n{3,}', chr(10) || chr(10), 'g'))) AS h FROM documents", lambda: ["doc_id", F.md5(F.trim(F.regexp_replace(F.replace(doc(), F.lit("\r"), F.lit("")), r"\n{3,}", "\n\n"))).alias("h")])
on("D54_query_normalise", "conversations", r"SELECT conv_id, turn, lower(substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 100)) AS q FROM conversations", lambda: ["conv_id", "turn", F.lower(F.substring(F.trim(F.regexp_replace(doc(), r"\s+", " ")), 1, 100)).alias("q")])
MAIL, PHONE = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", r"^1[3-9][0-9]{9}$"
on("D55_validation", "pages", rf"SELECT page_id, regexp_matches(url, '{MAIL}') AS is_mail, regexp_matches(url, '{PHONE}') AS is_phone, regexp_matches(url, '^https?://[^ ]+$') AS is_url FROM pages", lambda: ["page_id", F.col("url").rlike(MAIL).alias("is_mail"), F.col("url").rlike(PHONE).alias("is_phone"), F.col("url").rlike("^https?://[^ ]+$").alias("is_url")])

# Retrieval
COS = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"


@query("E01_cosine", f"SELECT e.vec_id, {COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    one = F.broadcast(rows.where("vec_id = 0").select(F.col("embedding").alias("q")))
    return rows.crossJoin(one).select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))  # one row


BM25 = f"""
    WITH t AS (SELECT doc_id, {TOK} AS k FROM documents), s AS (SELECT count(*) AS n, avg(len(k)) AS avgdl FROM t),
    q AS (SELECT unnest(['the', 'thing', 'license']) AS term), tf AS (SELECT doc_id, term, len(list_filter(k, lambda x: x = term)) AS tf, len(k) AS dl FROM t, q),
    df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term), b AS (
    SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY doc_id)"""


@query("E02_bm25_search", BM25 + " SELECT doc_id, round(s, 6) AS score FROM b ORDER BY score DESC, doc_id LIMIT 30")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.bm25(load(spark, sf_dir, "documents"), TERMS).select("doc_id", F.round("score", 6).alias("score"))
    return found.orderBy(F.desc("score"), "doc_id").limit(30)


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    return load(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query("E03_vector_search", f"SELECT * FROM (SELECT e.vec_id, {COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 30) WHERE score >= 0.2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.vector_search(load(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 30, 0.2)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query("E05_hybrid_fusion", BM25 + f""", v AS (SELECT e.vec_id AS doc_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS v FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
    SELECT coalesce(v.doc_id, b.doc_id) AS doc_id, round(0.5 * coalesce(v, 0) + 0.5 * coalesce(s, 0), 5) AS score FROM v FULL OUTER JOIN b ON v.doc_id = b.doc_id""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    vectors = retrieval.vector_search(rows, _probe(spark, sf_dir), None).withColumnRenamed("vec_id", "doc_id")
    keyword = retrieval.bm25(load(spark, sf_dir, "documents"), TERMS)
    return retrieval.fuse(vectors, keyword).select("doc_id", F.round("score", 5).alias("score"))


@query("E07_min_score_fallback", BM25 + ", r AS (SELECT doc_id, round(s, 6) AS score FROM b) SELECT doc_id, score FROM r WHERE score >= 99 OR NOT (SELECT bool_or(score >= 99) FROM r)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.passing_or_all(retrieval.bm25(load(spark, sf_dir, "documents"), TERMS).select("doc_id", F.round("score", 6).alias("score")), 99.0)


query("E08_exact_phrase", SQL["B11_phrase_match"] + " ORDER BY doc_id LIMIT 1000")(lambda s, d: QUERIES["B11_phrase_match"](s, d).orderBy("doc_id").limit(1000))
query("E09_advanced_search", f"SELECT doc_id FROM (SELECT doc_id, {TOK} AS k FROM documents) WHERE list_contains(k, 'the') AND len(list_filter(k, lambda w: regexp_matches(w, '^lic.*e$'))) > 0")(
    lambda s, d: load(s, d, "documents").where(retrieval.let(T.tokens(doc()), lambda k: filters.boolean_query("the", k) & filters.any_term(k, "lic*e"))).select("doc_id")
)
query("E10_boolean_query", f"SELECT doc_id FROM (SELECT doc_id, {TOK} AS k FROM documents) WHERE (list_contains(k, 'license') OR list_contains(k, 'reserved')) AND NOT list_contains(k, 'mit')")(
    lambda s, d: load(s, d, "documents").where(retrieval.let(T.tokens(doc()), lambda k: filters.boolean_query("(license OR reserved) AND NOT mit", k))).select("doc_id")
)
on("E13_token_overlap", "documents", "SELECT doc_id, round(len(list_intersect(['the', 'license', 'version'], list_distinct(string_split(text, ' ')))) / 3, 6) AS score FROM documents", lambda: ["doc_id", F.round(T.overlap(F.array(F.lit("the"), F.lit("license"), F.lit("version")), F.split(doc(), " ")), 6).alias("score")])
def _dots() -> Column:
    return F.length(doc()) - F.length(F.replace(doc(), F.lit("."), F.lit("")))


on("E14_completeness", "documents", "SELECT doc_id, round((least(length(text) / 500, 1) + least((length(text) - length(replace(text, '.', ''))) / 3, 1)) / 2, 6) AS score FROM documents", lambda: ["doc_id", F.round((F.least(F.length(doc()) / 500, F.lit(1.0)) + F.least(_dots() / 3, F.lit(1.0))) / 2, 6).alias("score")])
on("E16_relevance_level", "events", "SELECT event_id, CASE WHEN value / 100 > 0.8 THEN 'high' WHEN value / 100 > 0.5 THEN 'medium' WHEN value / 100 > 0.3 THEN 'low' ELSE 'none' END AS level, round(least(value / 100 + 0.2, 1), 6) AS confidence FROM events", lambda: ["event_id", F.when(F.col("value") / 100 > 0.8, "high").when(F.col("value") / 100 > 0.5, "medium").when(F.col("value") / 100 > 0.3, "low").otherwise("none").alias("level"), F.round(F.least(F.col("value") / 100 + 0.2, F.lit(1.0)), 6).alias("confidence")])
on("E28_dynamic_threshold", "part", "SELECT p_partkey, CASE WHEN p_size > 50 THEN 15 WHEN p_size < 10 THEN greatest(5, 7) ELSE 10 END AS threshold FROM part", lambda: ["p_partkey", F.when(F.col("p_size") > 50, 15).when(F.col("p_size") < 10, 7).otherwise(10).alias("threshold")])


@query("E18_similar_items", f"SELECT e.vec_id, {COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 ORDER BY score DESC, e.vec_id LIMIT 20")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = load(spark, sf_dir, "embeddings").where("vec_id <> 0")
    return retrieval.vector_search(rest, _probe(spark, sf_dir), 20).select("vec_id", F.round("score", 6).alias("score"))


@query("E33_duplicate_classes", """
    SELECT doc_id, by_hash, by_name_size, CASE WHEN by_hash < doc_id AND by_hash = by_name_size THEN 'exact_match' WHEN by_hash < doc_id AND by_name_size < doc_id THEN 'hash_match_different_name'
      WHEN by_hash < doc_id THEN 'hash_match' WHEN by_name_size < doc_id THEN 'name_size_match' ELSE 'new' END AS label
    FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS by_hash, min(doc_id) OVER (PARTITION BY source, n_chars) AS by_name_size FROM documents)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.duplicates(load(spark, sf_dir, "documents"), "doc_id", F.md5("text"), "source", "n_chars")


# Trends, tags, scalar utilities
@query("F10_daily_trend", "SELECT CAST(d AS DATE) AS day, count(e.event_id) AS n FROM (SELECT unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) + 2, INTERVAL 1 DAY)) AS d FROM events) LEFT JOIN events e ON CAST(e.ts AS DATE) = CAST(d AS DATE) GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id")
    counts = events.groupBy("day").agg(F.count("*").alias("n"))
    span = events.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(F.explode(F.sequence("a", F.date_add("b", 2))).alias("day"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


on("G24_tag_update", "lineitem", "SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_filter([l_returnflag, l_linestatus, 'new'], lambda x: x <> 'O'))), ',') AS tags FROM lineitem", lambda: ["l_orderkey", "l_linenumber", F.array_join(F.array_sort(F.array_except(F.array_union(F.array("l_returnflag", "l_linestatus"), F.array(F.lit("new"))), F.array(F.lit("O")))), ",").alias("tags")])
on("H13_truncate", "documents", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN md5(substring(text, 1, 900) || '... [TRUNCATED ' || CAST(length(text) - 900 AS VARCHAR) || ' chars]') ELSE md5(text) END AS h FROM documents", lambda: ["doc_id", F.md5(F.when(F.length(doc()) > 1000, F.concat(F.substring(doc(), 1, 900), F.lit("... [TRUNCATED "), (F.length(doc()) - 900).cast("string"), F.lit(" chars]"))).otherwise(doc())).alias("h")])
query("H19_range_buckets", "SELECT epoch(time_bucket(INTERVAL '15 minutes', ts))::BIGINT AS bucket, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")(
    lambda s, d: load(s, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "15 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.unix_timestamp("w.start").alias("bucket"), "n", "total")
)
query("H23_minute_rate_limit", "SELECT epoch(time_bucket(INTERVAL '1 minute', ts))::BIGINT AS bucket, user_id, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda s, d: load(s, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 minute").alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("bucket"), "user_id", "n")
)
on("I01_format_datetime", "events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s FROM events", lambda: ["event_id", F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("s")])
on("I03_add_time", "events", "SELECT event_id, strftime(ts + INTERVAL 3 DAY + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS s FROM events", lambda: ["event_id", F.date_format(F.col("ts") + F.expr("INTERVAL '3' DAY") + F.expr("INTERVAL '5' HOUR"), "yyyy-MM-dd HH:mm:ss").alias("s")])
on("I08_list_string", "part", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), ',') AS s FROM part", lambda: ["p_partkey", F.concat_ws(",", F.split("p_name", " ")).alias("s")])
on("I09_base64", "customer", "SELECT c_custkey, base64(encode(c_name)) AS b FROM customer", lambda: ["c_custkey", F.base64("c_name").alias("b")])
on("I10_safe_parse", "events", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events", lambda: ["event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(-1).cast("long")).alias("k")])
on("I14_boolean", "orders", "SELECT o_orderkey, lower(o_orderstatus) IN ('true', '1', 'yes', 'on', 'f') AS b FROM orders", lambda: ["o_orderkey", F.lower("o_orderstatus").isin("true", "1", "yes", "on", "f").alias("b")])
on("I18_format_bytes", "documents", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.1f B', CAST(n_chars AS DOUBLE)) ELSE printf('%.1f KB', n_chars / 1024) END AS s FROM documents", lambda: ["doc_id", T.format_bytes(F.col("n_chars")).alias("s")])
query("I19_format_number")(lambda s, d: load(s, d, "customer").select("c_custkey", T.format_number(F.abs("c_acctbal")).alias("s")))
on("I23_required_fields", "labels", "SELECT doc_id, CASE WHEN quality IS NULL THEN 'quality' ELSE '' END AS missing FROM labels", lambda: ["doc_id", F.when(F.col("quality").isNull(), "quality").otherwise("").alias("missing")])
on("I25_password_rule", "customer", "SELECT c_custkey, length(c_name) >= 8 AND regexp_matches(c_name, '[A-Z]') AND regexp_matches(c_name, '[a-z]') AND regexp_matches(c_name, '[0-9]') AS ok FROM customer", lambda: ["c_custkey", ((F.length("c_name") >= 8) & F.col("c_name").rlike("[A-Z]") & F.col("c_name").rlike("[a-z]") & F.col("c_name").rlike("[0-9]")).alias("ok")])


@query("D10_html_elements")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.operators.html import elements

    return elements(load(spark, sf_dir, "pages"))


@query("D11_html_headings", "SELECT page_id, CAST(len(regexp_extract_all(html, '<h1[ >]')) AS BIGINT) AS n FROM pages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.operators.html import elements

    pages = load(spark, sf_dir, "pages")
    counted = elements(pages).where("level = 1").groupBy("page_id").agg(F.count("*").alias("n"))
    return pages.select("page_id").join(counted, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("D12_html_links", """SELECT page_id, array_to_string(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), ' ') AS links FROM pages""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(found, " ").alias("links"))


WATCH = "SELECT user_id, event_id, CASE WHEN event_id % 17 = 0 THEN 'deleted' ELSE event_type END AS state FROM events WHERE user_id IS NOT NULL"


@query("H05_watch_apply", f"""
    WITH s AS ({WATCH}), p AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS prior FROM s)
    SELECT CASE WHEN state = 'deleted' THEN CASE WHEN prior IS NULL OR prior = 'deleted' THEN 'none' ELSE 'deleted' END
      WHEN prior IS NULL OR prior = 'deleted' THEN 'created' WHEN prior = state THEN 'none' ELSE 'updated' END AS change, count(*) AS count FROM p GROUP BY 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful stream over the events, a part of them deletions, run to its end into a table."""
    from kbspark.sources.scratch import folder
    from kbspark.streaming.changes import apply_watch

    source, run = f"{sf_dir}/events.parquet", folder(spark, "watch")
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    state = F.when(F.col("event_id") % 17 == 0, "deleted").otherwise(F.col("event_type"))
    changes = apply_watch(stream.select("user_id", "event_id", state.alias("state")), state="state")
    writer = changes.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/log")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, event_id long, change string").parquet(f"{run}/out").groupBy("change").count()


@query("E20_history_fuzzy")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a token within two edits of a term; DuckDB counts edits by bytes, so there is no SQL."""
    near = F.exists(T.tokens(doc()), lambda w: F.levenshtein(w, F.lit("therre"), 2) >= 0)
    return load(spark, sf_dir, "conversations").where(near).select("conv_id", "turn")


# Sequential algorithms; rows only, tested against literals
@query("D30_sentence_chunks")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.operators.diffs import sentence_chunks

    chunks = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentence_chunks(doc())).alias("chunk_index", "content"))
    return chunks.select("doc_id", "chunk_index", F.md5("content").alias("h"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return load(spark, sf_dir, "conversations").withColumn("prior", prior).where("prior IS NOT NULL")


@query("D43_similarity")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.operators.diffs import similarity

    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(similarity("prior", "text"), 6).alias("ratio"))


@query("D44_diff_counts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.operators.diffs import diff_counts

    return _turns(spark, sf_dir).select("conv_id", "turn", diff_counts("prior", "text").alias("d")).select("conv_id", "turn", "d.*")


# Ordered text aggregates
@query("E25_context_assembly", "SELECT conv_id, string_agg('[' || turn || '] ' || text, ' ' ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 5 GROUP BY conv_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    few = load(spark, sf_dir, "conversations").withColumn("rn", rn).where("rn <= 5")
    return few.groupBy("conv_id").agg(F.expr("listagg('[' || turn || '] ' || text, ' ') WITHIN GROUP (ORDER BY turn)").alias("context"))


@query("C27_table_group_read", "SELECT l_orderkey, string_agg(l_partkey || ':' || l_linenumber, ',' ORDER BY l_linenumber, l_partkey) AS cells FROM lineitem GROUP BY l_orderkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    grouped = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(cells.alias("parts"))
    return grouped.select("l_orderkey", F.array_join(F.transform("parts", lambda c: F.concat_ws(":", c["l_partkey"].cast("string"), c["l_linenumber"].cast("string"))), ",").alias("cells"))


@query("E36_knowledge_lookup", SQL["E05_hybrid_fusion"] + " ORDER BY score DESC, doc_id LIMIT 5")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["E05_hybrid_fusion"](spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(5)


INDICATORS = ["是", "不是", "有", "没有", "可以", "不能", "应该", "不应该", "具体", "详细", "例如", "比如", "包括", "包含"]
on("E15_accuracy", "conversations", f"SELECT conv_id, turn, least(len(list_filter({INDICATORS}, lambda w: contains(text, w))) / 10, 1) AS score FROM conversations", lambda: ["conv_id", "turn", F.least(F.size(F.filter(F.array(*map(F.lit, INDICATORS)), lambda w: F.contains(doc(), w))) / 10, F.lit(1.0)).alias("score")])
on("I02_parse_datetime", "events", "SELECT event_id, try_strptime(substring(CAST(ts AS VARCHAR), 1, 19), '%Y-%m-%d %H:%M:%S') AS t FROM events", lambda: ["event_id", F.try_to_timestamp(F.substring(F.col("ts").cast("string"), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).alias("t")])
on("I06_epoch", "events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events", lambda: ["event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s")])
on("I16_flatten", "part", "SELECT p_partkey, array_to_string(flatten([string_split(p_name, ' '), [p_brand]]), '|') AS s FROM part", lambda: ["p_partkey", F.array_join(F.flatten(F.array(F.split("p_name", " "), F.array("p_brand"))), "|").alias("s")])
on("I17_remove_duplicates", "conversations", "SELECT conv_id, turn, CAST(len(list_distinct(string_split(text, ' '))) AS BIGINT) AS n FROM conversations", lambda: ["conv_id", "turn", F.size(F.array_distinct(F.split("text", " "))).cast("long").alias("n")])
on("D04_keywords_zh", "documents", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[一-鿿]{2,4}')) AS BIGINT) AS n FROM documents", lambda: ["doc_id", F.size(F.regexp_extract_all(doc(), F.lit("([一-鿿]{2,4})"), F.lit(1))).cast("long").alias("n")])
on("D20_toc_text", "documents", r"SELECT doc_id, regexp_matches(lower(replace(text, ' ', '')), '^(目录|tableofcontents)') OR regexp_matches(text, '[.·…]{2,}\s*[0-9]+') AS is_toc FROM documents", lambda: ["doc_id", (F.lower(F.replace(doc(), F.lit(" "), F.lit(""))).rlike("^(目录|tableofcontents)") | doc().rlike(r"[.·…]{2,}\s*[0-9]+")).alias("is_toc")])
