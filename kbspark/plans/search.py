"""Queries on search modes, question histories and context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import cluster, search
from kbspark.plans.files import CHUNKS, chunks_of
from kbspark.plans.native import BM25, COS, TERMS, _probe, doc, on, query
from kbspark.sources.tables import load

LIMIT = 10
NEAR = "SELECT e.vec_id AS doc_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS v FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
HYBRID = f"""{BM25}, l AS (SELECT doc_id, s FROM b ORDER BY s DESC, doc_id LIMIT 30), n AS (SELECT * FROM ({NEAR}) ORDER BY v DESC, doc_id LIMIT 30),
    f AS (SELECT coalesce(l.doc_id, n.doc_id) AS doc_id, 0.5 * coalesce(v, 0) + 0.5 * coalesce(s, 0) AS score FROM l FULL OUTER JOIN n ON l.doc_id = n.doc_id)
    SELECT doc_id, round(score, 5) AS score FROM f WHERE score >= 0.3 OR NOT (SELECT coalesce(bool_or(score >= 0.3), false) FROM f) ORDER BY f.score DESC, doc_id LIMIT 10"""


@query("C17_knn_join", """
    WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, q)
    SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.knn_join(asked, rows, 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("E02_keyword_search", BM25 + """, r AS (SELECT doc_id, s FROM b ORDER BY s DESC, doc_id LIMIT 30),
    m AS (SELECT r.doc_id, s, len(list_intersect(['the', 'thing', 'license'], """ + r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')" + """)) / 3 AS k FROM r JOIN documents USING (doc_id))
    SELECT doc_id, round(s, 6) AS score, round(k, 6) AS rerank FROM m WHERE k >= 0.4 ORDER BY k DESC, s DESC, doc_id LIMIT 10""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.keyword_search(load(spark, sf_dir, "documents"), TERMS, LIMIT, 0.4, search.lexical_score(TERMS, F.col("content")))
    return found.select("doc_id", F.round("score", 6).alias("score"), F.round("rerank", 6).alias("rerank"))


@query("E03_vector_mode", f"SELECT doc_id, round(v, 6) AS score FROM (SELECT doc_id, greatest(0, least(1, v)) AS v FROM ({NEAR}) ORDER BY v DESC, doc_id LIMIT 30) WHERE v >= 0.2 ORDER BY v DESC, doc_id LIMIT 10")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings"), "the thing license", _probe(spark, sf_dir), "vector", LIMIT, 0.2)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query("E05_hybrid_search", HYBRID)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hybrid_search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings"), TERMS, _probe(spark, sf_dir), LIMIT, 0.3)
    return found.select("doc_id", F.round("score", 5).alias("score"))


@query("E31_search_dispatch", r"""
    SELECT 'exact' AS mode, count(*) AS n FROM (SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ', ' all rights reserved ') LIMIT 1000)
    UNION ALL SELECT mode, 10 AS n FROM (VALUES ('vector'), ('keyword'), ('any other')) t(mode)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows, probe = load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings"), _probe(spark, sf_dir)
    asked = {"exact": ("all rights reserved", 1000), "vector": ("the", 10), "keyword": ("the", 10), "any other": ("the", 10)}
    found = [search.search(docs, rows, text, probe, mode, limit).agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "n") for mode, (text, limit) in asked.items()]
    return reduce(DataFrame.unionByName, found)


@query("E19_in_document_search", f"""
    WITH c AS (SELECT chunk_index, content AS text FROM ({CHUNKS}) WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE length(text) > 5000)), """
    + BM25.split("WITH ", 1)[1].replace("SELECT doc_id, regexp", "SELECT chunk_index AS doc_id, regexp").replace("FROM documents", "FROM c")
    + " SELECT chunk_index, round(score, 6) AS score FROM (SELECT doc_id AS chunk_index, s AS score FROM b ORDER BY s DESC, doc_id LIMIT 100) WHERE chunk_index BETWEEN 1 AND 8")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = load(spark, sf_dir, "documents").where(F.length("text") > 5000).agg(F.min("doc_id")).first()[0]
    found = search.in_document(chunks_of(spark, sf_dir), -1 if asked is None else asked, TERMS, (1, 8))
    return found.select("chunk_index", F.round("score", 6).alias("score"))


# Question histories: each user turn with the assistant's answer and the vector of its number
HISTORY = """SELECT u.conv_id * 1000 + u.turn AS qa_id, u.text AS question, a.text AS answer, e.embedding AS v, u.turn AS quality FROM conversations u
    JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' LEFT JOIN embeddings e ON e.vec_id = (u.conv_id * 7 + u.turn) % 500 WHERE u.role = 'user'"""
ASKED = ["the", "of"]


def _field_bm25(field: str) -> str:
    counted = f"SELECT qa_id, regexp_extract_all(lower({field}), '[\\p{{L}}\\p{{N}}_]+') AS k FROM h"
    return f"""SELECT qa_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM (
      SELECT *, count(*) FILTER (WHERE tf > 0) OVER (PARTITION BY term) AS df FROM (SELECT qa_id, term, len(list_filter(k, lambda x: x = term)) AS tf, len(k) AS dl FROM ({counted}), (SELECT unnest(['the', 'of']) AS term))) t,
      (SELECT count(*) AS n, avg(len(k)) AS avgdl FROM ({counted})) z WHERE tf > 0 GROUP BY qa_id"""


KEYWORD = f"SELECT qa_id, max(s) AS score FROM ({_field_bm25('question')} UNION ALL {_field_bm25('answer')}) GROUP BY qa_id"
SEMANTIC = "SELECT qa_id, score FROM (SELECT qa_id, coalesce(list_cosine_similarity(CAST(v AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 0) AS score FROM h) ORDER BY score DESC, qa_id LIMIT 10"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = asked.join(answers, ["conv_id", "turn"]).withColumn("vec_id", (F.col("conv_id") * 7 + F.col("turn")) % 500)
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return both.join(vectors, "vec_id", "left").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qa_id"), "question", "answer", "v", F.col("turn").alias("quality"))


@query("E20_history_keyword", f"WITH h AS ({HISTORY}) SELECT qa_id, round(score, 6) AS score FROM ({KEYWORD})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.history_keyword(history(spark, sf_dir), ASKED).select("qa_id", F.round("score", 6).alias("score"))


on("E20_history_near_terms", "conversations", r"SELECT conv_id, turn, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]+') AND levenshtein(w, 'there') <= 1)) > 0 AS near FROM conversations",
    lambda: ["conv_id", "turn", search.fuzzy(F.filter(T.tokens(doc()), lambda w: w.rlike("^[a-z]+$")), "there").alias("near")])


@query("E21_history_semantic", f"WITH h AS ({HISTORY}) SELECT qa_id, round(score, 6) AS score FROM ({SEMANTIC})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.history_semantic(history(spark, sf_dir), _probe(spark, sf_dir)).select("qa_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


@query("E22_history_hybrid", f"WITH h AS ({HISTORY}), k AS ({KEYWORD}), s AS ({SEMANTIC}) SELECT coalesce(k.qa_id, s.qa_id) AS qa_id, round(coalesce(k.score, 0) + 1.5 * coalesce(s.score, 0), 5) AS score FROM k FULL OUTER JOIN s ON s.qa_id = k.qa_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.history_hybrid(history(spark, sf_dir), ASKED, _probe(spark, sf_dir)).select("qa_id", F.round("score", 5).alias("score"))


@query("E23_history_sorted", f"WITH h AS ({HISTORY}) SELECT qa_id, quality FROM h ORDER BY quality DESC, qa_id LIMIT 25")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.history_sorted(history(spark, sf_dir), "quality").limit(25).select("qa_id", "quality")


# Context
@query("E24_section_context", """
    WITH s AS (SELECT conv_id, turn, text, floor(turn / 4) AS section FROM conversations)
    SELECT conv_id, turn, md5(substring(concat_ws(chr(10), lag(text) OVER w, text, lead(text) OVER w), 1, 2500)) AS h FROM s WINDOW w AS (PARTITION BY conv_id, section ORDER BY turn)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 4).alias("section"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return search.around(rows).select(F.col("doc_id").alias("conv_id"), F.col("chunk_index").alias("turn"), F.md5("context").alias("h"))


@query("E24_sibling_context", """
    WITH s AS (SELECT conv_id, turn, text, floor(turn / 4) AS parent, sum(length(text)) OVER (PARTITION BY conv_id, floor(turn / 4) ORDER BY turn) AS total FROM conversations)
    SELECT conv_id, CAST(parent AS BIGINT) AS parent, md5(string_agg(text, chr(10) ORDER BY turn)) AS h FROM s WHERE total <= 1500 GROUP BY conv_id, parent""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 4).alias("parent"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return search.siblings(rows).select(F.col("doc_id").alias("conv_id"), "parent", F.md5("context").alias("h"))


@query("E29_ocr_enrichment", """
    WITH hits AS (SELECT o_orderkey AS doc_id, 2 AS first, 4 AS last, o_orderpriority AS content FROM orders WHERE o_custkey % 10 = 0),
    i AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS element, CASE WHEN l_quantity > 25 THEN l_returnflag ELSE ' ' END AS ocr FROM lineitem)
    SELECT h.doc_id, concat_ws(chr(10), h.content, (SELECT string_agg(i.ocr, chr(10) ORDER BY i.element, i.ocr) FROM i WHERE i.doc_id = h.doc_id AND i.element BETWEEN first AND last AND trim(i.ocr) <> '')) AS content FROM hits h""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = load(spark, sf_dir, "orders").where("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit(2).alias("first"), F.lit(4).alias("last"), F.col("o_orderpriority").alias("content"))
    images = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("element"), F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).otherwise(" ").alias("ocr"))
    return search.with_images(hits, images).select("doc_id", "content")


# Scores
@query("E30_intent_fusion", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = l_linestatus OR l_tax >= l_discount THEN l_returnflag ELSE l_linestatus END AS intent, CASE WHEN l_returnflag = l_linestatus THEN greatest(l_tax, l_discount) WHEN l_tax >= l_discount THEN l_tax ELSE l_discount END AS confidence FROM lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (F.struct(F.col(i).alias("intent"), F.col(c).alias("confidence")) for i, c in (("l_returnflag", "l_tax"), ("l_linestatus", "l_discount")))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", search.fused_intent(one, two).alias("f")).select("l_orderkey", "l_linenumber", "f.*")


on("E35_diagnosis_confidence", "events", "SELECT event_id, round(least(1::DOUBLE, greatest(0.1::DOUBLE, 0.4::DOUBLE + CASE WHEN value > 20 THEN 0.2 ELSE 0 END + CASE WHEN value > 40 THEN 0.2 ELSE 0 END + CASE WHEN value > 60 THEN 0.1 ELSE 0 END + CASE WHEN value > 80 THEN 0.1 ELSE 0 END + CASE WHEN event_type = 'error' THEN 0.05 ELSE 0 END)), 6) AS confidence FROM events",
    lambda: ["event_id", F.round(search.diagnosis_confidence(*[F.col("value") > v for v in (20, 40, 60, 80)], F.col("event_type") == "error"), 6).alias("confidence")])
on("E37_final_confidence", "lineitem", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.8 THEN l_discount * 10 WHEN l_returnflag = 'A' AND l_tax * 10 >= 0.8 THEN l_tax * 10 WHEN l_quantity / 50 >= 0.8 THEN l_quantity / 50
      WHEN (l_linenumber - 4) / 10 > 0 THEN (l_linenumber - 4) / 10 WHEN l_discount > 0 THEN l_discount * 10 WHEN l_quantity > 0 THEN l_quantity / 50 ELSE 0.4 END AS confidence FROM lineitem""",
    lambda: ["l_orderkey", "l_linenumber", cluster.final_confidence(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_returnflag") == "A", F.col("l_quantity") / 50, (F.col("l_linenumber") - 4) / 10, F.lit(0.4)).alias("confidence")])


@query("E16_relevance_aggregate", """
    SELECT user_id, round(score, 6) AS score, CASE WHEN score > 0.8 THEN 'high' WHEN score > 0.5 THEN 'medium' WHEN score > 0.3 THEN 'low' ELSE 'none' END AS level FROM (
      SELECT user_id, 0.4 * avg(value / 100) + 0.3 * avg(least(value / 50, 1)) + 0.2 * avg(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) + 0.1 * avg((event_id % 10) / 10) AS score FROM events GROUP BY user_id)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", (F.col("value") / 100).alias("similarity"), F.least(F.col("value") / 50, F.lit(1.0)).alias("match"), F.when(F.col("event_type") == "view", 1.0).otherwise(0.0).alias("completeness"), (F.col("event_id") % 10 / 10).alias("accuracy"))
    return search.relevance(rows, "user_id").select("user_id", F.round("score", 6).alias("score"), "level")


@query("E32_facets", "SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by value of two fields in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("lang", "source")])).alias("p")
    return load(spark, sf_dir, "documents").select(pairs).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))
