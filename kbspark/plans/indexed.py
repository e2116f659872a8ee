"""Queries through the search index and the vector index. Each index is built once a session and table folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import cells, indexed
from kbspark.plans.files import CHUNKS, chunks_of
from kbspark.plans.native import BM25, SQL, TERMS, TOK, _probe, query
from kbspark.sources import segments
from kbspark.sources.scratch import folder
from kbspark.sources.tables import load

_held: dict[tuple[str, ...], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> str:
    """The path of an index that this session has built, or has built now."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _held:
        path = folder(spark, name)
        make(path)
        _held[key] = path
    return _held[key]


def documents_index(spark: SparkSession, sf_dir: str) -> segments.Index:
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text").alias("content"))
    return segments.open_index(spark, _once(spark, sf_dir, "documents-index", lambda path: segments.create(rows, path, "doc_id")))


def chunks_index(spark: SparkSession, sf_dir: str) -> segments.Index:
    rows = chunks_of(spark, sf_dir).withColumn("chunk_id", F.concat_ws("/", "doc_id", "chunk_index"))
    return segments.open_index(spark, _once(spark, sf_dir, "chunks-index", lambda path: segments.create(rows, path)))


def vectors_index(spark: SparkSession, sf_dir: str) -> cells.Cells:
    rows = load(spark, sf_dir, "embeddings")
    return cells.open_cells(spark, _once(spark, sf_dir, "vectors-index", lambda path: cells.create(rows, path)))


# Text
query("B10_index_match", SQL["B10_lexical_match"])(lambda s, d: indexed.match(documents_index(s, d), ["license", "reserved"]))
query("B11_index_phrase", SQL["B11_phrase_match"])(lambda s, d: indexed.phrase(documents_index(s, d), ["all", "rights", "reserved"]))
query("E08_index_phrase", SQL["E08_exact_phrase"])(lambda s, d: indexed.phrase(documents_index(s, d), ["all", "rights", "reserved"]).orderBy("doc_id").limit(1000))
query("E10_index_boolean", SQL["E10_boolean_query"])(lambda s, d: indexed.boolean(documents_index(s, d), "(license OR reserved) AND NOT mit"))
query("E10_index_compatible", f"SELECT doc_id FROM (SELECT doc_id, {TOK} AS k FROM documents) WHERE list_contains(k, 'the') AND list_contains(k, 'of') AND NOT list_contains(k, 'license')")(
    lambda s, d: indexed.boolean(documents_index(s, d), "the AND of OR mit NOT license", compatible=True)
)
query("E10_index_without", f"SELECT doc_id FROM (SELECT doc_id, {TOK} AS k FROM documents) WHERE NOT list_has_any(k, ['the', 'license'])")(
    lambda s, d: indexed.boolean(documents_index(s, d), "NOT the AND NOT license")
)


@query("E02_index_bm25", BM25 + " SELECT doc_id, round(s, 6) AS score FROM b ORDER BY s DESC, doc_id LIMIT 30")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed.bm25(documents_index(spark, sf_dir), TERMS, 30).select("doc_id", F.round("score", 6).alias("score"))


@query("E02_index_bm25_all", BM25 + " SELECT doc_id, round(s, 6) AS score FROM b")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed.bm25(documents_index(spark, sf_dir), TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query("E09_index_parts", r"""
    SELECT doc_id FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS k FROM documents)
    WHERE lang = 'en' AND list_contains(k, 'the') AND (list_contains(k, 'rights') OR list_contains(k, 'license')) AND contains(' ' || array_to_string(k, ' ') || ' ', ' rights reserved ')
      AND len(list_filter(k, lambda w: regexp_full_match(w, 'res.*d'))) > 0 AND len(list_filter(k, lambda w: regexp_full_match(w, 'a[lm]+'))) > 0""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match, Boolean, phrase, wildcard and regular expression at once, with a filter; no text is read."""
    index = documents_index(spark, sf_dir)
    english = segments.rows_of(index, ["doc_id", "lang"]).where("lang = 'en'").select("doc_id")
    return indexed.every(
        index, english, indexed.match(index, ["the"]), indexed.boolean(index, "rights OR license"), indexed.phrase(index, ["rights", "reserved"]), indexed.wildcard(index, "res*d"), indexed.by_pattern(index, "a[lm]+")
    )


@query("E19_index_in_document", f"""
    WITH c AS (SELECT chunk_index, content AS text FROM ({CHUNKS}) WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE length(text) > 5000)), """
    + BM25.split("WITH ", 1)[1].replace("SELECT doc_id, regexp", "SELECT chunk_index AS doc_id, regexp").replace("FROM documents", "FROM c")
    + " SELECT chunk_index, round(score, 6) AS score FROM (SELECT doc_id AS chunk_index, s AS score FROM b ORDER BY s DESC, doc_id LIMIT 100) WHERE chunk_index BETWEEN 1 AND 8")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = chunks_index(spark, sf_dir)
    asked = load(spark, sf_dir, "documents").where(F.length("text") > 5000).agg(F.min("doc_id")).first()[0]
    found = indexed.in_document(index, "doc_id", -1 if asked is None else asked, TERMS)
    chunk = F.element_at(F.split("chunk_id", "/"), -1).cast("long").alias("chunk_index")
    return found.select(chunk, F.round("score", 6).alias("score")).where("chunk_index between 1 and 8")


@query("E20_index_fuzzy", f"""
    SELECT DISTINCT doc_id, asked FROM (SELECT doc_id, unnest(list_distinct({TOK})) AS w FROM documents), (SELECT unnest(['licence', 'reserve', 'there', 'mit']) AS asked)
    WHERE regexp_full_match(w, '[a-z]+') AND levenshtein(w, asked) <= CASE WHEN length(asked) <= 2 THEN 0 WHEN length(asked) <= 5 THEN 1 ELSE 2 END""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed.fuzzy(documents_index(spark, sf_dir), ["licence", "reserve", "there", "mit"], among="[a-z]+")


@query("A17_index_segments", f"""
    WITH t AS (SELECT doc_id, {TOK.replace('text', "CASE WHEN doc_id % 10 = 0 THEN 'changed text' ELSE text END")} AS k FROM documents WHERE doc_id % 10 <> 1), e AS (SELECT doc_id, unnest(k) AS term FROM t)
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM e GROUP BY term""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them then changed and another tenth deleted: three entries, nothing rewritten."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("content"))
    index = segments.create(docs, folder(spark, "segments"), "doc_id")
    index = segments.upsert(index, docs.where("doc_id % 10 = 0").withColumn("content", F.lit("changed text")))
    index = segments.delete(index, docs.where("doc_id % 10 = 1").select("doc_id"))
    return indexed.hits(index, segments.postings_of(index)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("tf"))


@query("A19_index_delete", "SELECT lang, count(*) AS n FROM documents WHERE source <> 'src1' AND doc_id % 7 <> 3 GROUP BY lang")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions by key and by query, and a compaction of all that is left."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text").alias("content"))
    index = segments.create(docs, folder(spark, "segments"), "doc_id")
    index = segments.delete(index, segments.rows_of(index, ["doc_id", "source"]).where("source = 'src1'").select("doc_id"))
    index = segments.delete(index, docs.where("doc_id % 7 = 3").select("doc_id"))
    return segments.rows_of(segments.compact(index, all_of_it=True), ["doc_id", "lang"]).groupBy("lang").agg(F.count("*").alias("n"))


# Vectors
KNN = """
    WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, q)
    SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@query("C17_cells_knn", KNN)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = load(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = cells.nearest(vectors_index(spark, sf_dir), asked, 5)
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("E03_cells_search", SQL["E03_vector_search"])
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(0, _probe(spark, sf_dir))], "query_id long, q array<double>")
    found = cells.nearest(vectors_index(spark, sf_dir), asked, 30)
    return found.where("score >= 0.2").select("vec_id", F.round("score", 6).alias("score"))


@query("A18_image_cells", """
    WITH n AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings f WHERE f.vec_id = 1) ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings),
    s AS (SELECT n.vec_id, list_cosine_similarity(v, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 2)) AS score FROM n)
    SELECT 'image_' || vec_id AS image_key, round(score, 6) AS score FROM s ORDER BY s.score DESC, 'image_' || vec_id LIMIT 20""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image vectors; a fifth of them is replaced by others, then the index is searched exactly."""
    images = load(spark, sf_dir, "embeddings").select(F.concat(F.lit("image_"), F.col("vec_id").cast("string")).alias("image_key"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    other = F.broadcast(images.where("vec_id = 1").select(F.col("embedding").alias("other")).limit(1))
    index = cells.create(images, folder(spark, "images"), key="image_key")
    index = cells.add(index, images.where("vec_id % 5 = 0").crossJoin(other).select("image_key", F.col("other").alias("embedding")))  # one row
    asked = images.where("vec_id = 2").select(F.lit(0).alias("query_id"), F.col("embedding").alias("q"))
    return cells.nearest(index, asked, 20).select("image_key", F.round("score", 6).alias("score"))
