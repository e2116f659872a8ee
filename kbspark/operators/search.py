"""Search over documents, vectors and question histories: modes, recall, rerank, thresholds, context."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.functions import text as T
from kbspark.operators import retrieval
from kbspark.operators.retrieval import let

#: Fixed parameters: how many times the limit is recalled, and weights of history search.
RECALL, LEXICAL, SEMANTIC, NEAREST = 3, 1.0, 1.5, 10
#: Bounds of a tile of ``knn_join``: its queries, its rows, the queries scored at once, the pairs scored again at once.
BLOCK_QUERIES, SHARD_ROWS, WALK_QUERIES, PAIRS = 16_384, 8_192, 256, 1 << 16
SLACK = 1e-9


def knn_join(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, vec_id, rank, score)``: for each of ``queries(query_id, q)`` the ``k`` rows nearest by
    cosine, ties by id.

    Every query is held against every row: rows are dealt to shards and queries to blocks by a hash, and a
    task has one of each, both bounded, whose products are one matrix. What these rounded scores cannot
    rule out is scored again as ``retrieval.cosine`` does, so scores, ties and ranks are its own. A tile
    sends k rows a query; ``operators.cells`` visits only the cells that matter. Vectors that are null or
    hold a null come last, with a null score; vectors of several lengths are an error.
    """
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("v"))
    base = rows.select(F.col(id_col).alias("row_id"), F.col(vec_col).cast("array<double>").alias("v"))
    usable = F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False))
    stats = [f.agg(F.count_if(usable).alias("n"), F.count_if(~usable).alias("bad"), F.array_size(F.min_by("v", F.array_size("v"))).alias("a"), F.array_size(F.max_by("v", F.array_size("v"))).alias("b")).first() for f in (asked, base)]
    lengths = {r[c] for r in stats for c in "ab"} - {None}
    if len(lengths) > 1:
        raise ValueError(f"vectors of lengths {sorted(lengths)}")
    blocks, shards = (max(1, -(-r["n"] // most)) for r, most in zip(stats, (BLOCK_QUERIES, SHARD_ROWS), strict=True))
    deal = lambda by, n: F.pmod(F.xxhash64(by, "v"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.where(usable).select(deal("row_id", shards).alias("shard"), spread(blocks).alias("block"), "row_id", "v")
    right = asked.where(usable).select(spread(shards).alias("shard"), deal("query_id", blocks).alias("block"), "query_id", "v")
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, row_id {base.schema['row_id'].dataType.simpleString()}, score double"
    key = ["shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda x, y: _tile(x, y, k), kinds)
    none = F.lit(None).cast("double").alias("score")
    if stats[1]["n"] < k and stats[1]["bad"]:  # rows without a score are needed too, at most k
        few = base.where(~usable).orderBy("row_id").limit(k).select("row_id")
        found = found.unionByName(asked.where(usable).crossJoin(F.broadcast(few)).select("query_id", "row_id", none))
    if stats[0]["bad"]:
        few = base.orderBy("row_id").limit(k).select("row_id")
        found = found.unionByName(asked.where(~usable).crossJoin(F.broadcast(few)).select("query_id", "row_id", none))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.col("row_id").alias(id_col), "score", "rank")


def _tile(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """``(query_id, row_id, score)``: the best ``k`` rows of ``left`` for each query of ``right``."""
    out = []
    if left.num_rows and right.num_rows:
        matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        points, asked = matrix(left), matrix(right)
        place = pc.rank(left["row_id"].combine_chunks(), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        with np.errstate(all="ignore"):
            sizes = [np.sqrt(_summed(m, m)) for m in (points, asked)]
            units = [np.where(s[:, None] > 0, m / s[:, None], 0.0) for m, s in zip((points, asked), sizes, strict=True)]
            odd = [~np.isfinite(s) for s in sizes]
            for at in range(0, len(asked), WALK_QUERIES):
                mine = slice(at, at + WALK_QUERIES)
                rough = units[1][mine] @ units[0].T
                rough[:, odd[0]] = np.inf
                rough[odd[1][mine]] = np.inf
                floor = np.full(len(rough), -np.inf) if len(points) <= k else np.partition(rough, len(points) - k, axis=1)[:, len(points) - k]
                q, c = np.nonzero(rough >= (floor - SLACK)[:, None])
                q += at
                norms = sizes[0][c] * sizes[1][q]
                parts = [slice(i, i + PAIRS) for i in range(0, len(q), PAIRS)]
                score = np.concatenate([np.where(norms[p] == 0, 0.0, _summed(points[c[p]], asked[q[p]]) / norms[p]) for p in parts])
                order = np.lexsort((place[c], -score, ~np.isnan(score), q))
                q, c, score = q[order], c[order], score[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                out.append((q[keep], c[keep], score[keep]))
    q, c, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return pa.table([right["query_id"].take(pa.array(q)), left["row_id"].take(pa.array(c)), pa.array(score)], ["query_id", "row_id", "score"])


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def rerank(hits: DataFrame, model: Column | None = None, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """Hits in the order of a model's score, which goes to ``rerank``; hits without content go only
    with a model. Without one the given score stays."""
    scored = hits.withColumn("rerank", F.col("score") if model is None else model)
    return scored if model is None else scored.where(F.coalesce(F.col(content), F.lit("")) != "")


def lexical_score(query: list[str], content: Column) -> Column:
    """The default scorer: the share of the query's terms that the content has."""
    return let(T.tokens(content), lambda k: F.size(F.array_intersect(F.array(*map(F.lit, query)), k)) / F.lit(max(1, len(set(query)))))


def keyword_search(docs: DataFrame, terms: list[str], limit: int, least: float = 0.0, model: Column | None = None, where: Column | None = None) -> DataFrame:
    """``(doc_id, score, rerank)``: filters, BM25, ``RECALL`` times the limit, rerank, threshold, cut."""
    few = docs if where is None else docs.where(where)
    recalled = retrieval.bm25(few, terms).orderBy(F.desc("score"), "doc_id").limit(RECALL * limit)
    found = recalled.join(docs.select("doc_id", F.col("text").alias("content")), "doc_id") if model is not None else recalled
    ordered = rerank(found, model).where(F.col("rerank") >= least)
    return ordered.orderBy(F.desc("rerank"), F.desc("score"), "doc_id").limit(limit).select("doc_id", "score", "rerank")


def vector_search(rows: DataFrame, query: list[float], limit: int, least: float = 0.0) -> DataFrame:
    """``(doc_id, score)``: the rows nearest by cosine, ``RECALL`` times the limit, scores from 0 to 1,
    threshold, cut."""
    found = retrieval.vector_search(rows, query, RECALL * limit).select(F.col("vec_id").alias("doc_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))
    return found.where(F.col("score") >= least).orderBy(F.desc("score"), "doc_id").limit(limit)


def hybrid_search(docs: DataFrame, rows: DataFrame, terms: list[str], query: list[float], limit: int, least: float = 0.0, alpha: float = 0.5) -> DataFrame:
    """``(doc_id, score)``: both lists are recalled at ``RECALL`` times the limit and only these short
    lists are joined; if no hit reaches the threshold all stay."""
    lexical = retrieval.bm25(docs, terms).orderBy(F.desc("score"), "doc_id").limit(RECALL * limit)
    near = retrieval.vector_search(rows, query, RECALL * limit).withColumnRenamed("vec_id", "doc_id")
    fused = retrieval.fuse(near, lexical, alpha)
    return retrieval.passing_or_all(fused, least).orderBy(F.desc("score"), "doc_id").limit(limit)


def exact_search(docs: DataFrame, phrase: list[str], limit: int = 1000) -> DataFrame:
    hits = docs.where(let(T.tokens(F.col("text")), lambda k: T.has_phrase(k, phrase)))
    return hits.orderBy("doc_id").limit(limit).select("doc_id", F.lit(1.0).alias("score"))


def search(docs: DataFrame, rows: DataFrame, text: str, query: list[float], mode: str = "hybrid", limit: int = 10, least: float = 0.0) -> DataFrame:
    """``(doc_id, score)`` by mode: vector, keyword, exact, else hybrid."""
    terms = text.lower().split()
    if mode == "vector":
        return vector_search(rows, query, limit, least)
    if mode == "keyword":
        return keyword_search(docs, terms, limit, least).select("doc_id", "score")
    if mode == "exact":
        return exact_search(docs, terms, limit)
    return hybrid_search(docs, rows, terms, query, limit, least)


def in_document(chunks: DataFrame, doc_id: int, terms: list[str], pages: tuple[int, int] | None = None) -> DataFrame:
    """``(chunk_index, score)``: the 100 best chunks of one document with any of the terms, by BM25 over
    that document; the page filter follows the cut."""
    mine = chunks.where(F.col("doc_id") == doc_id)
    best = retrieval.bm25(mine, terms, "chunk_index", "content").withColumnRenamed("doc_id", "chunk_index").orderBy(F.desc("score"), "chunk_index").limit(100)
    return best if pages is None else best.where(F.col("chunk_index").between(*pages))


# Question histories: rows (qa_id, question, answer, v, created_at, quality)
def history_keyword(history: DataFrame, terms: list[str]) -> DataFrame:
    """``(qa_id, score)``: the better of the BM25 scores of question and answer."""
    scores = [retrieval.bm25(history, terms, "qa_id", c).select(F.col("doc_id").alias("qa_id"), "score") for c in ("question", "answer")]
    return scores[0].unionByName(scores[1]).groupBy("qa_id").agg(F.max("score").alias("score"))


def fuzzy(words: Column, term: str) -> Column:
    """Whether some token is near a term: equal up to two letters, one edit up to five, else two."""
    edits = 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2
    return F.exists(words, lambda w: F.levenshtein(w, F.lit(term), edits) >= 0)


def history_semantic(history: DataFrame, query: list[float], k: int = NEAREST) -> DataFrame:
    return retrieval.vector_search(history, query, k, None, "qa_id", "v")


def history_hybrid(history: DataFrame, terms: list[str], query: list[float]) -> DataFrame:
    """Weighted sum of both; at least one must match."""
    lexical = history_keyword(history, terms).withColumnRenamed("score", "l")
    both = lexical.join(history_semantic(history, query).withColumnRenamed("score", "s"), "qa_id", "full_outer")
    return both.select("qa_id", (LEXICAL * F.coalesce("l", F.lit(0.0)) + SEMANTIC * F.coalesce("s", F.lit(0.0))).alias("score"))


def history_sorted(hits: DataFrame, method: str) -> DataFrame:
    """By time, quality or relevance, newest first for any other name; ties by id."""
    column = {"quality": "quality", "relevance": "score"}.get(method, "created_at")
    return hits.orderBy(F.desc(column), "qa_id")


# Context around hits
def with_images(hits: DataFrame, images: DataFrame) -> DataFrame:
    """``hits(doc_id, first, last, content)`` with the recognised texts of the images that stand in
    their range appended, in order, once each."""
    inside = hits.select("doc_id", "first", "last").join(images, "doc_id").where(F.col("element").between(F.col("first"), F.col("last")) & (F.trim("ocr") != ""))
    texts = inside.groupBy("doc_id", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("element", "ocr"))), lambda o: o["ocr"]), "\n").alias("ocr_"))
    joined = hits.join(texts, ["doc_id", "first"], "left")
    return joined.select(*[F.concat_ws("\n", "content", "ocr_").alias(c) if c == "content" else c for c in hits.columns])


def around(chunks: DataFrame, most: int = 2500) -> DataFrame:
    """``chunks(doc_id, section, chunk_index, content)`` with ``context``: the chunk before, itself and
    the chunk behind in its section, by line, cut to ``most`` characters."""
    w = W.partitionBy("doc_id", "section").orderBy("chunk_index")
    parts = F.concat_ws("\n", F.lag("content").over(w), F.col("content"), F.lead("content").over(w))
    return chunks.withColumn("context", F.substring(parts, 1, most))


def siblings(chunks: DataFrame, budget: int = 1500) -> DataFrame:
    """``(doc_id, parent, context)``: the chunks of a parent in order, up to the first that does not fit."""
    w = W.partitionBy("doc_id", "parent").orderBy("chunk_index")
    fits = chunks.withColumn("total_", F.sum(F.length("content")).over(w)).where(F.col("total_") <= budget)
    part = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return fits.groupBy("doc_id", "parent").agg(F.array_join(F.transform(part, lambda c: c["content"]), "\n").alias("context"))


# Scores of answers and diagnoses
def fused_intent(a: Column, b: Column) -> Column:
    """``struct<intent, confidence>`` of two: the greater confidence, that of both where they agree."""
    return F.when((a["intent"] == b["intent"]) | (a["confidence"] >= b["confidence"]), F.struct(a["intent"].alias("intent"), F.greatest(a["confidence"], b["confidence"]).alias("confidence"))).otherwise(F.struct(b["intent"].alias("intent"), b["confidence"].alias("confidence")))


def diagnosis_confidence(metrics: Column, knowledge: Column, rules: Column, critical: Column, model: Column) -> Column:
    """0.4 and what each finding adds, from 0.1 to 1."""
    added = [(metrics, 0.2), (knowledge, 0.2), (rules, 0.1), (critical, 0.1), (model, 0.05)]
    total = F.lit(0.4)
    for flag, weight in added:
        total = total + F.when(F.coalesce(flag, F.lit(False)), weight).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), total))


def relevance(scores: DataFrame, by: str) -> DataFrame:
    """``(by, score, level)`` of ``(by, similarity, match, completeness, accuracy)``: the weighted mean
    of the four means, and its level."""
    weights = {"similarity": 0.4, "match": 0.3, "completeness": 0.2, "accuracy": 0.1}
    mean = sum((F.avg(c) * w for c, w in weights.items()), F.lit(0.0))
    level = F.when(F.col("score") > 0.8, "high").when(F.col("score") > 0.5, "medium").when(F.col("score") > 0.3, "low").otherwise("none")
    return scores.groupBy(by).agg(mean.alias("score")).select(by, "score", level.alias("level"))
