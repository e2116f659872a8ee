"""Keyword, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.text import tokens
from kbspark.operators.skew import join_found

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(term, doc_id, tf)``: the inverted index; counts are summed before the shuffle."""
    terms = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it uses it and wherever the optimizer
    puts it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(text: Column, terms: list[str]) -> Column:
    """``struct<dl, tf0, tf1, ...>``: the tokens of a text and how often each term is one of them.

    The text is reduced once to its tokens with two blanks between; a term with its own two blanks is
    then counted by what removing it takes away, so no array of tokens is made.
    """
    spaced = F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    taken = lambda t, w: F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))
    counts = lambda t: [(taken(t, f" {w} ") / (len(w) + 2)).cast("int").alias(f"tf{i}") for i, w in enumerate(terms)]
    dl = lambda t: F.when(F.trim(t) == "", 0).otherwise((taken(t, " ") / 2).cast("int")).alias("dl")
    return let(spaced, lambda t: F.struct(dl(t), *counts(t)))


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of the documents with any of the terms, by Robertson's formula.

    Only lengths and the counts of the query's terms leave the scan; the corpus statistics are one
    aggregated row, so nothing but that row is shuffled. Documents are tokenised for the statistics,
    and again only where a term occurs in the text at all.
    """
    terms = [t.lower() for t in terms]
    text = F.col(text_col)
    counted = term_counts(text, terms).alias("c")
    stats = docs.select(counted).agg(F.count("*").alias("n"), F.avg("c.dl").alias("avgdl"), *[F.count_if(F.col(f"c.tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    maybe = F.lit(False)
    for t in terms:
        maybe = maybe | F.contains(F.lower(text), F.lit(t))
    seen = docs.where(maybe).select(F.col(id_col).alias("doc_id"), counted).select("doc_id", "c.*")
    score = sum((_term_score(i) for i in range(len(terms))), F.lit(0.0))
    scored = seen.crossJoin(F.broadcast(stats)).select("doc_id", score.alias("score"))  # one row
    return scored.where("score > 0")


def _term_score(i: int) -> Column:
    tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
    idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for unequal lengths and zero vectors."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def vector_search(
    rows: DataFrame, query: list[float], k: int | None, threshold: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """The ``k`` rows nearest to ``query`` by cosine, then those from the threshold on: in that order.
    Without ``k`` all rows are scored."""
    target = F.array(*[F.lit(float(x)) for x in query])
    found = rows.select(F.col(id_col), cosine(F.col(vec_col), target).alias("score"))
    top = found if k is None else found.orderBy(F.desc("score"), id_col).limit(k)
    return top if threshold is None else top.where(F.col("score") >= threshold)


def fuse(vector: DataFrame, keyword: DataFrame, alpha: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """``alpha`` times the vector score plus the rest of the keyword score; a missing score is 0."""
    v, t = vector.withColumnRenamed("score", "v"), keyword.withColumnRenamed("score", "t")
    both = v.join(t, id_col, "full_outer")
    return both.select(id_col, (alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("t", F.lit(0.0))).alias("score"))


def passing_or_all(hits: DataFrame, least: float) -> DataFrame:
    """Hits from ``least`` on; all of them if that leaves none."""
    flag = hits.agg(F.coalesce(F.bool_or(F.col("score") >= least), F.lit(False)).alias("any_pass"))
    return hits.crossJoin(F.broadcast(flag)).where((F.col("score") >= least) | ~F.col("any_pass")).drop("any_pass")  # one row


def duplicates(docs: DataFrame, id_col: str, hash_col: Column, name_col: str, size_col: str) -> DataFrame:
    """Each row with the least id of equal hash and of equal name and size, and the kind of match.

    Both least ids are minima that are summed before the shuffle; groups of any size are joined back
    with their rows dealt over several tasks.
    """
    seen = docs.select(id_col, hash_col.alias("h"), F.coalesce(F.col(name_col).cast("string"), F.lit("")).alias("name_"), F.coalesce(F.col(size_col), F.lit(-1)).alias("size_"))
    for keys, to in ((["h"], "by_hash"), (["name_", "size_"], "by_name_size")):
        least = seen.groupBy(*keys).agg(F.min(id_col).alias(to), F.count("*").alias("n_"))
        seen = join_found(seen, least, keys, "n_")
    label = (
        F.when((F.col("by_hash") < F.col(id_col)) & (F.col("by_hash") == F.col("by_name_size")), "exact_match")
        .when((F.col("by_hash") < F.col(id_col)) & (F.col("by_name_size") < F.col(id_col)), "hash_match_different_name")
        .when(F.col("by_hash") < F.col(id_col), "hash_match")
        .when(F.col("by_name_size") < F.col(id_col), "name_size_match")
        .otherwise("new")
    )
    return seen.select(id_col, "by_hash", "by_name_size", label.alias("label"))
