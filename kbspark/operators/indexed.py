"""Keyword, phrase, wildcard, fuzzy and Boolean search through the postings of ``sources.segments``.

Every reader names its terms, so that only their buckets' folders are listed and, within, only row
groups whose range of terms fits. No text is read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.operators import filters
from kbspark.operators.retrieval import K1, B
from kbspark.sources.scratch import folder
from kbspark.sources.segments import BUCKETS, Index, bucket_of, live, postings_of, rows_of

#: Blocks of postings that the first round of a top-k search scores; each further one takes four times as many.
FIRST_BLOCKS = 8
#: Bounds are sums of doubles in another order than scores, so they are raised by this share.
SLACK = 1e-9


def lists_of(index: Index, terms: list[str]) -> DataFrame:
    """The posting rows of the terms, of all segments."""
    spark = index.spark
    terms = sorted(set(terms))
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("t")).select(bucket_of("t")).distinct().collect() if terms else []
    return postings_of(index).where(F.col("bucket").isin(*[r[0] for r in wanted]) & F.col("term").isin(*terms)) if terms else postings_of(index).where("false")


def hits(index: Index, lists: DataFrame, positions: bool = False) -> DataFrame:
    """``(key, term, tf, dl)`` for each live row in the lists, with ``pos`` if asked."""
    name = index.key
    fields = [F.col("docs"), F.col("tf"), F.col("dl")]
    if positions:  # the places of a row are behind those of the rows before it
        ends = F.expr("aggregate(tf, cast(array(0) as array<int>), (a, t) -> concat(a, array(element_at(a, -1) + t)))")
        fields.append(F.expr("transform(sequence(0, size(tf) - 1), i -> slice(pos, ends[i] + 1, tf[i]))").alias("pos"))
        lists = lists.withColumn("ends", ends)
    zipped = lists.select("segment", "term", F.explode(F.arrays_zip(*fields)).alias("z")).select("segment", "term", "z.*").withColumnRenamed("docs", name)
    return live(index, zipped, name).drop("segment")


def match(index: Index, terms: list[str]) -> DataFrame:
    """Keys of the rows with any of the terms."""
    return hits(index, lists_of(index, [t.lower() for t in terms])).select(index.key).distinct()


def document_frequencies(index: Index, terms: list[str]) -> dict[str, int]:
    """Live rows with each term: the sizes of its lists where one segment is all there is, else counted."""
    lists = lists_of(index, terms)
    if len(index.entries) == 1:
        found = lists.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    else:
        found = hits(index, lists).groupBy("term").agg(F.count("*").alias("df"))
    return {r["term"]: r["df"] for r in found.collect()}


def _part(tf: str, dl: str, mean: float) -> str:
    return f"({K1 + 1}D * {tf} / ({tf} + {K1}D * ({1 - B}D + {B}D * {dl} / {mean!r}D)))"


def bm25(index: Index, terms: list[str], k: int | None = None) -> DataFrame:
    """``(key, score)`` by Robertson's formula over the live rows; the ``k`` best, ties by key, or all.

    With ``k`` the blocks are visited by descending bound, the sum of what each term can add at most
    by its best pairs of frequency and length. Once the k-th score is above a block's bound the
    search stops, exactly: blocks of an equal bound are still visited for their keys.
    """
    terms = [t.lower() for t in terms]
    spark, name = index.spark, index.key
    df = document_frequencies(index, terms)
    lists = lists_of(index, list(df))
    schema = hits(index, lists_of(index, [])).select(name, F.lit(0.0).alias("score"))
    if not df:
        return schema
    mean = max(index.total, 1) / max(index.n, 1)
    repeats = {t: terms.count(t) for t in df}
    weights = F.create_map(*[x for t, n in df.items() for x in (F.lit(t), F.lit(repeats[t]) * F.log(F.lit(1 + (index.n - n + 0.5) / (n + 0.5))))])
    idf = F.element_at(weights, F.col("term"))

    def scores(some: DataFrame) -> DataFrame:
        return hits(index, some).groupBy(name).agg(F.sum(idf * F.expr(_part("tf", "dl", mean))).alias("score"))

    if k is None:
        return scores(lists)
    best = F.array_max(F.expr(f"transform(arrays_zip(most, least), p -> {_part('p.most', 'p.least', mean)})"))
    path = folder(spark, "bounds")  # written, so that all rounds see the same doubles
    lists.groupBy("segment", "block").agg((F.sum(idf * best) * (1 + SLACK)).alias("bound")).write.parquet(path)
    bounds = spark.read.schema("segment int, block long, bound double").parquet(path)
    found, reach, visit, last = None, 0.0, FIRST_BLOCKS, None
    while True:
        rest = bounds.where(F.col("bound") >= reach)
        if last is not None:
            behind = (F.col("segment") > last[1]) | ((F.col("segment") == last[1]) & (F.col("block") > last[2]))
            rest = rest.where((F.col("bound") < last[0]) | ((F.col("bound") == last[0]) & behind))
        asked = rest.orderBy(F.desc("bound"), "segment", "block").limit(visit).collect()
        if not asked:
            return schema if found is None else found
        chosen = spark.createDataFrame([(r["segment"], r["block"]) for r in asked], "segment int, block long")
        new = scores(lists.join(F.broadcast(chosen), ["segment", "block"], "left_semi"))
        both = new if found is None else new.unionByName(found)
        rows = both.orderBy(F.desc("score"), name).limit(k).collect()
        found = spark.createDataFrame(rows, new.schema)
        if len(rows) == k:
            reach = rows[-1]["score"]
        last = (asked[-1]["bound"], asked[-1]["segment"], asked[-1]["block"])
        visit *= 4


def phrase(index: Index, words: list[str]) -> DataFrame:
    """Keys of the rows that hold the words one behind the other: by their places, no text is read."""
    words, name = [w.lower() for w in words], index.key
    if not words:
        return rows_of(index, [name]).where("false")
    found = hits(index, lists_of(index, words), positions=True)
    distinct = sorted(set(words))
    places = found.groupBy(name).agg(*[F.first(F.when(F.col("term") == w, F.col("pos")), ignorenulls=True).alias(f"p{i}") for i, w in enumerate(distinct)])
    starts: Column | None = None
    for offset, w in enumerate(words):
        mine = _shifted(F.col(f"p{distinct.index(w)}"), offset)
        starts = mine if starts is None else F.array_intersect(starts, mine)
    return places.where(F.size(starts) > 0).select(name)


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def vocabulary(index: Index) -> DataFrame:
    """``(bucket, term)``: the distinct terms of all segments; their lists are not read."""
    return postings_of(index).select("bucket", "term").distinct()


def by_pattern(index: Index, expression: str) -> DataFrame:
    """Keys of the rows with a term that matches a regular expression as a whole.

    The expression is held against the vocabulary; the terms found are joined to the lists by bucket and term,
    so that folders without one are pruned while the query runs.
    """
    found = vocabulary(index).where(F.col("term").rlike(f"^(?:{expression})$"))
    return hits(index, postings_of(index).join(found, ["bucket", "term"], "left_semi")).select(index.key).distinct()


def wildcard(index: Index, pattern: str) -> DataFrame:
    """As ``by_pattern`` for ``*`` and ``?``."""
    return by_pattern(index, "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower()))


def without(word: Column, edits: int) -> Column:
    """The word and what is left of it without any one letter, or any two."""
    less = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    out = F.array(word)
    for _ in range(edits):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, less))))
    return out


def edits_of(term: str) -> int:
    """Equal up to two letters, one edit up to five, else two."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def near_terms(words: DataFrame, asked: list[str]) -> DataFrame:
    """``(asked, term)``: terms of ``words(term)`` within the edits that each asked term allows.

    Both sides are reduced to what is left without up to so many letters; two words within as many
    edits share such a rest. Only words that share one are measured.
    """
    spark = words.sparkSession
    out = None
    for edits in sorted({edits_of(a) for a in asked}):
        mine = spark.createDataFrame([(a,) for a in asked if edits_of(a) == edits], "asked string")
        # The length differs by as many letters as were inserted, so other words need no rests.
        lengths = mine.agg(F.min(F.length("asked")) - edits, F.max(F.length("asked")) + edits).first()
        fit = words.where(F.length("term").between(*lengths))
        probes = mine.select("asked", F.explode(without(F.col("asked"), edits)).alias("rest"))
        rests = fit.select("term", F.explode(without(F.col("term"), edits)).alias("rest"))
        pairs = rests.join(F.broadcast(probes), "rest").select("asked", "term").distinct()
        near = pairs.where(F.levenshtein("asked", "term", edits) >= 0)
        out = near if out is None else out.unionByName(near)
    return out


def fuzzy(index: Index, terms: list[str], among: str | None = None) -> DataFrame:
    """``(key, asked)``: the rows with a term near an asked one; with ``among`` only terms that match it count."""
    words = vocabulary(index)
    words = words if among is None else words.where(F.col("term").rlike(f"^(?:{among})$"))
    near = near_terms(words.select("term").distinct(), sorted({t.lower() for t in terms})).withColumn("bucket", bucket_of("term", BUCKETS))
    lists = postings_of(index).join(near, ["bucket", "term"])
    zipped = lists.select("segment", "asked", F.explode("docs").alias(index.key))
    return live(index, zipped, index.key).select(index.key, "asked").distinct()


def boolean(index: Index, text: str, compatible: bool = False) -> DataFrame:
    """Keys of the rows for which a Boolean query holds, from the lists of its terms alone.

    A row is known by which of the terms it has. Where the query also holds for a row that has none of
    them, as with ``NOT`` alone, the other rows' keys are read too.
    """
    name = index.key
    query = filters.compatible_query if compatible else filters.boolean_query
    terms = sorted({w.lower() for w in re.findall(r"[^\s()]+", text) if w.upper() not in ("AND", "OR", "NOT")})
    has = hits(index, lists_of(index, terms)).groupBy(name).agg(F.collect_set("term").alias("words_"))
    none = index.spark.range(1).select(query(text, F.array().cast("array<string>")).alias("b")).first()["b"]
    if none:
        keys = rows_of(index, [name])
        has = keys.join(has, name, "left").withColumn("words_", F.coalesce("words_", F.array().cast("array<string>")))
    return has.where(query(text, F.col("words_"))).select(name)


def every(index: Index, *parts: DataFrame) -> DataFrame:
    """Keys that are in all of the parts: match, phrase, pattern or Boolean results."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, index.key, "left_semi")
    return out


def in_document(index: Index, parent: str, value, terms: list[str], most: int = 100) -> DataFrame:
    """``(key, score)``: the best rows of one parent document, by BM25 over its rows alone.

    Only the parent's rows are read for their number and mean length, and only the terms' lists."""
    name = index.key
    mine = rows_of(index, [name, parent, "dl"]).where(F.col(parent) == value)
    stats = mine.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    found = hits(index, lists_of(index, [t.lower() for t in terms])).join(mine.select(name), name, "left_semi")
    df = F.count("*").over(W.partitionBy("term"))
    scored = found.withColumn("df", df).crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return scored.groupBy(name).agg(F.sum(part).alias("score")).orderBy(F.desc("score"), name).limit(most)
