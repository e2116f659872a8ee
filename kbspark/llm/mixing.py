"""Mixing sources to target weights: raking to source, language and topic marginals, then sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.common import cut, lookup, table

#: Combinations of language and topic, whose factors the driver holds, and raking rounds at most.
MAX_PAIRS, ROUNDS, TOLERANCE = 100_000, 200, 1e-6
#: Up to this measured size the factors of the sources are broadcast, beyond it they are joined.
BROADCAST_BYTES = 32 << 20
MARGINS = ("source", "lang", "topic")
#: Production targets: each value's share of tokens to this power, so that large ones shrink; and
#: the share of all tokens that the sample should hold.
POWERS = {"source": 0.7, "lang": 0.85, "topic": 0.9}
KEEP = 0.6


def topic(text: Column) -> Column:
    """A coarse topic by the form of a text, total and disjoint."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.length(t) == 0, "empty")
        .when(t.contains(" | "), "tabular")
        .when(t.rlike(r"[*%&$#]{3}"), "marked")
        .when(t.rlike(r"(?i)licen[sc]e|all rights reserved"), "licensed")
        .when(t.contains("@") | t.rlike(r"\+[0-9]|[0-9]{6}"), "personal")
        .when(F.length(t) < 400, "short")
        .when(F.length(t) < 6000, "article")
        .otherwise("long")
    )


def tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x09-\x0D\x20]+"), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def describe(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> list[Column]:
    """The columns that mixing works on; null sources, languages and topics are values of their own."""
    text = F.col(text_col).cast("string")
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("<null>"))
    about = named(topic_col) if topic_col else topic(text)
    return [named(source_col).alias("source"), named(lang_col).alias("lang"), about.alias("topic"), tokens(text).alias("n_tokens")]


def target_shares(totals: dict[str, float], goal: float | dict[str, float]) -> dict[str, float]:
    """Shares of the tokens that each value should have.

    ``goal`` is a power, to which the values' own totals are raised, or a table of shares. Values
    that a table does not list share what it leaves in proportion to their totals; a table that sums
    to more than 1 is scaled to 1. Listed values without tokens are left out of the scaling.
    """
    if isinstance(goal, dict):
        given = {k: max(0.0, v) for k, v in goal.items() if totals.get(k, 0) > 0}
        rest = sum(v for k, v in totals.items() if k not in goal)
        left = max(0.0, 1 - sum(given.values())) if rest else 0.0
        raised = {k: given[k] if k in given else 0.0 if k in goal else left * v / rest for k, v in totals.items() if v > 0}
    else:
        raised = {k: v**goal for k, v in totals.items() if v > 0}
    whole = sum(raised.values())
    return {k: v / whole if whole else 0.0 for k, v in raised.items()}


class Rates:
    """What raking found: a frame ``(source, n_docs, a)`` and factors of languages and topics.

    The factor of a cell is the product of its three factors, its probability ``min(1, scale *
    factor)``. A source, language or topic without tokens has factor 1.
    """

    def __init__(self, sources: DataFrame, langs: dict[str, float], topics: dict[str, float], scale: float, bytes_of_sources: int):
        self.sources, self.langs, self.topics, self.scale, self.bytes_of_sources = sources, langs, topics, scale, bytes_of_sources

    def factor(self, a: Column, lang: Column, about: Column) -> Column:
        part = lambda of, c: F.coalesce(F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[c], F.lit(1.0)) if of else F.lit(1.0)
        return F.coalesce(a, F.lit(1.0)) * part(self.langs, lang) * part(self.topics, about)


def calibrate(cells: DataFrame, goals: dict[str, float | dict[str, float]] = POWERS, keep: float = KEEP) -> Rates:
    """Rakes ``cells(source, lang, topic, n_docs, cell_tokens)``.

    Sources may be as many as rows, so their factors stay in a frame with one row a source, holding
    its cells; given the factors of languages and topics, a source's own factor follows within its
    row. Each round is thus one aggregation of that frame to the tokens by language and topic,
    at most ``MAX_PAIRS`` numbers, from which the driver gets the next factors of these two. Then the
    scale is raised until the probabilities, at most 1 each, hold ``keep`` of all tokens: each step
    solves exactly for the cells below 1, and no cell comes back below, so it ends.
    """
    rows = cells.groupBy("lang", "topic").agg(F.sum("cell_tokens").alias("n")).limit(MAX_PAIRS + 1).collect()
    if len(rows) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} combinations of language and topic")
    rows.sort(key=lambda r: (r["lang"], r["topic"]))
    names = {m: sorted({r[m] for r in rows}) for m in ("lang", "topic")}
    at = {m: np.array([names[m].index(r[m]) for r in rows], int) for m in names}
    mass = np.array([float(r["n"] or 0) for r in rows])
    whole, count = mass.sum(), {m: len(names[m]) for m in names}
    goal = {}
    for m in names:
        totals = dict(zip(names[m], np.bincount(at[m], mass, count[m]), strict=True))
        shares = target_shares(totals, goals[m])
        goal[m] = whole * np.array([shares.get(n, 0.0) for n in names[m]])
    number = F.create_map(*[F.lit(x) for i, r in enumerate(rows) for x in (f"{r['lang']}\n{r['topic']}", i)]) if rows else None
    pair = number[F.concat_ws("\n", "lang", "topic")] if rows else F.lit(0)
    cell = F.struct(pair.alias("i"), F.col("cell_tokens").cast("double").alias("n"))
    by_source = cells.groupBy("source").agg(F.sum("n_docs").alias("n_docs"), F.sum("cell_tokens").cast("double").alias("total"), F.collect_list(cell).alias("cells"))
    wish = goals["source"]
    if isinstance(wish, dict):
        listed = F.create_map(*[F.lit(x) for k, v in wish.items() for x in (k, max(0.0, float(v)))]) if wish else F.create_map(F.lit(""), F.lit(0.0))
        given = F.when(F.col("total") > 0, listed[F.col("source")])
        sums = by_source.agg(F.sum(given).alias("g"), F.sum(F.when(listed[F.col("source")].isNull(), F.col("total"))).alias("r")).first()
        left = max(0.0, 1 - (sums["g"] or 0.0)) if sums["r"] else 0.0
        raised = F.coalesce(given, F.when(listed[F.col("source")].isNull(), F.col("total") * (left / sums["r"] if sums["r"] else 0.0)), F.lit(0.0))
    else:
        raised = F.when(F.col("total") > 0, F.pow("total", F.lit(float(wish)))).otherwise(0.0)
    by_source = cut(by_source.withColumn("raised", raised))
    sums = by_source.agg(F.sum("raised").alias("r"), F.sum(F.octet_length("source") + 24).alias("bytes")).first()
    share = F.col("raised") * F.lit(whole / sums["r"] if sums["r"] else 0.0)
    factors = {m: np.ones(count[m]) for m in names}

    def own() -> tuple[Column, Column]:
        """The source's factor given the others, and the others' product by pair."""
        held = F.array(*[F.lit(float(v)) for v in factors["lang"][at["lang"]] * factors["topic"][at["topic"]]])
        now = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["n"] * F.get(held, c["i"]))
        return F.when(now > 0, share / now).otherwise(1.0), held

    for _ in range(ROUNDS if whole else 0):
        a, held = own()
        each = by_source.select(a.alias("a"), F.explode("cells").alias("c")).groupBy("c.i").agg(F.sum(F.col("a") * F.col("c.n") * F.get(held, F.col("c.i"))).alias("m"))
        now = np.zeros(len(rows))
        for r in each.collect():
            now[r["i"]] = r["m"]
        worst = 0.0
        for m in ("lang", "topic"):
            has = np.bincount(at[m], now, count[m])
            change = np.divide(goal[m], has, out=np.ones(count[m]), where=has > 0)
            worst = max(worst, np.abs(change - 1).max(initial=0))
            factors[m] *= change
            now *= change[at[m]]
        if worst < TOLERANCE:
            break
    a, held = own()
    found = cut(by_source.select("source", "n_docs", a.alias("a"), "cells"))
    each = found.select("a", F.explode("cells").alias("c")).select((F.col("a") * F.get(held, F.col("c.i"))).alias("f"), F.col("c.n").alias("n"))
    scale = 0.0
    for _ in range(ROUNDS if whole else 0):
        full = F.col("f") * F.lit(scale) >= 1
        r = each.agg(F.sum(F.when(full, F.col("n"))).alias("full"), F.sum(F.when(~full, F.col("f") * F.col("n"))).alias("free")).first()
        if not r["free"]:
            break
        further = (min(keep, 1.0) * whole - (r["full"] or 0.0)) / r["free"]
        if further <= scale * (1 + 1e-12):
            break
        scale = further
    kept = [dict(zip(names[m], factors[m].tolist(), strict=True)) for m in ("lang", "topic")]
    return Rates(found.drop("cells"), *kept, scale if whole else keep, sums["bytes"] or 0)


def mix(
    docs: DataFrame,
    powers: dict[str, float] = POWERS,
    keep: float = KEEP,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic_col: str | None = None,
    targets: dict[str, dict[str, float]] | None = None,
) -> DataFrame:
    """The columns of ``docs`` with ``mix_topic, mix_tokens, mix_factor, mix_p, mix_kept`` behind them.

    ``targets`` gives shares of the tokens by value for any of the margins ``source``, ``lang`` and
    ``topic``; a margin without them aims at its own totals to a power of ``powers``. Topics are
    those of ``topic_col``, or coarse ones by the form of the text.

    One pass sums tokens by cell of source, language and topic, a hot source being summed before
    the shuffle; the cells are raked, and a second pass gives each row its cell's probability. A row
    is kept if a hash of its id and text, as a number from 0 to 1, is below it: the same in every
    run, independent of partitions, and equal for repeated rows. Null sources and languages are
    values of their own; null and empty texts have no tokens, topic "empty" and the probability of
    that cell. Columns of ``docs`` with the names of the new ones are replaced.
    """
    made = ["mix_topic", "mix_tokens", "mix_factor", "mix_p", "mix_kept"]
    docs = docs.drop(*made)
    d = dict(zip(("source", "lang", "topic", "n_tokens"), describe(docs, text_col, source_col, lang_col, topic_col), strict=True))
    cells = cut(docs.select(*d.values()).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("cell_tokens"), F.count("*").alias("n_docs")))
    rates = calibrate(cells, {**powers, **(targets or {})}, keep)
    seen = docs.select("*", *[d[c].alias(f"__mix_{c}") for c in d])
    found = rates.sources.select(F.col("source").alias("__mix_source"), F.col("n_docs").alias("__mix_docs"), F.col("a").alias("__mix_a"))
    if rates.bytes_of_sources <= BROADCAST_BYTES:
        both = seen.join(F.broadcast(found.drop("__mix_docs")), "__mix_source", "left")
    else:
        both = lookup(seen, found, ["__mix_source"], "__mix_docs", how="left")
    factor = rates.factor(F.col("__mix_a"), F.col("__mix_lang"), F.col("__mix_topic"))
    p = F.least(F.lit(1.0), factor * F.lit(rates.scale))
    u = (F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)).cast("double")
    values = [F.col("__mix_topic"), F.col("__mix_n_tokens"), factor, p, u < p]
    return both.select(*docs.columns, *[v.alias(n) for v, n in zip(values, made, strict=True)])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, tokens, raking factor, probability and outcome of the draw for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mix(docs).select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
        F.col("mix_factor").alias("factor"), F.col("mix_p").alias("p"), F.col("mix_kept").alias("kept"),
    )
