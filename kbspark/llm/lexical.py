"""Ranked lexical search over a clustered index: graph bisection orders the documents, shards are visited
by their bounds until no other one can matter."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.llm.bpe import slices
from kbspark.llm.common import cut, keyed_text, stored, table, utf8
from kbspark.llm.licenses import WORD_BYTES

#: Slots that the terms of the bisected graph are hashed to, levels of the bisection, documents it is fitted on.
SLOTS, LEVELS, SAMPLE = 4096, 8, 16_384
#: Rounds of exchanges between two halves, at most.
EXCHANGES = 20
#: Documents and bytes of text after which a shard is closed.
SHARD_DOCS, SHARD_BYTES = 256, 4_000_000
#: Items and distinct item terms that are searched together.
BLOCK_ITEMS, BLOCK_TERMS = 1000, 200_000
#: Shards of an item visited in the first round; each further round visits four times as many.
FIRST_VISIT = 8


def terms(text: bytes) -> list[bytes]:
    """A-Z become a-z; ASCII letters and digits and everything beyond ASCII make terms."""
    return text.translate(WORD_BYTES).split()


def slots(text: bytes) -> np.ndarray:
    return np.unique(np.fromiter((crc32(t) % SLOTS for t in set(terms(text))), np.int32))


# Recursive bisection of the graph of documents and term slots
def cost(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> np.ndarray:
    """Bits that the gaps of each slot's postings take, by its degree in both halves."""
    return left * np.log2(n_left / (left + 1)) + right * np.log2(n_right / (right + 1))


def bisect(docs: np.ndarray, whose: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Which of ``docs`` go to the left half; ``whose`` and ``slot`` are the edges, by place in ``docs``.

    Both halves start equal. The documents that gain most by moving change sides in pairs, as long as
    a pair gains.
    """
    left = np.arange(len(docs)) < len(docs) // 2
    n_left, n_right = int(left.sum()), int((~left).sum())
    for _ in range(EXCHANGES):
        on_left = left[whose]
        a, b = (np.bincount(slot[side], minlength=SLOTS).astype(float) for side in (on_left, ~on_left))
        now = cost(a, b, n_left, n_right)
        to_right = now - cost(np.maximum(a - 1, 0), b + 1, n_left, n_right)
        to_left = now - cost(a + 1, np.maximum(b - 1, 0), n_left, n_right)
        gain = np.bincount(whose, np.where(on_left, to_right[slot], to_left[slot]), len(docs))
        ones, twos = np.flatnonzero(left), np.flatnonzero(~left)
        ones, twos = ones[np.argsort(-gain[ones], kind="stable")], twos[np.argsort(-gain[twos], kind="stable")]
        n = min(len(ones), len(twos))
        n = int((gain[ones[:n]] + gain[twos[:n]] > 1e-9).sum())
        if not n:
            break
        left[ones[:n]], left[twos[:n]] = False, True
    return left


def plan(sets: list[np.ndarray], levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """``(weights, border)`` of every node of the tree in heap order: a document goes left where the
    weights of its slots add up to more than the border."""
    nodes = (1 << levels) - 1
    weights, border = np.zeros((nodes, SLOTS), np.float32), np.zeros(nodes, np.float32)
    held = {0: np.arange(len(sets))}
    for node in range(nodes):
        docs = held.pop(node, np.zeros(0, int))
        if len(docs) < 4:
            continue
        size = np.array([len(sets[d]) for d in docs])
        whose, slot = np.repeat(np.arange(len(docs)), size), np.concatenate([sets[d] for d in docs])
        left = bisect(docs, whose, slot)
        a, b = (np.bincount(slot[side], minlength=SLOTS).astype(float) for side in (left[whose], ~left[whose]))
        n_left, n_right = int(left.sum()), int((~left).sum())
        joins_right, joins_left = (cost(x, y, n_left, n_right) for x, y in ((a, b + 1), (a + 1, b)))
        weights[node] = joins_right - joins_left
        pull = np.bincount(whose, weights[node][slot], len(docs))
        border[node] = np.median(pull)
        goes = pull > border[node]
        held[2 * node + 1], held[2 * node + 2] = docs[goes], docs[~goes]
    return weights, border


def leaf(found: np.ndarray, weights: np.ndarray, border: np.ndarray) -> int:
    """Places from left to right of the leaf that a document with these slots falls in."""
    node = 0
    while node < len(border):
        node = 2 * node + (1 if weights[node, found].sum() > border[node] else 2)
    return node - len(border)


def fit(docs: DataFrame, levels: int = LEVELS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The tree, fitted in one task on about ``sample`` documents, twice as many at most, drawn by a hash."""
    n = docs.count()
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))) < sample).limit(2 * sample).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [slots(t) for b in batches for t in utf8(b.column(1))]
        weights, border = plan([s for s in sets if len(s)], levels)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in weights], pa.binary()), pa.array(border)], ["weights", "border"])

    rows = drawn.mapInArrow(run, "weights binary, border float").toArrow()
    if not rows.num_rows:  # not even a partition
        return plan([], levels)
    weights = np.stack([np.frombuffer(w, np.float32) for w in rows.column("weights").to_pylist()])
    return weights, rows.column("border").to_numpy()


# The index
def postings(docs: list[tuple[object, list[bytes]]]) -> dict:
    """The inverted lists of one shard: for each term, ascending, its places ``at`` in the shard and
    frequencies ``tf``, and the pairs of frequency and length that no other pair of the list
    surpasses in both (``most``, ``least``)."""
    ids: dict[bytes, int] = {}
    term, tf, size = [], [], []
    for _, words in docs:
        counted = Counter(words)
        term += [ids.setdefault(w, len(ids)) for w in counted]
        tf += counted.values()
        size.append(len(counted))
    names = sorted(ids)
    rank = np.empty(len(ids), np.int64)
    rank[[ids[w] for w in names]] = np.arange(len(names))
    term, tf = rank[np.array(term, np.int64)], np.array(tf, np.int64)
    at = np.repeat(np.arange(len(docs), dtype=np.int32), size)
    n = np.array([len(w) for _, w in docs], np.int64)
    order = np.argsort(term, kind="stable")
    term, tf, at = term[order], tf[order], at[order]
    ends = np.cumsum(np.bincount(term, minlength=len(names)))
    best = np.lexsort((-tf, n[at], term))
    climbing = np.maximum.accumulate(term[best] * (1 << 40) + tf[best]) if len(best) else np.zeros(0, np.int64)
    front = np.ones(len(best), bool)
    front[1:] = climbing[1:] > climbing[:-1]
    best = best[front]
    lists = {"at": (at, ends), "tf": (tf, ends), "most": (tf[best], None), "least": (n[at[best]], None)}
    fronts = np.cumsum(np.bincount(term[best], minlength=len(names)))
    return {"term": names, **{k: (v, fronts if e is None else e) for k, (v, e) in lists.items()}, "n": n}


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """The clustered index as a table in the shared folder: ``(leaf, shard, term, at, tf, most, least,
    docs, n)``. In each shard the empty term's row lists the shard's ids and lengths.

    The tree is fitted on a bounded sample; every document is led down it and goes to its leaf. Rows are
    brought together by leaf, leaves of any size over as many tasks as their bytes need, and each task cuts its
    sorted stream into shards of at most ``SHARD_DOCS`` documents or about ``SHARD_BYTES`` bytes.
    """
    few = keyed_text(docs, id_col, text_col)
    kind = few.schema["doc_id"].dataType.simpleString()
    tree = few.sparkSession.sparkContext.broadcast(fit(few, levels))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, border = tree.value
        for b in slices(batches):
            where = pa.array([leaf(slots(t), weights, border) for t in utf8(b.column(1))], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, where], ["doc_id", "text", "leaf"])

    led = few.mapInArrow(lead, f"doc_id {kind}, text string, leaf int")
    clustered = led.hint("rebalance", "leaf").sortWithinPartitions("leaf", "doc_id", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 32) - 1
        held: list[tuple[object, list[bytes]]] = []
        bytes_, of = 0, None

        def close(id_type: pa.DataType) -> pa.RecordBatch:
            p = postings(held)
            n = 1 + len(p["term"])
            lists = [pa.ListArray.from_arrays(np.concatenate([[0, 0], e]).astype(np.int32), pa.array(v, pa.int32())) for v, e in (p[k] for k in ("at", "tf", "most", "least"))]
            ids = pa.array([[d for d, _ in held]] + [None] * (n - 1), pa.list_(id_type))
            sizes = pa.array([p["n"]] + [None] * (n - 1), pa.list_(pa.int32()))
            cols = [pa.array([of] * n, pa.int32()), pa.array([number] * n, pa.int64()), pa.array([b"", *p["term"]], pa.binary()), *lists, ids, sizes]
            return pa.RecordBatch.from_arrays(cols, ["leaf", "shard", "term", "at", "tf", "most", "least", "docs", "n"])

        for b in slices(batches):
            for doc, text, where in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                if held and (where != of or len(held) >= SHARD_DOCS or bytes_ >= SHARD_BYTES):
                    number += 1
                    yield close(b.column(0).type)
                    held, bytes_ = [], 0
                of = where
                held.append((doc, terms(text)))
                bytes_ += len(text)
            id_type = b.column(0).type
        if held:
            number += 1
            yield close(id_type)

    lists = ", ".join(f"{c} array<int>" for c in ("at", "tf", "most", "least"))
    return stored(clustered.mapInArrow(build, f"leaf int, shard long, term binary, {lists}, docs array<{kind}>, n array<int>"))


# The search
def terms_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(q, item_id, term, times)`` of the distinct items; ``q`` numbers them by a hash."""
    few = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    kind = few.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [Counter(terms(t)) for t in utf8(b.column(1))]
            whose = pa.array(np.repeat(np.arange(b.num_rows), [len(c) for c in found]))
            cols = [pa.array([x for c in found for x in side(c)], k) for side, k in ((dict.keys, pa.binary()), (dict.values, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(2).take(whose), b.column(0).take(whose), *cols], ["q", "item_id", "term", "times"])

    return few.withColumn("q", F.xxhash64("item_id", "text")).mapInArrow(run, f"q long, item_id {kind}, term binary, times long")


def bounds(touched: DataFrame, weights: DataFrame, n: int, total: int) -> DataFrame:
    """``(q, shard, bound, least_id)``: what no document of the shard surpasses, and the least id in it. The
    greatest contribution of a term in a shard is found from the surpassed-by-none pairs alone, without its list."""
    part = F.expr(f"transform(arrays_zip(most, least), p -> (1000000000L * p.most) div (1000L * p.most + 8 * (25 + ((75L * p.least * {n}L) div {total}L))))")
    best = touched.where("term <> X''").select("shard", "term", F.array_max(part).alias("best"))
    both = best.join(weights, "term")
    sums = both.groupBy("q", "shard").agg(F.sum(F.col("weight") * F.col("best")).alias("bound"))
    return sums.join(touched.where("term = X''").select("shard", F.array_min("docs").alias("least_id")), "shard")


def scored(touched: DataFrame, asked: DataFrame, weights: dict[int, list[tuple[bytes, int]]], n: int, total: int, k: int) -> DataFrame:
    """``(q, doc_id, score)``: the ``k`` best documents of each shard for each item that visits it."""
    kind = touched.schema["docs"].dataType.elementType.simpleString()
    sent = touched.sparkSession.sparkContext.broadcast(weights)

    def run(lists: pa.Table, visits: pa.Table) -> pa.Table:
        names = lists.column("term").to_pylist()
        head = names.index(b"") if b"" in names else None
        out: tuple[list, list, list] = ([], [], [])
        id_type = lists.schema.field("docs").type.value_type
        if head is not None:
            ids = lists.column("docs")[head].as_py()
            m = 25 + (75 * np.array(lists.column("n")[head].as_py(), np.int64) * n) // total
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)))
            place = np.empty(len(ids), int)
            place[order] = np.arange(len(ids))
            parts = {}
            for name, at, tf in zip(names, lists.column("at").to_pylist(), lists.column("tf").to_pylist(), strict=True):
                at, tf = np.array(at, int), np.array(tf, np.int64)
                parts[name] = (at, (1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
            for q in set(visits.column("q").to_pylist()):
                score = np.zeros(len(ids), np.int64)
                for name, weight in sent.value[q]:
                    if name in parts:
                        at, part = parts[name]
                        score[at] += weight * part
                best = np.lexsort((place, -score))[:k]
                best = best[score[best] > 0]
                out[0].extend([q] * len(best))
                out[1].extend(ids[i] for i in best)
                out[2].extend(score[best].tolist())
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], id_type), pa.array(out[2], pa.int64())], ["q", "doc_id", "score"])

    visited = touched.join(asked.select("shard").distinct(), "shard", "left_semi").select("shard", "term", "at", "tf", "docs", "n")
    return visited.groupBy("shard").cogroup(asked.select("shard", "q").groupBy("shard")).applyInArrow(run, f"q long, doc_id {kind}, score long")


def best(rows: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.select("q", "doc_id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def search_block(held: DataFrame, asked: DataFrame, n: int, total: int, k: int) -> DataFrame:
    """``(q, rank, doc_id, score)`` for a block of items ``asked(q, term, times)``, by rounds of visits.

    An item visits its shards by descending bound, of equal ones those with the least ids first. Once the best ``k``
    scores found are known, a shard can be left out whose bound is below the last of them, or equals it
    while all of the shard's ids are greater. So the rounds stop exactly, also where very many documents score the same.
    """
    spark = held.sparkSession
    touched = stored(held.join(asked.select("term").distinct(), "term", "left_semi").unionByName(held.where("term = X''")))
    df = touched.where("term <> X''").groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = stored(asked.join(df, "term").select("q", "term", (F.col("times") * weight).alias("weight")).where("weight > 0"))
    sent: dict[int, list[tuple[bytes, int]]] = {}
    for q, term, w in zip(*weights.toArrow().select(["q", "term", "weight"]).to_pydict().values(), strict=True):
        sent.setdefault(q, []).append((term, w))
    if not sent:
        return best(spark.createDataFrame([], f"q long, doc_id {held.schema['docs'].dataType.elementType.simpleString()}, score long"), k)
    limit = stored(bounds(touched, weights, n, total))
    kind = held.schema["docs"].dataType.elementType.simpleString()
    state: list[tuple] = [(q, 1, None) for q in sent]  # item, score to reach, id that has it last
    found, visited, visit = None, None, FIRST_VISIT
    while True:
        seen = spark.createDataFrame(state, f"q long, reach long, reach_id {kind}")
        rest = limit if visited is None else limit.join(visited, ["q", "shard"], "left_anti")
        left = rest.join(F.broadcast(seen), "q").where("bound > reach or (bound = reach and (reach_id is null or least_id < reach_id))")
        order = W.partitionBy("q").orderBy(F.desc("bound"), F.asc_nulls_last("least_id"), "shard")
        asks = cut(left.withColumn("place", F.row_number().over(order)).where(F.col("place") <= visit).select("q", "shard"))
        if asks.isEmpty():
            return found if found is not None else best(spark.createDataFrame([], f"q long, doc_id {kind}, score long"), k)
        new = scored(touched, asks, sent, n, total, k)
        found = cut(best(new if found is None else new.unionByName(found.select(*new.columns)), k))
        reach = {r["q"]: (r["score"], r["doc_id"]) for r in found.where(F.col("rank") == k).collect()}
        state = [(q, *reach.get(q, (1, None))) for q in sent]
        visited, visit = asks if visited is None else visited.unionByName(asks), visit * 4


def search(held: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of the index for each item.

    Items are searched in blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_TERMS`` terms, whose weights are
    sent to all tasks. Items without terms, or with none that any document has, give no rows. Repeated items are one; two
    texts under one id are ranked apart. Null texts have no terms; documents of null id rank behind
    equal scores, repeated rows each for itself.
    """
    asked = stored(terms_of(items, id_col, text_col))
    size = asked.agg(F.count_distinct("q").alias("q"), F.count("*").alias("t")).first()
    seen = held.where("term = X''").select(F.explode("n").alias("n")).where("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
    blocks = max(1, -(-size["q"] // BLOCK_ITEMS), -(-size["t"] // BLOCK_TERMS))
    names = asked.select("q", "item_id").distinct()
    out = None
    for i in range(blocks):
        mine = asked.where(F.pmod("q", F.lit(blocks)) == i).select("q", "term", "times")
        part = search_block(held, mine, seen["n"], seen["total"] or 1, k)
        out = part if out is None else out.unionByName(part)
    return out.join(names, "q").select("item_id", "rank", "doc_id", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    held = index(table(spark, sf_dir, "documents"))
    return search(held, table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL11 = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents), one AS (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d),
    p AS (SELECT doc_id, n, term, count(*) AS tf FROM one GROUP BY ALL), z AS (SELECT count(*) AS big_n, sum(len(words)) AS big_l FROM d WHERE len(words) > 0),
    w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * (SELECT big_n FROM z) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term),
    q AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark), q2 AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
    s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
          FROM q2 JOIN w USING (term) JOIN p USING (term), z GROUP BY item_id, doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
