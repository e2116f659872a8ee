"""Near-duplicates by word shingles: MinHash buckets give candidates, exact Jaccard decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.llm.common import cut, lookup, rows, utf8
from kbspark.llm.components import components
from kbspark.llm.simhash import links, simhash

#: A pair of similarity s shares a bucket with probability 1 - (1 - s^4)^20: all but 3 in 100,000 at 0.8.
BANDS, PER_BAND = 20, 4
#: In a bucket each text is compared with the first one and, where still apart, with so many before it.
BEFORE = 8
#: Texts of a bucket that are put in order in one task.
SIDE_BY_SIDE = 256
#: Bytes of sets that one task holds against as many of their buckets.
BLOCK_BYTES = 16_000_000
SEED = 42
BLOCK = 1 << 12  # shingles that are spread over all hash functions at once
_rng = np.random.default_rng(SEED)
ODD, MASK = (_rng.integers(0, 1 << 64, BANDS * PER_BAND, np.uint64) for _ in range(2))
ODD |= np.uint64(1)


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of runs of ``width`` words; of all words where there are fewer."""
    words = text.lower().split()
    runs = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words] if words else []
    return np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(x)) for x in runs], "<u8"))


def bands(found: np.ndarray) -> list[int]:
    """A key for each band of MinHash values."""
    least = np.full(BANDS * PER_BAND, np.uint64((1 << 64) - 1))
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, ((found[at : at + BLOCK, None] ^ MASK) * ODD).min(axis=0))
    parts = least.astype("<u8").reshape(BANDS, PER_BAND)
    return [xxhash.xxh3_64_intdigest(p.tobytes(), i) - (1 << 63) for i, p in enumerate(parts)]


def signed(texts: DataFrame, width: int, fingerprint: bool = False) -> DataFrame:
    """``texts`` with ``text`` replaced by ``node``, a hash of its set of shingles, ``bands``, and ``fp``,
    its SimHash fingerprint if asked for, which is then a part of what ``node`` is a hash of."""
    names = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            texts_ = utf8(b.column("text"))
            sets = [shingles(t, width) for t in texts_]
            fps = np.array([simhash(t) for t in texts_] if fingerprint else [0] * len(texts_), np.uint64)
            node = pa.array([xxhash.xxh3_64_intdigest(x.tobytes(), int(f)) - (1 << 63) for x, f in zip(sets, fps, strict=True)], pa.int64())
            keys = pa.array([bands(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], node, keys, pa.array(fps.view(np.int64))], [*names, "node", "bands", "fp"])

    kinds = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in names]
    return texts.mapInArrow(run, ", ".join([*kinds, "node long", "bands array<long>", "fp long"]))


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """``(node, shingles)`` of ``texts(node, text)``; the hashes are joined to one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            found = pa.array([shingles(t, width).tobytes() for t in utf8(b.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("node"), found], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets have a Jaccard similarity of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                u, v = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both >= least * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sized = sets.withColumn("n", F.length("shingles"))
    joined = pairs.join(sized.select(F.col("node").alias("a"), F.col("shingles").alias("x"), F.col("n").alias("nx")), "a")
    joined = joined.join(sized.select(F.col("node").alias("b"), F.col("shingles").alias("y"), F.col("n").alias("ny")), "b")
    near = joined.where(F.least("nx", "ny") >= F.lit(least) * F.greatest("nx", "ny"))
    return near.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def linked(buckets: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``(node, root)``: equal roots for texts connected by similar pairs of
    ``buckets(key, node, first, size)``.

    First every text is compared with the first one of each bucket, the same in all buckets as far
    as can be, which joins most of a large group by few pairs. Then texts that have no such partner
    in common are compared with those next to them, in another order for each bucket, and a bucket
    of up to ``BEFORE + 1`` texts has all of its pairs. In larger buckets the texts that are still apart from the
    largest connected part are held against every other one of the bucket (``rest_links``), so no pair is left out
    but those of texts that are connected already.
    """
    stars = buckets.select(F.col("node").alias("a"), F.col("first").alias("b")).where("a <> b").distinct()
    near = cut(alike(stars, sets, least))
    # All texts with one partner are connected through it, so pairs of them need no comparison.
    partner = near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    placed = buckets.join(partner, "node", "left").withColumn("root", F.coalesce("root", "node"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SIDE_BY_SIDE)).alias("part")
    order = W.partitionBy("key", "part").orderBy(F.xxhash64("key", "node"), "node")
    before = F.array(*[F.lag(F.struct("node", "root"), k).over(order) for k in range(1, BEFORE + 1)])
    apart = (
        placed.select("key", "node", "root", part)
        .select("node", "root", before.alias("before"))
        .select("node", "root", F.explode(F.filter("before", lambda o: o.isNotNull() & (o["root"] != F.col("root")))).alias("o"))
        .select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b"))
        .distinct()
    )
    first = cut(components(near.unionByName(alike(apart, sets, least))))
    more = rest_links(buckets.where(F.col("size") > BEFORE + 1).select("key", "node").join(first, "node", "left").withColumn("root", F.coalesce("root", "node")), sets, least)
    if more is None:
        return first
    second = components(more)
    joined = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left")
    alone = second.join(first, "node", "left_anti")  # texts without a link before
    return joined.select("node", F.coalesce("over", "root").alias("root")).unionByName(alone.select("node", "root"))


def rest_links(members: DataFrame, sets: DataFrame, least: float, block_bytes: int = BLOCK_BYTES) -> DataFrame | None:
    """``(a, b)``: roots to connect, from all similar pairs of different roots within a bucket of
    ``members(key, node, root)``. None where every bucket is connected.

    Only texts outside the largest connected part of a bucket need to be compared, with every text of the bucket. They are
    dealt to blocks of about ``block_bytes``, and the texts of a block's buckets to parts of that size. Each block meets
    each of its parts in a task, by an inverted list of its hashes: pairs are not shuffled, and the driver gets no set.
    """
    parts = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1")
    held = cut(members.join(main.select("key", F.col("m.root").alias("main")), "key").join(sets.select("node", F.length("shingles").alias("bytes")), "node"))
    rest = held.where("root <> main")
    total = rest.agg(F.sum("bytes")).first()[0]
    if total is None:
        return None
    blocks = max(1, -(-total // block_bytes))
    per_key = rest.groupBy("key").agg(F.ceil(F.sum("bytes") / block_bytes).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("node"), F.greatest("shares", F.lit(1)))
    dealt = cut(rest.join(per_key, "key").select("key", "node", F.pmod(F.xxhash64("key", share), F.lit(blocks)).cast("int").alias("block")))
    all_ = held.join(dealt.select("key", "block").distinct(), "key").select("block", "node", "root", "bytes").distinct()
    met = cut(all_.join(dealt.select("block", "node").distinct().withColumn("asks", F.lit(True)), ["block", "node"], "left"))
    count = met.groupBy("block").agg(F.greatest(F.ceil(F.sum("bytes") / block_bytes), F.lit(1)).cast("int").alias("parts"))
    places = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array().cast("array<int>"))
    own = F.array(F.struct(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks")))
    to = F.concat(own, F.transform(places, lambda p: F.struct(p.alias("part"), F.lit(True).alias("asks"))))
    sent = met.join(F.broadcast(count), "block").select("block", "node", "root", to.alias("to")).join(sets, "node").select("block", "root", "shingles", F.explode("to").alias("to"))

    def run(group: pa.Table) -> pa.Table:
        asks, one, two = group.column("asks"), [], []
        asked = group.filter(asks)
        roots, size, vocabulary, starts, owners = inverted(asked.column("root").to_pylist(), asked.column("shingles").to_pylist())
        for b in rows(group.filter(pc.invert(asks)).to_batches()):
            for root, raw in zip(b.column("root").to_pylist(), b.column("shingles").to_pylist(), strict=True):
                mine = np.frombuffer(raw, "<u8")
                at = np.searchsorted(vocabulary, mine)
                at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == mine)] if len(vocabulary) else at[:0]
                lists = [owners[starts[k] : starts[k + 1]] for k in at]
                both = np.bincount(np.concatenate(lists), minlength=len(roots)) if lists else np.zeros(len(roots), int)
                hit = np.unique(roots[(both >= least * (len(mine) + size - both)) & (roots != root)])
                one += [root] * len(hit)
                two += hit.tolist()
        return pa.table([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["a", "b"])

    return cut(sent.select("block", "to.part", "to.asks", "root", "shingles").groupBy("block", "part").applyInArrow(run, "a long, b long").distinct())


def inverted(roots: list[int], raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """Roots and sizes of sets, and for each hash, ascending, which of the sets have it."""
    sets_ = [np.frombuffer(r, "<u8") for r in raw]
    size = np.array([len(s) for s in sets_])
    hashes, owner = np.concatenate([np.zeros(0, "<u8"), *sets_]), np.repeat(np.arange(len(sets_), dtype=np.int32), size)
    order = np.argsort(hashes, kind="stable")
    vocabulary, starts = np.unique(hashes[order], return_index=True)
    return np.array(roots, np.int64), size, vocabulary, np.append(starts, len(hashes)).astype(np.int32), owner[order]


def joined_by_fingerprint(placed: DataFrame, distance: int) -> DataFrame:
    """``placed(node, fp, root)`` with the roots that SimHash fingerprints within ``distance`` bits connect made equal.

    All roots of a component of fingerprints are linked to the least of them, so a large one costs a row a root.
    """
    near = cut(components(links(placed.select("fp").distinct(), distance)).withColumnRenamed("root", "over"))
    named = cut(placed.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("node", "root", F.coalesce("over", "fp").alias("over")))
    hubs = named.groupBy("over").agg(F.count("*").alias("n"), F.min("root").alias("hub"), F.max("root").alias("last")).where("hub <> last")
    edges = lookup(named, cut(hubs), ["over"], "n").select(F.col("root").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct()
    found = components(edges).select(F.col("node").alias("root"), F.col("root").alias("then"))
    return named.join(found, "root", "left").select("node", F.coalesce("then", "root").alias("root"))


def representatives(
    docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", distance: int | None = None
) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of texts connected by pairs whose sets of
    ``width`` words have a Jaccard similarity of ``least`` or more, the one of least id. With ``distance``
    texts whose SimHash fingerprints differ by at most so many bits are connected too.

    Blank and null texts are alike. Null ids count as least, rows of one id go by a hash of id and
    text, and of rows equal in both one stays. All columns are kept as they are.
    """
    keys = ["__near_a", "__near_b"]
    both = [F.xxhash64(F.lit(3), F.col(id_col), F.col(text_col)), F.hash(F.col(id_col), F.col(text_col))]
    marked = docs.withColumns(dict(zip(keys, both, strict=True)))
    texts = marked.select(F.col(id_col).alias("doc_id"), *keys, F.col(text_col).cast("string").alias("text"))
    prints = signed(texts, width, distance is not None)
    # Texts of equal sets are one node, so a group of copies costs one row.
    nodes = cut(prints.groupBy("node").agg(F.min(F.struct("doc_id", *keys)).alias("first"), F.first("bands").alias("bands"), F.first("fp").alias("fp")))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    buckets = cut(lookup(keyed, cut(shared.withColumn("size", F.col("n"))), ["key"], "n"))
    asked = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", *[f"first.{c}" for c in keys])
    sets = cut(sets_of(texts.join(asked, keys).dropDuplicates(["node"]), width))
    rooted = nodes.select("node", "first", "fp").join(linked(buckets, sets, least), "node", "left").withColumn("root", F.coalesce("root", "node"))
    if distance is not None:
        rooted = cut(rooted)
        rooted = rooted.drop("root").join(joined_by_fingerprint(rooted, distance), "node")
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(*[f"first.{c}" for c in keys])
    return marked.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)
