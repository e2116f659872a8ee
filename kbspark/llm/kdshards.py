"""Sharding by a k-d tree over metadata: every cut is a distributed weighted median, all in the JVM."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.llm.common import cut, stored, table

SHARDS = 40
#: Metadata dimensions beside the size of a document.
DIMS = ("source", "lang")
#: Bytes that a document costs beside its text.
OVERHEAD = 16
#: Bins of one histogram pass, and the share of a shard's bytes to which a cut must be exact.
BINS, CLOSE = 4096, 0.001
#: Bits of a coordinate, of the text's checksum and of the id's hash in a key: 63 in all.
CODE, TEXT, ID = 30, 16, 17
#: Rows that one window task numbers.
ROWS_PER_BUCKET = 500_000


def letters(text: Column, skip: int) -> Column:
    """Six bytes of a string behind the ``skip`` that all have in common, as a number in their order."""
    part = F.substring(F.encode(text, "UTF-8"), skip + 1, 6)
    return F.conv(F.rpad(F.hex(part), 12, "0"), 16, 10).cast("double")


def scaled(value: Column, low: float | None, high: float | None) -> Column:
    """A coordinate from 1 to 2^30 - 1 of a value between ``low`` and ``high``, 0 for null."""
    if low is None or high == low:
        return F.when(value.isNull(), 0).otherwise(1).cast("long")
    place = (value - F.lit(low)) / F.lit(high - low)
    return F.when(value.isNull(), 0).otherwise(1 + F.floor(place * F.lit((1 << CODE) - 2))).cast("long")


def coordinates(slim: DataFrame, dims: list[str]) -> DataFrame:
    """``slim`` with ``codes``, one coordinate a dimension, and ``tie``, the rest of the sort key.

    Rows of equal coordinates are ordered by their text's checksum and then by a hash of id and text,
    so that equal texts lie together and a cut can still fall between any two documents.
    """
    log = F.log2(F.col("size"))
    ends = [f(F.col(c)).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))]
    seen = slim.agg(*ends, F.min(log).alias("low"), F.max(log).alias("high")).first()
    codes = []
    shared = {c: len(os.path.commonprefix([(seen[f"{e}_{c}"] or "").encode() for e in ("min", "max")])) for c in dims}
    raw = {c: letters(F.col(c), skip) for c, skip in shared.items()}
    spans = slim.agg(*[f(raw[c]).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))]).first() if dims else {}
    for c in dims:
        codes.append(scaled(raw[c], spans[f"min_{c}"], spans[f"max_{c}"]))
    codes.append(scaled(log, seen["low"], seen["high"]))
    text = F.shiftright(F.col("text_crc32"), 32 - TEXT)
    tie = F.shiftleft(text, ID) + F.xxhash64("doc_id", "text_crc32").bitwiseAND(F.lit((1 << ID) - 1))
    return slim.select("doc_id", "size", "text_crc32", F.array(*codes).alias("codes"), tie.alias("tie"), F.lit(0).alias("node"))


def per_node(values: dict[int, int], shards: int, default: int, kind: str) -> Column:
    """A number for each node, by place in an array literal of as many entries as there are shards."""
    held = np.full(shards, default, kind)
    held[list(values)] = list(values.values())
    return F.get(F.lit(held), F.col("node"))


def cuts(rows: DataFrame, width: int, parts: dict[int, int], shards: int) -> dict[int, tuple[int, int, int]]:
    """``node -> (dimension, key, parts on the left)`` for each node of ``parts`` that more than one shard
    has to share, by one of ``width`` coordinates.

    A node is named by the first of its shards. It is cut along its widest coordinate where the bytes
    below stand to all as its shards on the left do to all. The place is found by histograms of the
    bytes over the range of keys, narrowed to the bin that the median falls in until that bin holds
    one key or less than ``CLOSE`` of a shard; a pass brings back one row for each node.
    """
    many = {node: k for node, k in parts.items() if k > 1}
    ends = [f(F.get("codes", F.lit(i))).alias(f"{name}{i}") for i in range(width) for name, f in (("a", F.min), ("z", F.max))]
    found = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()}
    open_, done = {}, {}
    for node, k in many.items():
        if node in found:
            r = found[node]
            dim = max(range(width), key=lambda i: (r[f"z{i}"] - r[f"a{i}"], -i))
            low, high = r[f"a{dim}"] << (TEXT + ID), (r[f"z{dim}"] << (TEXT + ID)) + (1 << (TEXT + ID)) - 1
            open_[node] = {"dim": dim, "low": low, "high": high, "below": 0, "goal": r["bytes"] * (k // 2) / k, "close": CLOSE * r["bytes"] / k}
    while open_:
        keyed = rows.select("node", "size", key_of(open_, shards).alias("key"))
        low, high = (per_node({n: s[c] for n, s in open_.items()}, shards, d, "int64") for c, d in (("low", 0), ("high", -1)))
        step = per_node({n: (s["high"] - s["low"]) // BINS + 1 for n, s in open_.items()}, shards, 1, "int64")
        inside = keyed.where((F.col("key") >= low) & (F.col("key") <= high)).withColumns({"low": low, "step": step})
        binned = inside.select("node", "size", "key", F.expr("(key - low) div step").alias("bin"))
        bins = binned.groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last"))
        total = F.sum("bytes").over(W.partitionBy("node").orderBy("bin"))
        goal = F.get(F.lit(np.array([open_[i]["goal"] - open_[i]["below"] if i in open_ else 0.0 for i in range(shards)])), F.col("node"))
        crossing = bins.withColumn("upto", total).where(F.col("upto") >= goal).groupBy("node").agg(F.min(F.struct("bin", "bytes", "first", "last", "upto")).alias("b"))
        for r in crossing.select("node", "b.*").collect():
            s = open_[r["node"]]
            before = s["below"] + r["upto"] - r["bytes"]
            if r["first"] == r["last"] or r["bytes"] <= s["close"]:
                nearer = s["goal"] - before < s["below"] + r["upto"] - s["goal"]
                done[r["node"]] = (s["dim"], r["first"] if nearer else r["last"] + 1, many[r["node"]] // 2)
                del open_[r["node"]]
            else:
                s |= {"low": r["first"], "high": r["last"], "below": before}
    return done


def key_of(state: dict[int, dict], shards: int) -> Column:
    """The sort key of a row along the dimension that its node is cut along."""
    dim = per_node({n: s["dim"] for n, s in state.items()}, shards, 0, "int32")
    return F.shiftleft(F.get("codes", dim), TEXT + ID) + F.col("tie")


def split(rows: DataFrame, made: dict[int, tuple[int, int, int]], shards: int) -> DataFrame:
    """Rows from their node's cut on go to the node of its right shards."""
    key = key_of({n: {"dim": c[0]} for n, c in made.items()}, shards)
    at = per_node({n: c[1] for n, c in made.items()}, shards, np.iinfo(np.int64).max, "int64")
    left = per_node({n: c[2] for n, c in made.items()}, shards, 0, "int32")
    return rows.withColumn("node", F.col("node") + F.when(key >= at, left).otherwise(0))


def shard(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, dims: tuple = DIMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``: leaves of near equal bytes, one row per input row.

    With ``target_bytes`` there are as many leaves as reach that size, else ``shards``. The tree is
    cut along metadata ``dims`` (strings; those that ``docs`` lacks are left out) and the logarithm of
    the size. Only ids, sizes, checksums and metadata are read again after the first pass, never a
    text. ``slot`` numbers the documents of a shard without gaps, by a hash bucket and then by id.

    A null text has no bytes and checksum 0; null metadata come first in their dimension. Rows equal
    in id and text are one unit of a cut, so they may lie on either side but always together. An
    empty table gives no rows; shards stay empty where there are fewer units than shards.
    """
    dims = [c for c in dims if c in docs.columns]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = [F.col(c).cast("string").alias(f"dim{i}") for i, c in enumerate(dims)]
    slim = stored(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *names))
    if target_bytes is not None:
        shards = max(1, -(-(slim.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    rows = cut(coordinates(slim, [f"dim{i}" for i in range(len(dims))]))
    parts = {0: shards}
    while any(k > 1 for k in parts.values()):
        rows = cut(split(rows, cuts(rows, len(dims) + 1, parts, shards), shards))
        parts = {n: k for node, whole in parts.items() for n, k in ((node, max(1, whole // 2)), (node + whole // 2, whole - whole // 2))}
    return numbered(rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard")))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``: numbers from 0 in each shard. A shard may be of any size: hash buckets of its rows
    are numbered side by side, and each starts behind the rows of the buckets before."""
    most = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    held = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(-(-most // ROWS_PER_BUCKET) or 1)).cast("int"))
    sizes = held.groupBy("shard", "bucket").count()
    before = F.sum("count").over(W.partitionBy("shard").orderBy("bucket")) - F.col("count")
    place = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    both = held.withColumn("place", place).join(sizes.select("shard", "bucket", before.alias("before")), ["shard", "bucket"])
    return both.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).alias("slot"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
