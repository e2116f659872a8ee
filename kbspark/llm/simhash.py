"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.llm.common import cut, hex64, keyed_text, lookup, rows, table, utf8
from kbspark.llm.components import components

SEED = 42
BLOCK = 1 << 16  # hashes that are spread into bits at once


def simhash(text: bytes, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of UTF-8 ``text``."""
    words = text.lower().split()  # on bytes: only A-Z, and exactly space and 0x09-0x0D
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), SEED)
    hashes = [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(width)), strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.array(hashes[at : at + BLOCK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(texts: DataFrame, width: int = 3) -> DataFrame:
    """``texts`` with ``text`` replaced by ``fp``, which holds the 64 bits as a signed long."""
    names = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            fp = np.array([simhash(t, width) for t in utf8(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(fp)], [*names, "fp"])

    kinds = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in names]
    return texts.mapInArrow(run, ", ".join([*kinds, "fp long"]))


def ball(radius: int) -> list[int]:
    """All signed 64-bit masks of at most ``radius`` set bits."""
    masks = [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints ``nodes(fp)`` within ``distance`` bits.

    Every fingerprint emits all variants within half the distance, rounded up; two fingerprints
    within the distance share at least one. All rows of a variant are distinct fingerprints of one
    small ball, so a bucket has at most as many rows as the ball has masks, whatever the input.
    Members are linked to the least of the bucket, not to each other; for an even distance any two
    members of a bucket are close enough, so the star keeps every connection. For an odd distance
    the star could miss a verified pair, and the few members are paired instead.
    """
    half = (distance + 1) // 2
    variants = nodes.select(
        "fp",
        F.explode(F.transform(F.array(*[F.lit(m) for m in ball(half)]), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"),
    )
    if distance % 2 == 0:
        least = variants.select("fp", F.min("fp").over(W.partitionBy("variant")).alias("b")).where("fp <> b")
    else:
        least = (
            variants.groupBy("variant")
            .agg(F.collect_list("fp").alias("all"))
            .where(F.size("all") > 1)
            .select(F.explode("all").alias("fp"), "all")
            .select("fp", F.explode("all").alias("b"))
            .where("fp > b")
        )
    found = least.select(F.col("fp").alias("a"), "b").distinct()
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def grouped(prints: DataFrame, first, distance: int) -> DataFrame:
    """``(fp, first, n)``: for each fingerprint of ``prints`` the least ``first`` of its component, and
    how many rows have it.

    Rows with equal fingerprints are one node, so a group of copies costs one row.
    """
    nodes = cut(prints.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")))
    found = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    return rooted.join(least, "root").select("fp", F.col("least").alias("first"), "n")


def near_groups(
    docs: DataFrame, width: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row.

    Defined cases: null or blank text has fingerprint zero and links like any other; a null id never
    becomes a component id unless its whole group has null ids; repeated rows are kept.
    """
    prints = cut(fingerprints(keyed_text(docs, id_col, text_col), width))
    named = cut(grouped(prints, F.col("doc_id"), distance))
    return lookup(prints, named, ["fp"], "n").select("doc_id", "fp", F.col("first").alias("component_id"))


def representatives(
    docs: DataFrame, width: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the one of least id.

    Null ids count as least, rows of one id go by a hash of id and text, and of rows equal in both
    one stays. All columns are kept as they are.
    """
    both = [F.xxhash64(F.lit(3), F.col(id_col), F.col(text_col)), F.hash(F.col(id_col), F.col(text_col))]
    marked = docs.withColumns({"__near_a": both[0], "__near_b": both[1]})
    texts = marked.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), "__near_a", "__near_b")
    prints = cut(fingerprints(texts, width))
    kept = grouped(prints, F.struct("doc_id", "__near_a", "__near_b"), distance).select("first.__near_a", "first.__near_b").distinct()
    keys = ["__near_a", "__near_b"]
    return marked.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id"
    )
