"""Alignment of two tokenizers by byte offsets, and corpus counts of the token pairs that it links."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.llm.bpe import byte_letters, slices
from kbspark.llm.common import keyed_text, lookup, stored, strings, table

#: A pair key is the first id times this plus the second one.
BASE = 1 << 20
#: Tasks that share the rows of one pair in the first stage of counting.
SALTS = 16
#: Pairs whose counts are broadcast, about 16 bytes each; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000


class Pair:
    """Both tokenizers with the bytes of each of their tokens.

    The first vocabulary is read from its JSON file and merged by the ``tiktoken`` library, which gives the ids of
    ``tokenizers`` (a test compares them for every code point) in a third of the time.
    """

    def __init__(self, first: str, second: str):
        from sentencepiece import SentencePieceProcessor

        byte = {letter: b for b, letter in enumerate(byte_letters())}
        with open(first, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["id"] for t in spec["added_tokens"]}
        ids = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
        self.a_bytes: list[bytes] = [b""] * (1 + max(ids.values()))
        for token, i in ids.items():
            self.a_bytes[i] = token
        # Ids of this vocabulary stand in the order of its merges, so they serve as ranks.
        self.first = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})
        self.second = SentencePieceProcessor(model_file=second)
        size = self.second.get_piece_size()
        self.b_bytes = [self._piece(i) for i in range(size)]
        self.a_size, self.b_size = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.decimal = np.array([str(i) for i in range(max(len(self.a_bytes), size))], object)

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        if self.second.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both for each text, none where a text is empty or the tokens' bytes are not its own."""
        spaced = [" " + t for t in texts]
        one = [self.first.encode_ordinary(t) for t in spaced]
        two = self.second.encode(texts, num_threads=1) if texts else []
        for i, text in enumerate(texts):
            whole = spaced[i].encode("utf-8", "surrogatepass")
            if not text or b"".join(map(self.b_bytes.__getitem__, two[i])) != whole or b"".join(map(self.a_bytes.__getitem__, one[i])) != whole:
                one[i], two[i] = [], []
        return one, two


@lru_cache(maxsize=2)
def load(first: str, second: str) -> Pair:
    return Pair(first, second)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of tokens whose byte ranges overlap; both sequences cover the same bytes."""
    starts = np.concatenate([[0], a_ends[:-1]])
    first = np.searchsorted(b_ends, starts, "right")
    last = np.searchsorted(b_ends, a_ends, "left")
    n = last - first + 1
    a = np.repeat(np.arange(len(a_ends)), n)
    before = np.repeat(np.cumsum(n) - n, n)
    return a, np.arange(len(a)) - before + np.repeat(first, n)


def aligned(pair: Pair, texts: list[str]) -> dict[str, list]:
    """Columns of the alignment of each text, computed for all texts in one stretch.

    Every text is covered whole by both token sequences, so its end is a common cut of the
    concatenation, and no group or link reaches over it.
    """
    one, two = pair.encode(texts)
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (one, two))
    a, b = (np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((one, n_a), (two, n_b)))
    a_ends, b_ends = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    a_group, b_group = np.searchsorted(common, a_ends, "left"), np.searchsorted(common, b_ends, "left")
    texts_of_a, texts_of_b = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
    left, right = overlaps(a_ends, b_ends) if len(a) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    of_link = texts_of_a[left]
    # Links of a text by pair: sorted by text and key, then counted by runs.
    key = a[left] * BASE + b[right]
    order = np.argsort(of_link * BASE**2 + key, kind="stable")  # a slice has few texts
    key, of_key = key[order], of_link[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of_key[1:] != of_key[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(key)))
    n_keys = np.bincount(of_key[at], minlength=len(texts))
    group_end = np.flatnonzero(np.diff(np.append(a_group, len(common)))) if len(a) else np.zeros(0, np.int64)
    n_groups = np.bincount(texts_of_a[group_end], minlength=len(texts))
    # One sequence: the first side's tokens of a group, then the second side's; each with what follows it.
    side = np.concatenate([a_group * 2, b_group * 2 + 1])
    order = np.argsort(side, kind="stable")
    ids, side, whose = np.concatenate([a, b])[order], side[order], np.concatenate([texts_of_a, texts_of_b])[order]
    after = np.full(len(ids), ",", object)
    edge = np.flatnonzero(np.diff(np.append(side, -1)))
    after[edge] = np.where(side[edge] % 2 == 0, "|", ";")
    written = np.empty(2 * len(ids), object)
    written[0::2], written[1::2] = pair.decimal[ids], after
    ends = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(texts)))])
    sha = ["" if z == s else hashlib.sha256("".join(written[2 * s : 2 * z - 1]).encode()).hexdigest() for s, z in zip(ends, ends[1:], strict=False)]
    offsets = np.concatenate([[0], np.cumsum(n_keys)]).astype(np.int32)
    return {
        "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups, pa.int64()),
        "n_links": pa.array(np.bincount(of_link, minlength=len(texts)), pa.int64()), "groups_sha256": pa.array(sha, pa.string()),
        "keys": pa.ListArray.from_arrays(offsets, pa.array(key[at])), "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
    }


def alignments(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times)``: one row per input row, no shuffle.
    ``keys`` are the distinct linked pairs of the text, ``times`` how many of its links are each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(first, second)
        for b in slices(batches):
            cols = aligned(pair, strings(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols.values()], ["doc_id", *cols])

    few = keyed_text(docs, id_col, text_col)
    kind = few.schema["doc_id"].dataType.simpleString()
    return few.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<long>")


def pair_counts(found: DataFrame) -> DataFrame:
    """``(key, n, best)``: how many rows hold each pair, and whether no pair of its first id is in more.

    Counted in two stages: each task sums its own rows, the first shuffle deals a pair over ``SALTS``
    tasks, the second brings the few sums together. One first id has at most as many pairs as the second vocabulary has ids.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")
    part = found.select(F.explode("keys").alias("key"), salt).groupBy("key", "salt").agg(F.count("*").alias("n"))
    whole = part.groupBy("key").agg(F.sum("n").alias("n"))
    most = F.max("n").over(W.partitionBy(F.floor(F.col("key") / BASE)))
    return whole.select("key", "n", (F.col("n") == most).alias("best"))


def with_counts(found: DataFrame, counts: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``found`` with ``n_best`` and ``count_sum`` in place of its pairs. ``found`` is a table, ``counts`` too.

    The counts are looked up in each task while they are few enough to be broadcast, else joined."""
    kept = [c for c in found.columns if c not in ("keys", "times")]
    if counts.count() <= most:
        arrow = counts.orderBy("key").toArrow()
        sent = found.sparkSession.sparkContext.broadcast([arrow.column(c).to_numpy() for c in ("key", "n", "best")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, n, best = sent.value
            for b in batches:
                asked, times = b.column("keys"), b.column("times")
                at = np.searchsorted(key, asked.flatten().to_numpy())
                links = times.flatten().to_numpy()
                size = np.diff(asked.offsets.to_numpy())
                whose = np.repeat(np.arange(b.num_rows), size)
                sums = []
                for value in (links * best[at], links * n[at]):
                    total = np.zeros(b.num_rows, np.int64)
                    np.add.at(total, whose, value)
                    sums.append(pa.array(total))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *sums], [*kept, "n_best", "count_sum"])

        kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in kept)
        return found.mapInArrow(run, f"{kinds}, n_best long, count_sum long")
    # Rows go by a hash of all they hold: equal rows have equal sums.
    marked = found.withColumn("row", F.xxhash64("doc_id", "groups_sha256", "n_a", "n_b"))
    asked = marked.select("row", F.explode(F.arrays_zip("keys", "times")).alias("l")).select("row", "l.*").withColumnRenamed("keys", "key")
    asked = asked.groupBy("row", "key").agg(F.max("times").alias("times"))
    looked = lookup(asked, counts.withColumn("count_", F.col("n")), ["key"], "count_")
    sums = looked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return marked.join(sums, "row", "left").select(*kept, zero("n_best"), zero("count_sum"))


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BROADCAST) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum)``, one row per input row.

    The text is encoded once, by the first tokenizer behind a space and by the second as it is; the
    alignments are written to the shared folder. Null and empty texts and texts that a tokenizer does
    not give back byte for byte have zeros and an empty digest. Repeated rows count as so many
    documents; other columns of ``docs`` are not looked at.
    """
    found = stored(alignments(docs, first, second, id_col, text_col))
    return with_counts(found, stored(pair_counts(found)), most)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of every document under the two public vocabularies."""
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = align(table(spark, sf_dir, "documents"), *paths)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
