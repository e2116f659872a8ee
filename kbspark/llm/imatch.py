"""I-Match document fingerprints over randomised subsets of a lexicon."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.bpe import slices
from kbspark.llm.common import keyed_text, strings, table, utf8
from kbspark.llm.licenses import WORD_BYTES

#: The band: terms in at least this share of the documents (and in two), and at most that share.
RAREST, COMMONEST = 1 / 1000, 1 / 10
#: Subsets of the lexicon: so many of each level; level j keeps each term with probability 2^-j.
LEVELS, PER_LEVEL = 7, 9
#: Lexicon candidates that go to every task at most; beyond it they are counted by a shuffle.
MAX_SENT = 4_000_000
#: Subsets that hold a term, from the thinnest level on, on which likeness is judged.
JUDGED = 12

_SEEDS = np.array([xxhash.xxh64_intdigest(f"subset {i}") for i in range(LEVELS * PER_LEVEL)], np.uint64)
_MASKS = np.repeat(np.array([(1 << j) - 1 for j in range(1, LEVELS + 1)], np.uint64), PER_LEVEL)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def terms(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct lower-cased words of UTF-8 ``text``."""
    digest = xxhash.xxh3_64_intdigest
    return np.sort(np.array([digest(w) for w in set(text.translate(WORD_BYTES).split())], np.uint64))


def fingerprint(text: bytes, lexicon: np.ndarray) -> np.ndarray:
    """Signatures of the whole term set and of each subset; 0 stands for a subset without terms.

    Each is the sum of mixed term hashes, thus a hash of the sorted distinct terms. A text without
    a term of the lexicon is fingerprinted by all its terms.
    """
    found = terms(text)
    if len(lexicon) and len(found):
        at = np.minimum(np.searchsorted(lexicon, found), len(lexicon) - 1)
        known = found[lexicon[at] == found]
        found = known if len(known) else found
    out = np.zeros(1 + len(_SEEDS), np.uint64)
    if len(found):
        with np.errstate(over="ignore"):
            out[0] = mix(found).sum(dtype=np.uint64) | np.uint64(1)
            for at in range(0, len(found), 4096):
                m = mix(found[at : at + 4096, None] ^ _SEEDS[None, :])
                out[1:] += np.where(m & _MASKS[None, :], np.uint64(0), m >> np.uint64(8) | np.uint64(1)).sum(axis=0, dtype=np.uint64)
        folded = (mix(out[1:]) & np.uint64(0xFFFF)) | np.uint64(0)
        out[1:] = np.where(out[1:] == 0, 0, np.maximum(folded, 1))
    return out


def written(signatures: np.ndarray) -> str:
    return f"{int(signatures[0]):016x}" + signatures[1:].astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal term sets; else the share of equal signatures among the thinnest subsets in use."""
    if a[0] == b[0]:
        return 1.0
    used = (a[1:] != 0) | (b[1:] != 0)
    same = used & (a[1:] == b[1:])
    tally = seen = 0
    for level in range(LEVELS - 1, -1, -1):
        part = slice(level * PER_LEVEL, (level + 1) * PER_LEVEL)
        seen += int(used[part].sum())
        tally += int(same[part].sum())
        if seen >= JUDGED:
            break
    return tally / seen if seen else 0.0


def _counts(of: DataFrame, only: np.ndarray | None, share: float) -> DataFrame:
    """``(h, n)``: documents per term, summed in blocks of texts of each task.

    With ``only``: just these terms. With a share: just the terms of at least that share of the
    documents of a task; of a term that reaches the share over all tasks, none can be missing from
    every task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for b in slices(batches, text=0):
            parts = [terms(t) for t in utf8(b.column(0))]
            docs += len(parts)
            got = np.concatenate(parts) if parts else h[:0]
            if only is not None:
                if not len(only):
                    continue
                at = np.minimum(np.searchsorted(only, got), len(only) - 1)
                got = got[only[at] == got]
            g, c = np.unique(got, return_counts=True)
            both = np.concatenate([h, g])
            h, back = np.unique(both, return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([n, c]), minlength=len(h)).astype(np.int64)
            if len(h) > 8_000_000 and not share:
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])
                h, n = h[:0], n[:0]
        keep = n >= share * docs
        h, n = h[keep], n[keep]
        for at in range(0, len(h), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(n[part])], ["h", "n"])

    return of.mapInArrow(run, "h long, n long")


def lexicon(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST, text_col: str = "text", most: int = MAX_SENT) -> np.ndarray:
    """Sorted hashes of the terms within the band of document frequencies, counted over all documents.

    A first pass gathers the terms that are frequent enough in some task, a superset of the lexicon;
    a second counts exactly these. If the superset exceeds ``most``, the counts of all terms are
    shuffled instead, with the same result. The lexicon itself has at most
    (mean distinct terms of a document) / ``rarest`` entries, whatever the size of the corpus.
    """
    few = docs.select(F.col(text_col).cast("string").alias("text"))
    total = few.count()
    low, high = max(2.0, rarest * total), commonest * total
    near = _counts(few, None, rarest).select("h").distinct().limit(most + 1).toArrow()["h"].to_numpy()
    only = np.sort(near.view(np.uint64)) if len(near) <= most else None
    counted = _counts(few, only, 0.0).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n").between(low, high))
    found = counted.select("h").toArrow()["h"].to_numpy().view(np.uint64)
    return np.sort(found)


def fingerprints(docs: DataFrame, words: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` for each row; null and empty texts share the fingerprint of no terms."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [written(fingerprint(t, sent.value)) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    few = keyed_text(docs, id_col, text_col)
    return few.mapInArrow(run, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, per_bin: int = 5_000) -> DataFrame:
    """``(bin, guest, doc_id, text)``, sorted so that each row is followed by the next document.

    Documents go by descending id, null ids last, equal ids by text; after the last comes the first.
    Bins are ranges of ids between quantiles. The largest id of a bin also goes, as a guest, to the
    bin above it, and the largest of all to the lowest bin, so that no bin needs another. The texts
    are shuffled once. One id that is repeated very often stays in one bin, but is read as a stream.
    """
    facts = docs.agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).first()
    bins = min(10_000, max(1, facts["n"] // per_bin))
    at = docs.agg(F.percentile_approx("doc_id", [i / bins for i in range(1, bins)] or [0.5], 20 * bins).alias("q")).first()["q"]
    bounds, top = np.array(sorted(set(at or [])), np.int64), facts["top"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            plain = ids.fill_null(0).to_numpy(zero_copy_only=False)
            place = np.where(null, 0, np.searchsorted(bounds, plain, side="left"))
            guest = np.flatnonzero(~null & np.isin(plain, bounds))
            wrap = np.flatnonzero(null if top is None else ~null & (plain == top))
            rows = np.concatenate([np.arange(len(plain)), guest, wrap])
            to = np.concatenate([place, place[guest] + 1, np.zeros(len(wrap), np.int64)])
            mark = np.repeat([0, 1, 2], [len(plain), len(guest), len(wrap)])
            taken = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(mark), *taken.columns], ["bin", "guest", "doc_id", "text"])

    dealt = docs.mapInArrow(deal, "bin long, guest long, doc_id long, text string")
    return dealt.repartition("bin").sortWithinPartitions("bin", "guest", F.desc_nulls_last("doc_id"), "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; null texts are empty."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sent = spark.sparkContext.broadcast(lexicon(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = sent.value, None
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in slices(batches_with_text_second(batches)):
            out = []
            for where, guest, doc_id, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                if guest and (held is None or held[0] != where):
                    continue  # a further row of the guest's id
                own = fingerprint(text.encode(), words)
                if held is not None and held[0] == where:
                    _, before, last, prints = held
                    changed = edited(last, text)
                    other = fingerprint(changed.encode(), words)
                    digest = hashlib.sha256(changed.encode()).hexdigest()
                    out.append((before, len(last), digest, written(prints), written(other), likeness(prints, other), likeness(prints, own)))
                held = None if guest else (where, doc_id, text, own)
            cols = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def batches_with_text_second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.select(["doc_id", "text", "bin", "guest"]) for b in batches)

    return with_next(docs).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
