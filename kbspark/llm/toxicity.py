"""Toxicity by compression distance between a toxic and an ordinary zstandard dictionary."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kbspark.llm.bpe import slices
from kbspark.llm.common import keyed_text, table, utf8
from kbspark.llm.licenses import WORD_BYTES

#: Bounds of the labelled sample that is learnt from: documents of each class, and their length.
TOXIC_DOCS, ORDINARY_DOCS, SAMPLE_CHARS = 3_000, 3_000, 20_000
#: Words of a window, bytes of the dictionaries, and the score from which a document counts as toxic.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, THRESHOLD = 24, 65_536, 1024, 0.7
#: Segment and matching lengths of the library's trainer for the toxic dictionary. Its samples are
#: short words; segments of several words keep most of them whole.
SEGMENT, MATCH = 64, 6
#: What ends the tables of a trained dictionary (RFC 8878): three offsets; its content follows.
OFFSETS = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))
STEMS = range(3, 8)
MARK = b"\x01"
#: By how much a false alarm among ordinary texts weighs more than a miss among toxic ones.
FALSE_COST = 2.0
#: Share of the toxic documents in which a telling stem must occur to be a sample of their dictionary.
COMMON = 0.05


def normal(text: bytes) -> bytes:
    """Lower-cased words of letters and digits, a space between."""
    return b" ".join(text.lower().translate(WORD_BYTES).split())


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    words = text.split()
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


@lru_cache(maxsize=8)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Frames without header fields, so that sizes differ by content only."""
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=17, chain_log=18, search_log=4, target_length=16, min_match=3,
        strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


def lengths(content: bytes, parts: list[bytes]) -> np.ndarray:
    """Compressed length of each part with a dictionary."""
    if not parts or not content:
        return np.zeros(len(parts), np.int64)
    size = np.array([len(p) for p in parts], "<u8")
    places = np.stack([np.cumsum(size) - size, size], axis=1).astype("<u8")
    out = compressor(content).multi_compress_to_buffer(zstandard.BufferWithSegments(b"".join(parts), places.tobytes()), threads=1)
    return np.array([len(out[i]) for i in range(len(out))], np.int64)


class Model:
    """Two trained dictionaries and a calibrated rule on the gains of the toxic one over a text's windows.

    Toxic documents are mostly ordinary language. A toxic dictionary of its own would shorten ordinary
    words badly, and that noise would hide the few toxic ones; so windows are compressed with the
    ordinary dictionary, and with the same one followed by the content of the toxic dictionary.
    """

    def __init__(self, ordinary: bytes, toxic: bytes, telling: Sequence[bytes] = ()):
        self.ordinary, self.toxic, self.telling = ordinary, toxic, list(telling)
        self.marker = marker(set(telling)) if telling else None
        self.weights: np.ndarray | None = None

    def gains(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text, by how many bytes the toxic dictionary shortens each window more."""
        cut = [windows(marked(normal(t), self.marker)) for t in texts]
        flat = [w for c in cut for w in c]
        gain = lengths(self.ordinary, flat) - lengths(self.ordinary + self.toxic, flat)
        return np.split(gain, np.cumsum([len(c) for c in cut])[:-1]) if cut else []

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 8))
        for i, g in enumerate(self.gains(texts)):
            out[i, 0] = 1
            if len(g):
                top, up = np.sort(g)[::-1].clip(0), g.clip(0)
                out[i, 1:] = (
                    np.log1p(top[0]), np.log1p(top[:4].sum()), np.log1p((g >= 3).sum()), (g >= 3).mean(),
                    up.mean(), g.mean(), np.log1p(len(g)) / 4,
                )
        return out

    def fit(self, texts: list[bytes], labels: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge, both classes of equal weight, then
        shifted so that the threshold separates the given texts best."""
        x, w = self.features(texts), np.zeros(8)
        weight = np.where(labels > 0, (labels == 0).sum() / max((labels > 0).sum(), 1), 1.0)
        for _ in range(30):
            p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
            ridge = 1e-2 * np.eye(8)
            w += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (labels - p)) - ridge @ w)
        w[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(x @ w, labels)
        self.weights = w

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-(self.features(texts) @ self.weights).clip(-30, 30)))


def best_cut(value: np.ndarray, labels: np.ndarray) -> float:
    """The value from which on toxic texts are told from others best: the rate of toxic ones above
    it less ``FALSE_COST`` times the rate of others above it is greatest. Mislabelled texts lower
    both alike. Of cuts nearly as good (by one text of the rarer class) the middle one."""
    order = np.argsort(-value, kind="stable")
    hit, n = labels[order] > 0, [max(int((labels > 0).sum()), 1), max(int((labels == 0).sum()), 1)]
    gap = np.cumsum(hit) / n[0] - FALSE_COST * np.cumsum(~hit) / n[1]
    good = np.flatnonzero(gap >= gap.max() - 1 / min(n))
    at = int(good[len(good) // 2])
    after = value[order[min(at + 1, len(order) - 1)]]
    return float((value[order[at]] + after) / 2)


def unlike(texts: list[bytes], share: float = 0.3) -> list[bytes]:
    """Texts of which at most ``share`` of the word triples occurred before: copies tell nothing new."""
    seen: set[int] = set()
    kept = []
    for text in texts:
        words = text.split()
        triples = {hash(t) for t in zip(words, words[1:], words[2:], strict=False)}
        if len(triples & seen) <= share * len(triples):
            kept.append(text)
        seen |= triples
    return kept


def telling_stems(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Words (with an end mark) and stems that occur in enough toxic documents, and in far more of them than
    ordinary ones lead to expect. Longer ones come first, and a shorter one counts only in words that none of
    those tells: the beginning of a telling word says nothing by itself."""
    scale, least = len(toxic) / max(len(ordinary), 1), max(4, len(toxic) * COMMON)
    left, found = [[set(x.split()) for x in c] for c in (toxic, ordinary)], set()
    for n in (None, *reversed(STEMS)):
        part = lambda w, n=n: w + b"$" if n is None else w[:n]
        t, o = (Counter(s for words in c for s in {part(w) for w in words if len(w) >= (n or 1)}) for c in left)
        expected = {s: (o.get(s, 0) + 1) * scale for s, k in t.items() if k >= least}
        tells = {s for s, e in expected.items() if t[s] > 3 * e and t[s] - e >= 5 * e**0.5}
        left = [[{w for w in words if part(w) not in tells} for words in c] for c in left]
        found |= tells
    return found


def marker(telling: set[bytes]) -> re.Pattern[bytes]:
    """Finds telling words and stems at the beginning of a word, the longest first."""
    each = [re.escape(s[:-1]) + b"(?= )" if s.endswith(b"$") else re.escape(s) for s in sorted(telling, key=lambda s: (not s.endswith(b"$"), -len(s), s))]
    return re.compile(b"(?<= )(?:" + b"|".join(each) + b")")


def marked(text: bytes, telling: re.Pattern[bytes] | None) -> bytes:
    """A normal text with its telling words and stems in capitals, after ``MARK``. It has neither elsewhere,
    so that no part of an ordinary word looks like a telling one."""
    return text if telling is None else telling.sub(lambda m: MARK + m[0].upper(), b" " + text + b" ").strip(b" ")


def train(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """Dictionaries from the even documents of each class, calibration on the odd ones.

    Both dictionaries come from the library's trainer: the ordinary one from the windows of ordinary
    documents without telling stems, the toxic one from the toxic part of toxic documents, that is
    their words with telling stems. Inflected forms are each rare, so stems are counted. Without
    samples of both classes the model scores everything 0.
    """
    toxic, ordinary = [[normal(x) for x in c] for c in (toxic, ordinary)]
    learnt = unlike(toxic[::2])
    common = telling_stems(learnt, unlike(ordinary))
    if not common:
        return Model(b"", b"")
    telling = marker(common)
    held = lambda x, tells: [w for w in marked(x, telling).split() if w.startswith(MARK) == tells]
    parts = [w for x in ordinary[::2] for w in windows(b" ".join(held(x, False)), 24)]
    samples = [b" " + b" ".join(w) + b" " for x in learnt if (w := held(x, True))]
    if len(parts) < 50 or not samples:
        return Model(b"", b"")
    try:
        usual = zstandard.train_dictionary(max(1024, min(ORDINARY_BYTES, sum(map(len, parts)) // 8)), parts).as_bytes()
        toxic_held = zstandard.train_dictionary(TOXIC_BYTES, samples, k=SEGMENT, d=MATCH).as_bytes()
    except zstandard.ZstdError:  # fewer samples than the library trains on
        return Model(b"", b"")
    model = Model(usual, b" " + toxic_held[toxic_held.index(OFFSETS) + len(OFFSETS) :] + b" ", sorted(common))
    model.fit(toxic[1::2] + ordinary[1::2], np.repeat([1.0, 0.0], [len(toxic[1::2]), len(ordinary[1::2])]))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows that are not held out, a bounded sample in the order of a hash.

    The sample, at most the documents and characters stated above, goes to one task, which trains
    there; only dictionaries and weights come to the driver.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    samples = []
    for value, most in ((1, TOXIC_DOCS), (0, ORDINARY_DOCS)):
        few = known.where(F.col("toxic") == value).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
        found = docs.join(F.broadcast(few), docs["doc_id"] == few["id"], "left_semi").where(F.length("text").between(1, SAMPLE_CHARS))
        found = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(most)
        samples.append(found.select("text", F.xxhash64("doc_id").alias("place"), F.xxhash64("text").alias("th"), F.lit(value).alias("toxic")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("toxic", "place", "th", "text")], strict=True)))
        model = train(*[[t.encode() for kind, _, _, t in rows if kind == value] for value in (1, 0)])
        weights = [] if model.weights is None else model.weights.tolist()
        kinds = pa.schema([("ordinary", pa.binary()), ("toxic", pa.binary()), ("telling", pa.list_(pa.binary())), ("weights", pa.list_(pa.float64()))])
        yield pa.RecordBatch.from_pydict({"ordinary": [model.ordinary], "toxic": [model.toxic], "telling": [model.telling], "weights": [weights]}, kinds)

    one = samples[0].unionByName(samples[1]).repartition(1)
    found = one.mapInArrow(run, "ordinary binary, toxic binary, telling array<binary>, weights array<double>").first()
    model = Model(bytes(found["ordinary"]), bytes(found["toxic"]), [bytes(s) for s in found["telling"]]) if found else Model(b"", b"")
    model.weights = np.array(found["weights"]) if found and found["weights"] else None
    return model


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", to: str = "toxicity") -> DataFrame:
    """``docs`` with the score of each row in a column ``to``; no shuffle of the texts.

    Null and empty texts are scored like any other, by features of no window. Repeated rows and null
    ids pass through one by one. Rows of ``labels`` with a null id or label are left out. If labels
    of a class are missing altogether, all scores are 0.
    """
    model = learn(keyed_text(docs, id_col, text_col), labels)
    sent, at = (model.ordinary, model.toxic, model.telling, model.weights), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Model(*sent[:3])
        here.weights = sent[3]
        for b in slices(batches, text=at, chars=2_000_000):
            score = pa.array(here.scores(utf8(b.column(at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, score], [*b.schema.names, to])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(to, DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row; a null id is not held out."""
    found = scored(keyed_text(docs, id_col, text_col), labels)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction for every document, and whether it is held out."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
