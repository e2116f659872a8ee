"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into longest vocabulary entries. A sequence of entries is the merge
result exactly if every entry is its own merge result and every adjacent pair is compatible, that
is, no merge would cross the border between the two before both are complete. The adjacent pairs
of a whole batch of new words are tested at once in numpy; only words with a failing pair are
merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from kbspark.llm.common import keyed_text, rows, strings, table

#: Word pieces kept in each Python worker; past this the cache starts anew.
CACHE_WORDS = 400_000
NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """A byte-level word BPE with an end-of-word suffix, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split)
        # The same pattern where only ASCII occurs: \p{L} and \p{N} are then these ranges.
        self.ascii_split = re.compile(split.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.letters = byte_letters()
        self._merge_tables(model["merges"])
        self.words: dict[str, tuple[str, str]] = {}

    def _merge_tables(self, merges: list) -> None:
        """Ranks, spines and the entries that are their own merge result."""
        n = max(self.texts) + 1
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        left, right, born = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        for r, merge in enumerate(merges):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            ia, ib = self.vocab[a], self.vocab[b]
            made = self.vocab[a + b]
            self.rank[ia, ib] = (r, made)
            if born[made] < 0:
                left[made], right[made], born[made] = ia, ib, r
        self.left, self.right, self.born, self.base = left, right, born, n
        keys = np.array([a * n + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.rank.values()], np.int64)[order]
        made = np.flatnonzero(born >= 0)
        own = np.ones(n, bool)
        own[made] = self.compatible(left[made], right[made], born[made])
        for t in made[np.argsort(born[made])]:  # parts are made before the whole
            own[t] &= own[left[t]] and own[right[t]]
        ends = len(self.suffix)
        self.whole = {t[:-ends]: i for t, i in self.vocab.items() if t.endswith(self.suffix) and own[i]}
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(self.suffix) and own[i]}
        self.longest = max(map(len, self.whole))
        self.reach: dict[str, int] = {}  # of the inner entries that begin with two letters, the longest
        for t in self.inner:
            if len(t) > 1:
                self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 0))

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of entries, whether no merge crosses their border.

        Both sides grow by merges of rising rank; the entry at the border of the left side is alive
        until its parent on the right spine is born, that on the right side until its parent on the
        left spine is. A crossing merge happens if its rank comes before both ends: of merges of
        one rank the leftmost is first, so the left side wins a tie and the right side loses it.
        ``before``: ranks at which the pair itself merges, for testing whole entries.
        """
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ok = np.ones(len(a), bool)
        till_a = np.full(len(a), NEVER) if before is None else np.array(before, np.int64)
        till_b = till_a.copy()
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.base + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            crossed = (rank < till_a[live]) & (rank <= till_b[live]) & (rank < NEVER)
            if before is not None:  # the merge that makes the entry is no crossing
                crossed &= rank < before[live]
            ok[live[crossed]] = False
            born_x, born_y = self.born[x], self.born[y]
            back_a = born_x > born_y  # undo the later of the two births; on a tie the right one is later
            on = ~crossed & (np.maximum(born_x, born_y) >= 0)
            ia, ib = live[on & back_a], live[on & ~back_a]
            till_a[ia], till_b[ib] = self.born[a[ia]], self.born[b[ib]]
            a[ia], b[ib] = self.right[a[ia]], self.left[b[ib]]
            live = live[on]
        return ok

    def greedy(self, word: str) -> list[int] | None:
        """The longest-match proposal for a word in byte letters, or None if it gets stuck."""
        if (whole := self.whole.get(word)) is not None:
            return [whole]
        ids, at, n = [], 0, len(word)
        while at < n:
            if n - at <= self.longest and (end := self.whole.get(word[at:])) is not None:
                ids.append(end)
                return ids
            for stop in range(min(n - 1, at + self.reach.get(word[at : at + 2], 1)), at, -1):
                if (found := self.inner.get(word[at:stop])) is not None:
                    ids.append(found)
                    at = stop
                    break
            else:
                return None
        return None

    def merge(self, word: str) -> list[int]:
        """Exact merging of one word in byte letters: lowest rank first, leftmost on ties."""
        ids = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]
        if len(ids) <= 32:
            return self._merge_short(ids)
        n = len(ids)
        after, prior, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(*self.rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heap = [(r, i, p, made) for r, made, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, pair, made = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], alive[j], after[i] = made, False, after[j]
            if after[i] >= 0:
                prior[after[i]] = i
            for s, t in ((prior[i], i), (i, after[i])):
                if s >= 0 and t >= 0 and (p := (ids[s], ids[t])) in self.rank:
                    rank, new = self.rank[p]
                    heapq.heappush(heap, (rank, s, p, new))
        return [t for t, keep in zip(ids, alive, strict=True) if keep]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same without a heap: for few entries, looking at all pairs again is quicker."""
        get = self.rank.get
        while len(ids) > 1:
            found = [get(pair, (NEVER, -1)) for pair in zip(ids, ids[1:], strict=False)]
            rank, made = best = min(found)
            if rank == NEVER:
                break
            at = found.index(best)
            ids[at : at + 2] = [made]
        return ids

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct pre-tokenised words, in the order given."""
        letters = self.letters
        spelled = [w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]) for w in words]
        found = [self.greedy(w) for w in spelled]
        sizes = np.array([0 if f is None else len(f) for f in found])
        flat = np.array([t for f in found if f for t in f], np.int64)
        if len(flat):
            owner = np.repeat(np.arange(len(found)), sizes)
            inside = owner[1:] == owner[:-1]
            bad = ~self.compatible(flat[:-1][inside], flat[1:][inside])
            for w in np.unique(owner[:-1][inside][bad]):
                found[w] = None
        return [self.merge(s) if f is None else f for f, s in zip(found, spelled, strict=True)]

    def pieces(self, text: str) -> list[str]:
        """Words of an ordinary text after normalising and splitting."""
        if text.isascii():  # composing changes nothing and white space is left out by the split
            return self.ascii_split.findall(text.lower())
        return self.split.findall(self.normalizer.normalize_str(text))

    def learn(self, texts: list[list[str]]) -> None:
        """Put all words of the given word lists in the cache."""
        new = {w for words in texts for w in words if w not in self.words}
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = {w for words in texts for w in words}
        fresh = list(new)
        for word, ids in zip(fresh, self.encode_words(fresh), strict=True):
            self.words[word] = (" ".join(map(str, ids)), " ".join([self.texts[t] for t in ids]))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, special tokens in a text included; nothing is added."""
        return [[int(x) for x in ids.split()] for ids, _ in self.encode_text(texts)]

    def decode(self, ids: list[int]) -> str:
        """Entries joined by a space, special tokens included; unknown ids are passed over."""
        return " ".join([self.texts[i] for i in ids if i in self.texts])

    def encode_text(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text the decimal ids and the decoded text."""
        parts: list[list[list[str] | str]] = []  # lists of words, and special tokens between them
        for text in texts:
            if self.specials is not None and "<|" in text:
                parts.append([s if i % 2 else self.pieces(s) for i, s in enumerate(self.specials.split(text))])
            else:
                parts.append([self.pieces(text)])
        self.learn([words for part in parts for words in part if isinstance(words, list)])
        known = self.words
        for part in parts:
            got: list[tuple[str, str]] = []
            for words in part:
                got += [(str(self.special[words]), words)] if isinstance(words, str) else [known[w] for w in words]
            yield " ".join([x[0] for x in got]), " ".join([x[1] for x in got])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about so many characters, so that memory does not follow the batch size."""
    for batch in rows(batches, 256):
        sizes = [len(t or "") for t in batch.column(text).to_pylist()]
        at = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > chars:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        yield batch.slice(at)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: the ids of each text as an array and what they decode to.

    No shuffle. Null and empty texts give no ids and an empty string; repeated rows and null ids
    pass through one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in slices(batches):
            got = list(bpe.encode_text(strings(b.column(1))))
            ids = pa.array([np.array(i.split(), np.int32) for i, _ in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([d for _, d in got], pa.string())], ["doc_id", "ids", "decoded"])

    few = keyed_text(docs, id_col, text_col)
    return few.mapInArrow(run, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: ``encode`` with its columns digested in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in slices(batches):
            out: tuple[list, list, list] = ([], [], [])
            for ids, decoded in bpe.encode_text(strings(b.column(1))):
                out[0].append(ids.count(" ") + 1 if ids else 0)
                out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
            cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    few = keyed_text(docs, id_col, text_col)
    kind = few.schema["doc_id"].dataType.simpleString()
    return few.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of every document, and a digest of what they decode to."""
    return digests(table(spark, sf_dir, "documents"), vocabulary())
