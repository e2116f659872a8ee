"""Fuzzy search for short licence notices: pigeonhole seeds, then bounded-error matching."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.common import keyed_text, table, utf8
from kbspark.llm.bpe import slices

#: Exact phrases and their labels, as the contract of the query fixes them.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Short notices searched with errors, and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("http www apache org licenses license 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("spdx license identifier apache 2 0", "apache-2.0"),
    ("spdx license identifier mit", "mit"),
    ("all rights reserved", "reserved"),
)
#: One error is allowed for so many letters of a notice.
LETTERS_PER_ERROR = 12

SPACE = regex.compile(" ")

#: A-Z become a-z; ASCII letters, digits and all bytes from 0x80 stay; the rest parts words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def errors_for(notice: str, per: int = LETTERS_PER_ERROR) -> int:
    return max(1, len(notice) // per)


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` disjoint pieces with their offsets: within the errors, one piece stays whole."""
    n, k = len(notice), errors + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """All notices with one automaton over their seeds."""

    def __init__(self, notices: tuple = NOTICES, base: tuple = BASE, per: int = LETTERS_PER_ERROR):
        self.base = [(f" {phrase} ".encode(), label) for phrase, label in base]
        self.notices = []
        by_seed: dict[str, list[tuple[int, int]]] = {}
        for n, (notice, label) in enumerate(notices):
            errors = errors_for(notice, per)
            pattern = regex.compile(rf"(?:{regex.escape(notice, literal_spaces=True)}){{e<={errors}}}", regex.ENHANCEMATCH)
            self.notices.append((notice, label, errors, pattern))
            for offset, piece in seeds(notice, errors):
                by_seed.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in by_seed.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def base_places(self, line: bytes) -> list[tuple[int, str]]:
        """Offsets and labels of the exact phrases; ``line``: words with a space around each."""
        found = []
        for phrase, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = line.find(phrase, at + 1)
        return found

    def fuzzy(self, line: str) -> list[tuple[str, int, int, int, int]]:
        """``(label, start, end, errors, notice)`` of notices in normalised text, code points.

        A seed at some place puts the notice's start within the allowed errors of one offset; all
        such starts of one notice that run into each other are verified as one stretch, from left
        to right, each match improved where it stands.
        """
        starts: dict[int, list[int]] = {}
        for end, (size, uses) in self.automaton.iter(line):
            for n, offset in uses:
                starts.setdefault(n, []).append(end + 1 - size - offset)
        found = []
        for n, places in starts.items():
            notice, label, errors, pattern = self.notices[n]
            span = len(notice) + 2 * errors
            stretches: list[list[int]] = []
            for p in sorted(places):
                if stretches and p - errors <= stretches[-1][1]:
                    stretches[-1][1] = p + span
                else:
                    stretches.append([p - errors, p + span])
            for a, b in stretches:
                a, b = max(0, a), min(len(line), b)
                while b - a >= len(notice) - errors and (m := pattern.search(line, a, b)):
                    found.append((label, m.start(), m.end(), sum(m.fuzzy_counts), n))
                    a = max(m.end(), a + 1)
        return found


@lru_cache(maxsize=2)
def scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row; no shuffle.

    ``spans`` lists what the fuzzy search reports: label, first and last word (from 0, of the words
    of the whole text), errors. ``score`` is 1 for an exact base phrase, else one less the least
    share of erroneous letters of any notice found, and 0 where nothing is found. Null and empty
    texts have no words and score 0; repeated rows and null ids pass through one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for b in slices(batches):
            out: list[tuple] = []
            for text in utf8(b.column(1)):
                words = text.translate(WORD_BYTES).split()
                line = b" " + b" ".join(words) + b" "
                places = s.base_places(line)
                if places:  # the space before word k is the k-th of the line
                    number = np.searchsorted(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), [at for at, _ in places])
                    places = [(int(k), label) for k, (_, label) in zip(number, places, strict=True)]
                spoken = line.decode()
                fuzzy = s.fuzzy(spoken)
                spans = []
                spaces = np.array([m.start() for m in SPACE.finditer(spoken)]) if fuzzy else None
                for label, start, end, errors, _ in sorted(fuzzy, key=lambda x: (x[1], x[2], x[0])):
                    first = int(np.searchsorted(spaces, start + 1)) - 1
                    last = max(first, int(np.searchsorted(spaces, max(start + 1, end - 1))) - 1)
                    spans.append({"label": label, "first": first, "last": last, "errors": errors})
                exact = {label for _, label in places}
                closeness = [1 - f[3] / len(s.notices[f[4]][0]) for f in fuzzy] + [1.0] * bool(places)
                out.append(
                    (
                        len(words),
                        len(places),
                        min((p for p, _ in places), default=None),
                        max((p for p, _ in places), default=None),
                        ",".join(sorted(exact)),
                        ",".join(sorted(exact | {f[0] for f in fuzzy})),
                        max(closeness, default=0.0),
                        spans,
                    )
                )
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            kinds.append(pa.list_(pa.struct([("label", pa.string()), *[(k, pa.int64()) for k in ("first", "last", "errors")]])))
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    few = keyed_text(docs, id_col, text_col)
    kind = few.schema["doc_id"].dataType.simpleString()
    return few.mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label: string, first: long, last: long, errors: long>>",
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places, labels of exact and fuzzy finds, and the closest find's score for each document; ``spans`` has
    what the fuzzy search reports as ``label:first word:last word:errors``, comma-joined."""
    found = scan(table(spark, sf_dir, "documents"))
    one = lambda s: F.concat_ws(":", s["label"], s["first"], s["last"], s["errors"])
    return found.withColumn("spans", F.array_join(F.transform("spans", one), ","))
