"""Sequential text algorithms: sequence similarity, line diffs and the sentence-aware splitter."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kbspark.operators.batches import by_row


def similarity(a: str, b: str) -> Column:
    """Longest-matching-block ratio of two text columns; null counts as empty."""
    return F.pandas_udf(_similarity, "double")(a, b)


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def diff_counts(a: str, b: str) -> Column:
    """Added and removed lines, hunks, and changed lines over the longer text's lines."""
    return F.pandas_udf(_diff_counts, "added long, removed long, hunks long, ratio double")(a, b)


def _diff_counts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    out = []
    for x, y in zip(a, b, strict=True):
        old, new = (x or "").splitlines(), (y or "").splitlines()
        lines = list(difflib.unified_diff(old, new, lineterm=""))[2:]
        added, removed = (sum(ln.startswith(s) for ln in lines) for s in "+-")
        out.append((added, removed, sum(ln.startswith("@@") for ln in lines), (added + removed) / max(len(old), len(new), 1)))
    return pd.DataFrame(out, columns=["added", "removed", "hunks", "ratio"])


def split_sentences(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most ``size`` characters without blanks around them, ended after the last full stop
    where there is one. Blanks before a piece are skipped first, so they take no room; it always
    advances."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    out, start = [], 0
    while (start := start + len(text[start:]) - len(text[start:].lstrip())) < len(text):
        end = min(start + size, len(text))
        if end < len(text) and (stop := text.rfind(".", start, end)) > start:
            end = stop + 1
        out.append(text[start:end].strip())
        start = len(text) if end == len(text) else max(end - overlap, start + 1)
    return out


DIFF = "array<struct<type: string, old_line: int, new_line: int, content: string>>"


def line_diff(a: str, b: str) -> Column:
    """The lines of two text columns as kept, deleted and inserted, with their numbers in either."""

    def run(x: str | None, y: str | None) -> list[tuple]:
        old, new = (x or "").splitlines(), (y or "").splitlines()
        out: list[tuple] = []
        for tag, i, j, k, m in difflib.SequenceMatcher(None, (x or "").splitlines(True), (y or "").splitlines(True)).get_opcodes():
            if tag == "equal":
                out += [("equal", i + n + 1, k + n + 1, old[i + n]) for n in range(j - i)]
            else:
                out += [("delete", n + 1, None, old[n]) for n in range(i, j)] + [("insert", None, n + 1, new[n]) for n in range(k, m)]
        return out

    return by_row(run, DIFF)(a, b)


def sentence_chunks(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    return by_row(lambda t: split_sentences(t or "", size, overlap), "array<string>")(text)
