"""Text functions as Spark columns; all but ``counted_terms`` run inside the JVM."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbspark.operators.batches import by_row

#: Fixed word lists and patterns.
STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been being have has had do does did will would "
    "could should may might must can this that these those i you he she it we they me him her us them"
).split()
SHORT_STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should"
).split()
TOKEN = r"[\p{L}\p{N}_]+"
SPECIAL = r"""[^\p{L}\p{N}_\s一-鿿.,!?;:()\[\]{}"'-]"""


def clean(text: Column) -> Column:
    """White space collapsed, characters outside the list dropped, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), SPECIAL, ""))


def bare(text: Column) -> Column:
    """Only word characters and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def language(text: Column) -> Column:
    """zh or en by a share over 0.3 of the word characters, else mixed; unknown without any."""
    count = lambda p: F.length(text) - F.length(F.regexp_replace(text, p, ""))
    words, han, latin = count(r"[\p{L}\p{N}_]"), count("[一-鿿]"), count("[a-zA-Z]")
    return F.when(words == 0, "unknown").when(han / words > 0.3, "zh").when(latin / words > 0.3, "en").otherwise("mixed")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(query: Column, content: Column) -> Column:
    """Share of the query's tokens that the content has."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, content)) / F.size(F.array_distinct(query)))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Fixed windows with overlap, trimmed, blank ones dropped; the last may be overlap alone."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.trim(F.substring(text, i + 1, F.lit(size)))), lambda s: s != "")


def has_phrase(words: Column, phrase: list[str]) -> Column:
    """Whether a token array holds ``phrase`` at some place, slop 0.

    Tokens have no blanks, so the phrase is looked up in the joined tokens; a lambda over places
    would compute the tokens again at each.
    """
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} "))


def mask(text: Column, words: list[str]) -> Column:
    """Each word replaced by as many asterisks."""
    for w in words:
        text = F.replace(text, F.lit(w), F.lit("*" * len(w)))
    return text


def section_hint(line: Column) -> Column:
    """heading, divider or paragraph for one line of plain text."""
    t = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    return (
        F.when(t == "", "paragraph")
        .when(t.startswith("#"), "heading")
        .when(t.rlike(r"^[=-]{3,}$"), "divider")
        .when(t.rlike(r"^[0-9]+(\.[0-9]+)*\s"), "heading")
        .when((F.length(t) <= 80) & (t == F.upper(t)) & (t != F.lower(t)), "heading")
        .when((F.length(t) <= 60) & t.endswith(":"), "heading")
        .otherwise("paragraph")
    )


def counted_terms(text: Column, n: int | None = None, least: int = 1, token: str = r"\w+", word: str | None = None, longer: int = 0, drop: Iterable[str] = ()) -> Column:
    """``array<struct<term, n>>`` of the matches of ``token`` in a text and how often each occurs: those that match
    ``word`` as a whole, have more than ``longer`` characters, are not in ``drop`` and occur ``least`` times. With ``n``
    the most frequent, earlier ones first where equal. Python's ``\\w`` is ``TOKEN``.

    A hash table for each document, in Python: sorting the words in Spark's array functions costs far more.
    """
    find, whole, out = re.compile(token), word and re.compile(word), frozenset(drop)

    def rule(value: str | None) -> list[tuple[str, int]]:
        found = [(w, k) for w, k in Counter(find.findall(value or "")).items() if k >= least and len(w) > longer and w not in out and (not whole or whole.fullmatch(w))]
        return found if n is None else sorted(found, key=lambda x: -x[1])[:n]

    return by_row(rule, "array<struct<term string, n long>>")(text)


def format_bytes(n: Column) -> Column:
    """Whole bytes in base 1024 with one decimal, B to PB; exact ties go to the even digit."""

    def tenths(unit: int, name: str) -> Column:
        q, r = F.floor(n * 10 / unit), n * 10 % unit
        up = F.when((r * 2 > unit) | ((r * 2 == unit) & (q % 2 == 1)), 1).otherwise(0)
        return F.concat(F.floor((q + up) / 10).cast("string"), F.lit("."), ((q + up) % 10).cast("string"), F.lit(f" {name}"))

    out = tenths(1024**5, "PB")
    for i, name in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(n < 1024 ** (i + 1), tenths(1024**i, name)).otherwise(out)
    return out


def format_number(n: Column, units: str = "KMB") -> Column:
    """With one decimal in the largest of ``units`` that it reaches, each a thousand of the one before; whole below."""
    out = None
    for power, unit in reversed(list(enumerate(units, 1))):
        size = float(1000**power)
        text = F.format_string(f"%.1f{unit}", n / size)
        out = F.when(n >= size, text) if out is None else out.when(n >= size, text)
    return out.otherwise(n.cast("long").cast("string"))
