"""Functions on tables held as arrays of rows, each an array of cells; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed limits of the detection rules.
CHECKED_ROWS, SAMPLED_ROWS, WIDE, KEPT = 5, 100, 20, 10
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"


def split_rows(text: Column, between: str = "|") -> Column:
    """The lines of a text that have the separator, as rows of trimmed cells; outer separators are
    borders, and a Markdown rule under the header is no row."""
    bar = f"[{between}]"
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(between)) & ~x.rlike(rf"^\s*{bar}?[\s:{between}-]*-[\s:{between}-]*$"))
    inner = lambda x: F.regexp_replace(F.trim(x), rf"^{bar}|{bar}$", "")
    return F.transform(lines, lambda x: F.transform(F.split(inner(x), bar), lambda c: F.trim(c)))


def width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def padded(rows: Column) -> Column:
    """All rows filled up with empty cells to the widest one."""
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width(rows) - F.size(r))))


def markdown(rows: Column) -> Column:
    """A Markdown table: the first row as header, a rule, the padded body. Empty without rows."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    lines = F.transform(padded(rows), line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width(rows)), " | "), F.lit(" |"))
    whole = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    return F.when(F.size(rows) > 0, F.array_join(whole, "\n")).otherwise("")


def filled(cell: Column) -> Column:
    return F.coalesce(F.trim(cell) != "", F.lit(False))


def numeric(cell: Column) -> Column:
    """Digits, apart from points and signs."""
    return F.coalesce(F.regexp_replace(cell, "[.-]", "").rlike("^[0-9]+$"), F.lit(False))


def header_row(rows: Column) -> Column:
    """The place, from 0, of the likeliest header among the first rows, or null.

    A row scores 0.6 times its share of filled cells plus 0.4 times its share of cells with text that
    is not a number; the first best row wins if it scores over 0.5.
    """

    def score(r: Column) -> Column:
        texts = F.size(F.filter(r, lambda c: F.coalesce(c != "", F.lit(False)) & ~numeric(F.trim(c))))
        full = F.size(F.filter(r, filled))
        return F.when(full > 0, full / F.size(r) * 0.6 + texts / F.size(r) * 0.4)

    scores = F.transform(F.slice(rows, 1, CHECKED_ROWS), score)
    best = F.array_max(scores)
    return F.when(best > 0.5, F.array_position(scores, best) - 1)


def _columns(rows: Column, test, share: float) -> Column:
    """Columns where more than ``share`` of all rows pass among the sampled first ones."""
    some = F.slice(rows, 1, SAMPLED_ROWS)
    count = lambda j: F.size(F.filter(some, lambda r: test(F.get(r, j))))
    every = F.when(width(rows) > 0, F.sequence(F.lit(0), width(rows) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda j: count(j) > F.size(rows) * F.lit(share))


def numeric_columns(rows: Column) -> Column:
    """Places of the columns with numbers in over half of all rows, counted in the first hundred."""
    return _columns(rows, numeric, 0.5)


def datetime_columns(rows: Column) -> Column:
    """Places of the columns with ISO dates in over 0.3 of all rows, counted in the first hundred."""
    valid = lambda c: F.coalesce(c.rlike(ISO_TIME) & F.substring(c, 1, 10).try_cast("date").isNotNull(), F.lit(False))
    return _columns(rows, valid, 0.3)


def kept_columns(rows: Column) -> Column:
    """Of a wide table the ten fullest columns, earlier ones first where equal, then the numeric
    ones; of others all, in order."""
    every = F.when(width(rows) > 0, F.sequence(F.lit(0), width(rows) - 1)).otherwise(F.array().cast("array<int>"))
    full = lambda j: F.size(F.filter(rows, lambda r: F.coalesce(F.get(r, j) != "", F.lit(False))))
    ranked = F.array_sort(F.transform(every, lambda j: F.struct((-full(j)).alias("n"), j.alias("j"))))
    best = F.transform(F.slice(ranked, 1, KEPT), lambda s: s["j"])
    return F.when(width(rows) > WIDE, F.array_union(best, numeric_columns(rows))).otherwise(every)


def is_real(rows: Column) -> Column:
    """Whether cells found on a page make a table rather than a paragraph: an ordered list of rules on
    rows, columns and lengths of cells."""
    cells = F.filter(F.transform(F.flatten(rows), lambda c: F.length(F.trim(c))), lambda n: n > 0)
    count = F.size(cells)
    mean = F.aggregate(cells, F.lit(0.0), lambda s, n: s + n) / F.when(count > 0, count)
    short = F.size(F.filter(cells, lambda n: n < 20))
    full_rows = F.size(F.filter(rows, lambda r: F.exists(r, filled)))
    enough = (F.size(rows) > 1) & (width(rows) >= 2) & (full_rows >= 2) & (count >= 4) & (mean <= 100)
    few_words = ((F.size(rows) >= 3) & (mean < 50)) | (mean < 30) | (short / count >= 0.6)
    return F.coalesce(enough & few_words, F.lit(False))


def layout(merged: Column, images: Column, charts: Column, widest: Column, n_rows: Column, n_headers: Column) -> Column:
    """layout for a sheet made for the eye, else tabular."""
    signs = [merged, images > 0, charts > 0, widest > 50, (n_rows < 10) & (n_headers > 5)]
    any_sign = signs[0]
    for s in signs[1:]:
        any_sign = any_sign | s
    return F.when(F.coalesce(any_sign, F.lit(False)), "layout").otherwise("tabular")
