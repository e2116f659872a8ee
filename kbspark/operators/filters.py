"""Structured filters and Boolean text queries compiled to one column, so that Catalyst can push them down."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = {"gte": "__ge__", "gt": "__gt__", "lte": "__le__", "lt": "__lt__"}


def compile_filters(filters: dict[str, Any] | None) -> Column:
    """``{f: v}`` equals, ``{f: {gte, gt, lte, lt}}`` ranges, ``{f: {in: [...]}}`` membership; all hold.

    Range keys win over ``in``; null values are left out; no filter is true.
    """
    parts: list[Column] = []
    for name, value in (filters or {}).items():
        column = F.col(name)
        if isinstance(value, dict):
            ranges = [getattr(column, RANGE[k])(v) for k, v in value.items() if k in RANGE and v is not None]
            if ranges:
                parts += ranges
            elif value.get("in"):
                parts.append(column.isin(*value["in"]))
        elif value is not None:
            parts.append(column == value)
    return reduce(Column.__and__, parts, F.lit(True))


def scope(column: str, ids: int | str | list | None) -> Column:
    """One id equals, several are a membership test, none is no filter."""
    if ids is None or ids == []:
        return F.lit(True)
    return F.col(column).isin(*ids) if isinstance(ids, list) else F.col(column) == ids


def live(rows: DataFrame, flag: str = "is_deleted") -> DataFrame:
    return rows.where(~F.coalesce(F.col(flag), F.lit(False)))


def boolean_query(text: str, words: Column) -> Column:
    """``NOT`` binds tightest, then ``AND``, then ``OR``; parentheses group; bare terms side by side are ANDed."""
    parts = re.findall(r"\(|\)|[^\s()]+", text)
    at = 0

    def either() -> Column:
        nonlocal at
        found = every()
        while at < len(parts) and parts[at].upper() == "OR":
            at += 1
            found = found | every()
        return found

    def every() -> Column:
        nonlocal at
        found = one()
        while at < len(parts) and parts[at] != ")" and parts[at].upper() != "OR":
            if parts[at].upper() == "AND":
                at += 1
            found = found & one()
        return found

    def one() -> Column:
        nonlocal at
        if at >= len(parts):
            raise ValueError(f"unfinished query: {text}")
        part, at = parts[at], at + 1
        if part.upper() == "NOT":
            return ~one()
        if part == "(":
            found = either()
            if at >= len(parts) or parts[at] != ")":
                raise ValueError(f"unbalanced query: {text}")
            at += 1
            return found
        return F.array_contains(words, part.lower())

    found = either()
    if at < len(parts):
        raise ValueError(f"unbalanced query: {text}")
    return found


def compatible_query(text: str, words: Column) -> Column:
    """The way the service itself reads a Boolean query: split at ``NOT`` first, then the rest at ``OR``,
    else at ``AND``, upper case only. Parentheses mean nothing, and an ``AND`` group inside an ``OR`` list
    must hold as a whole. Queries without an operator match any of their terms."""
    has = lambda part: reduce(Column.__or__, [F.array_contains(words, w.lower()) for w in part.split()], F.lit(False))
    wanted, *unwanted = re.split(r"\s*\bNOT\b\s*", text)
    must: list[Column] = []
    should: list[Column] = []
    if " OR " in wanted:
        for part in wanted.split(" OR "):
            terms = part.split(" AND ")
            (must if len(terms) > 1 else should).extend(has(t) for t in terms)
    elif wanted.strip():
        must = [has(t) for t in wanted.split(" AND ")]
    if should and not must:
        must = [reduce(Column.__or__, should)]
    return reduce(Column.__and__, [*must, *[~has(u) for u in unwanted if u.strip()]], F.lit(True))


def any_term(words: Column, pattern: str) -> Column:
    """Whether some term matches a wildcard pattern with ``*`` and ``?`` as a whole."""
    expression = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower()) + "$"
    return F.exists(words, lambda w: w.rlike(expression))
