"""Scalar helpers: answers of models, JSON, maps, hashes, files, dates."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed words and patterns of the clean-up of problem summaries.
RELEVANT = ("问题", "异常", "错误", "失败", "Pod", "CPU", "内存", "重启")
LEADS = ("好的", "首先", "现在需要", "让我", "我需要")
LEAD_INS = (
    r"(?is)^好的[，,].*?生成.*?问题总结", r"(?is)^首先[，,].*?阅读.*?数据", r"(?is)^我现在需要.*?生成.*?问题总结",
    r"(?is)^根据用户提供的信息.*?生成.*?问题总结", r"(?is)^让我.*?分析.*?数据", r"(?is)^我需要.*?分析.*?信息",
)
EXTENSIONS = ("txt", "md", "html", "csv", "xlsx", "xls", "docx", "pdf", "pptx", "json", "xml")
HASHES: dict[str, Callable[[Column], Column]] = {
    "md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512),
}


def problem_summary(text: Column) -> Column:
    """Thinking blocks, lead-ins and marks dropped; if under ten characters are left, up to three
    relevant lines of the whole text instead."""
    t = F.regexp_replace(F.trim(text), r"(?is)<think>.*?</think>", "")
    t = F.regexp_replace(t, "</?think>", "")
    for lead in LEAD_INS:
        t = F.regexp_replace(F.trim(t), lead, "")
    t = F.trim(F.replace(F.replace(t, F.lit("**"), F.lit("")), F.lit("##"), F.lit("")))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "\r\n", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    holds = lambda s, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(s, w))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: holds(s, RELEVANT) & ~holds(F.substring(s, 1, 20), LEADS))
    short = F.when(F.size(lines) > 0, F.array_join(F.slice(lines, 1, 3), " ")).otherwise(t)
    return F.coalesce(F.when(F.length(t) < 10, short).otherwise(t), F.lit(""))


def repair_json(text: str | None) -> str | None:
    """The JSON object in a text: of a fenced block, else from the first brace to its partner; single
    quotes, bare names and trailing commas are mended. Null where none can be read."""
    text = text or ""
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.DOTALL)
    found = fenced[1] if fenced else _balanced(text)
    for attempt in (found, _mended(found)) if found else ():
        try:
            return json.dumps(json.loads(attempt), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


def _balanced(text: str) -> str | None:
    start, depth, quote, at = text.find("{"), 0, "", 0
    if start < 0:
        return None
    for at in range(start, len(text)):
        c = text[at]
        if quote:
            quote = "" if c == quote and text[at - 1] != "\\" else quote
        elif c == '"':
            quote = c
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start : at + 1]
    return text[start:] + "}" * depth if depth and not quote else None


def _mended(text: str) -> str:
    text = re.sub(r",\s*([}\]])", r"\1", text)
    text = re.sub(r"'([^'\"]*)'", r'"\1"', text)
    return re.sub(r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", r'\1"\2":', text)


def json_object(text: Column) -> Column:
    return F.udf(repair_json, "string", useArrow=True)(text)


def labelled_answer(text: Column) -> Column:
    """``struct<keywords, summary>`` of a model's answer: of its JSON, else of its labelled lines; null
    where it has neither. Keywords are the first five."""
    body = F.when(F.trim(text).startswith("{"), text).otherwise(F.nullif(F.regexp_extract(text, r"(?s)(\{[^{}]*\})", 1), F.lit("")))
    parsed = F.from_json(body, "struct<keywords: array<string>, summary: string>")
    listed, told = (F.regexp_extract(text, rf"{name}[：:]\s*([^\n]+)", 1) for name in ("关键词", "摘要"))
    words = F.slice(F.filter(F.transform(F.split(listed, "、"), lambda k: F.trim(k)), lambda k: k != ""), 1, 5)
    lines = F.when((listed != "") | (told != ""), F.struct(words.alias("keywords"), F.trim(told).alias("summary")))
    return F.when(body.isNotNull(), F.when(F.try_parse_json(body).isNotNull(), parsed)).otherwise(lines)


def list_to_string(values: Column, between: str = ",") -> Column:
    return F.array_join(values, between)


def string_to_list(text: Column, between: str = ",") -> Column:
    """Empty text gives an empty list."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, f"\\Q{between}\\E"))


def safe_get(values: Column, key: str, default: object = None) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(key)), F.lit(default))


def safe_set(values: Column, key: str, value: object) -> Column:
    """The map with the key's value replaced or added."""
    rest = F.map_filter(F.coalesce(values, F.create_map().cast("map<string, string>")), lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), F.lit(value)))


def hashed(value: Column, name: str = "md5") -> Column:
    if name not in HASHES:
        raise ValueError(f"unknown hash {name}")
    return HASHES[name](value)


def verify_hash(value: Column, wanted: Column, name: str = "md5") -> Column:
    return F.coalesce(hashed(value, name) == F.lower(wanted), F.lit(False))


def extension(name: Column) -> Column:
    """The lower-cased ending of a file name without its point, empty where there is none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))


def allowed_type(name: Column) -> Column:
    return extension(name).isin(*EXTENSIONS)


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def missing_fields(fields: dict[str, Column]) -> Column:
    """The names of the fields that are null or empty."""
    each = [F.when(c.isNull() | (c.cast("string") == ""), F.lit(n)) for n, c in fields.items()]
    return F.filter(F.array(*each), lambda n: n.isNotNull())


def number_text(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", value)


def add_minutes(ts: Column, n: int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))
