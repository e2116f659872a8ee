"""Paragraphs, elements and chunks of documents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.operators.batches import by_row

#: Fixed kinds of elements.
SKIPPED, OPENERS = ("Header", "Footer", "PageBreak", "Table"), ("Title", "ListItem")
CHUNK_MAX, CHUNK_MIN, SHORT = 1000, 500, 60
TOC_LEADER = r"[.·…]{2,}\s*[0-9]+"


def paragraphs(text: Column) -> Column:
    """Runs of lines between blank ones as ``array<struct<line_start, line_end, content>>``, lines from 1."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"\s+$", "")))
    full = lambda i: F.trim(F.get(lines, i - 1)) != ""
    places = F.sequence(F.lit(1), F.size(lines))
    starts = F.filter(places, lambda i: full(i) & ((i == 1) | ~F.coalesce(full(i - 1), F.lit(False))))
    ends = F.filter(places, lambda i: full(i) & ((i == F.size(lines)) | ~F.coalesce(full(i + 1), F.lit(False))))
    one = lambda s, e: F.struct(s.alias("line_start"), e.alias("line_end"), F.trim(F.array_join(F.slice(lines, s, e - s + 1), "\n")).alias("content"))
    return F.zip_with(starts, ends, one)


def is_toc(text: Column) -> Column:
    """Whether a text is a table of contents: by its first line's beginning, or by dotted leaders on
    the first line or on two."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    leaders = F.size(F.filter(lines, lambda x: x.rlike(TOC_LEADER)))
    begins = F.lower(F.replace(first, F.lit(" "), F.lit(""))).rlike("^(目录|tableofcontents)")
    return F.coalesce(begins | (leaders >= 2) | first.rlike(TOC_LEADER), F.lit(False))


def is_toc_line(line: Column) -> Column:
    """The same for one line, where the leader must end it; a blank line counts, an empty text not."""
    t = F.lower(F.trim(line))
    return F.coalesce((line != "") & ((t == "") | t.rlike("^(目录|table of contents)") | t.rlike(TOC_LEADER + "$")), F.lit(False))


def category(style: Column, text: Column) -> Column:
    """Title for heading styles and for texts that say so, else NarrativeText."""
    named = F.lower(F.coalesce(style, F.lit("")))
    return F.when(named.startswith("heading") | named.contains("title") | named.contains("标题"), "Title").otherwise("NarrativeText")


class Chunk(NamedTuple):
    content: str
    first: int | None
    last: int | None
    section: int
    is_parent: bool


CHUNK = "struct<content: string, first: int, last: int, section: int, is_parent: boolean>"


def pack(elements: list, most: int = CHUNK_MAX, least: int = CHUNK_MIN) -> list[Chunk]:
    """Chunks of ``(category, text, place)`` elements by structure.

    A title or list item closes the open chunk, begins a section and is a parent chunk of its own,
    unless the open chunk is short and has room for it. Other texts are packed; a gap in the places
    closes the open chunk, unless that is short and has room. Texts over ``most`` are cut to fill
    the room that is left. Lengths count the line breaks between packed texts, so no chunk is
    longer than ``most`` and no character is lost.
    """
    out: list[Chunk] = []
    parts: list[str] = []
    first = last = None
    section = size = 0

    def flush() -> None:
        nonlocal parts, size
        if parts:
            out.append(Chunk("\n".join(parts), first, last, section, False))
        parts, size = [], 0

    def put(text: str, place: int | None) -> None:
        nonlocal first, last, size
        first = first if parts else place
        size += len(text) + bool(parts)
        parts.append(text)
        last = place

    for kind, raw, place in elements:
        text = (raw or "").strip()
        if kind in SKIPPED or not text:
            continue
        room = most - size - bool(parts)
        tops_up = bool(parts) and size < least and len(text) <= room
        if kind in OPENERS:
            if tops_up:
                section += 1
                put(text, place)
            else:
                flush()
                section += 1
                out.append(Chunk(text, place, place, section, True))
            continue
        if parts and place is not None and last is not None and place != last + 1 and not tops_up:
            flush()
        if len(text) <= most:
            if parts and len(text) > most - size - 1:
                flush()
            put(text, place)
            continue
        at = 0
        while at < len(text):
            if most - size - bool(parts) <= 0:
                flush()
            take = min(most - size - bool(parts), len(text) - at)
            put(text[at : at + take], place)
            at += take
    flush()
    return out


def merge_small(chunks: list[Chunk], most: int = CHUNK_MAX, least: int = CHUNK_MIN) -> list[Chunk]:
    """Short chunks take in those behind them of the same section, parents apart, up to ``most``."""
    out: list[Chunk] = []
    for c in chunks:
        held = out[-1] if out else None
        joins = held and not held.is_parent and not c.is_parent and held.section == c.section
        # Only a chunk that was short when its turn came goes on taking in others.
        if joins and open_ and len(held.content) + 1 + len(c.content) <= most:
            out[-1] = held._replace(content=f"{held.content}\n{c.content}", last=c.last)
        else:
            out.append(c)
            open_ = len(c.content) < least and not c.is_parent
    return out


def structure_chunks(elements: Column, most: int = CHUNK_MAX, least: int = CHUNK_MIN, merge: bool = True) -> Column:
    """``array<struct<content, first, last, section, is_parent>>`` of an array of
    ``struct<category, text, place>``; packing is sequential, so it runs in Arrow batches."""

    def run(found: list | None) -> list:
        chunks = pack(found or [], most, least)
        return merge_small(chunks, most, least) if merge else chunks

    return by_row(run, f"array<{CHUNK}>")(elements)


def stream_chunks(elements: DataFrame, most: int = CHUNK_MAX, id_col: str = "doc_id") -> DataFrame:
    """``(id, pos, chunk_index, content, element_start)`` of ordered elements
    ``(id, element_index, type, text)``, type text, code, table or image.

    The texts between two tables or images are joined by line breaks and cut exactly every ``most``
    characters; pieces are trimmed, blank ones dropped. ``pos`` orders chunks by their first element.
    """
    order = W.partitionBy(id_col).orderBy("element_index")
    seen = elements.withColumn("island", F.count_if(F.col("type").isin("table", "image")).over(order))
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    seen = seen.where(F.col("type").isin("text", "code")).withColumn("text", text).where("text <> ''")
    size = F.length("text") + 1
    start = F.sum(size).over(W.partitionBy(id_col, "island").orderBy("element_index")) - size
    islands = seen.withColumn("start", start).groupBy(id_col, "island").agg(F.array_sort(F.collect_list(F.struct("element_index", "start", "text"))).alias("e"))
    whole = F.array_join(F.transform("e", lambda e: e["text"]), "\n")
    cuts = F.transform(F.sequence(F.lit(0), F.length(whole) - 1, F.lit(most)), lambda o: F.struct(o.alias("o"), F.regexp_replace(F.substring(whole, o + 1, F.lit(most)), r"^\s+|\s+$", "").alias("content")))
    pieces = islands.select(id_col, "island", "e", F.explode(F.filter(cuts, lambda c: c["content"] != "")).alias("c"))
    begun = F.filter("e", lambda e: e["start"] <= F.col("c.o"))
    numbered = pieces.select(id_col, "island", F.col("c.o").alias("o"), F.col("c.content").alias("content"), F.element_at(begun, -1)["element_index"].alias("element_start"))
    index = F.row_number().over(W.partitionBy(id_col).orderBy("island", "o")) - 1
    placed = numbered.withColumn("chunk_index", index.cast("long"))
    return placed.select(id_col, (F.col("element_start") * 1000 + F.col("chunk_index")).alias("pos"), "chunk_index", "content", "element_start")


def merge_short(items: Column, least: int = SHORT) -> Column:
    """Neighbouring short texts of a page joined; ``items`` is an array, in order, of
    ``struct<text, left, right, page_width>``, each page a row. A text goes to the one before it if
    both are short and the gap between them is at most a twentieth of the page's width."""

    def run(found: list | None) -> list:
        out: list[tuple] = []
        for text, left, right, page in found or []:
            held = out[-1] if out else None
            near = held and text and held[0] and max(len(held[0]), len(text)) <= least and abs(held[2] - left) <= (page or 1.0) * 0.05
            if near:
                out[-1] = (f"{held[0]} {text}".strip(), min(held[1], left), max(held[2], right), page)
            else:
                out.append((text, left, right, page))
        return out

    return by_row(run, "array<struct<text: string, left: double, right: double, page_width: double>>")(items)


def merge_tables(tables: Column, gap: float = 8.0) -> Column:
    """Table pieces of a page in one column and close below each other joined; ``tables`` is an array
    of ``struct<cells: array<array<string>>, left, top, right, bottom, page_width>``. A header that is
    repeated at the top of the lower piece is dropped."""

    def run(found: list | None) -> list:
        out: list[list] = []
        for cells, left, top, right, bottom, page in found or []:
            for held in reversed(out):
                slack = max(1.0, page or 0.0, held[5] or 0.0) * 0.05
                below = -gap <= top - held[4] <= gap * 4 or min(held[4], bottom) - max(held[2], top) >= -gap
                if abs(held[1] - left) <= slack and abs(held[3] - right) <= slack and below:
                    again = held[0] and cells and held[0][-1] == cells[0]
                    held[0] = [*(held[0] or []), *(cells or [])[1 if again else 0 :]]
                    held[1:5] = [min(held[1], left), min(held[2], top), max(held[3], right), max(held[4], bottom)]
                    break
            else:
                out.append([cells, left, top, right, bottom, page])
        return [tuple(t) for t in out]

    box = "left: double, top: double, right: double, bottom: double, page_width: double"
    return by_row(run, f"array<struct<cells: array<array<string>>, {box}>>")(tables)


def toc_tree(headings: DataFrame, id_col: str = "doc_id", pos: str = "pos", level: str = "level") -> DataFrame:
    """``headings`` with ``parent_pos``: the nearest heading before of a lower level, null at the root.

    For each level the last place seen is a running maximum, so one sort within a document does.
    """
    before = W.partitionBy(id_col).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    seen = [F.max(F.when(F.col(level) == k, F.col(pos))).over(before) for k in range(1, 7)]
    above = [F.when(F.col(level) > k, s) for k, s in enumerate(seen, 1)]
    return headings.withColumn("parent_pos", F.greatest(*above))


def toc_children(tree: DataFrame, id_col: str = "doc_id", pos: str = "pos") -> DataFrame:
    """``(id, pos, children)``: the places of the children in order, for every heading."""
    kids = tree.where("parent_pos IS NOT NULL").groupBy(id_col, F.col("parent_pos").alias(pos)).agg(F.array_sort(F.collect_list(F.col(pos))).alias("children"))
    return tree.select(id_col, pos).join(kids, [id_col, pos], "left").select(id_col, pos, F.coalesce("children", F.array().cast("array<long>")).alias("children"))
