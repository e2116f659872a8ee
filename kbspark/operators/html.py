"""Ordered elements of HTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from kbspark.operators.batches import pieces

#: Fixed tag sets.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = ("p", "blockquote", "li", "pre", "td", "th", "dt", "dd")
SEMANTIC = ("article", "section", "header", "footer", "nav", "main", "aside")
#: An ampersand that begins no reference ended by a semicolon.
BARE = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")


class Elements(HTMLParser):
    """Collects ``(type, text, level, path, semantic)`` in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, int, str, str]] = []
        self.path: list[str] = []
        self.regions: list[str] = []
        self.open: str | None = None
        self.words: list[str] = []

    def _flush(self) -> None:
        text = " ".join(" ".join(self.words).split())
        if self.open and text:
            level = HEADINGS.index(self.open) + 1 if self.open in HEADINGS else 0
            if level:
                self.path = [*self.path[: level - 1], text]
            kind = "heading" if level else {"li": "list", "pre": "code", "td": "table", "th": "table"}.get(self.open, "paragraph")
            self.found.append((kind, text, level, " > ".join(self.path), self.regions[-1] if self.regions else ""))
        self.open, self.words = None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SEMANTIC:
            self._flush()
            self.regions.append(tag)
        elif tag in HEADINGS or tag in BLOCKS:
            self._flush()
            self.open = tag
        elif tag == "img":
            given = dict(attrs)
            self.found.append(("image", given.get("src") or "", 0, " > ".join(self.path), self.regions[-1] if self.regions else ""))

    def handle_endtag(self, tag: str) -> None:
        if tag == self.open:
            self._flush()
        elif tag in SEMANTIC and tag in self.regions:
            self._flush()
            while self.regions and self.regions.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open:
            self.words.append(data)


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", bare: bool = True) -> DataFrame:
    """``(page_id, element_index, type, text, level, path, semantic)``; the walk has no built-in form.
    Without ``bare``, references that no semicolon ends, such as ``&amp``, stay as they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "element_index", "type", "text", "level", "path", "semantic"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        for part in (p for b in batches for p in pieces(*b.columns)):
            out = []
            for page, html in zip(*[c.to_pylist() for c in part], strict=True):
                parser = Elements()
                parser.feed((html or "") if bare else BARE.sub("&amp;", html or ""))
                parser.close()
                parser._flush()
                out += [(page, i, *e) for i, e in enumerate(parser.found)]
            cols = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    few = pages.selectExpr(f"cast({id_col} as long) as page_id", html_col)
    return few.mapInArrow(run, "page_id long, element_index int, type string, text string, level int, path string, semantic string")
