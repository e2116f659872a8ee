"""HTML pages as nested elements, tables, links and page facts."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.operators.batches import by_row
from kbspark.operators.html import HEADINGS, SEMANTIC

#: Fixed sets of tags: those that end a paragraph, and those without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
LISTS, TEXTS = ("ul", "ol", "dl"), ("p", "blockquote")


class Page(HTMLParser):
    """Collects elements in document order. One handled node is open at a time; what stands in it is
    its text, nested lists and tables included."""

    def __init__(self, base: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.base = base
        self.elements: list[dict] = []
        self.links: list[dict] = []
        self.counts = {"forms": 0, "nodes": 0}
        self.path: list[str] = []
        self.regions: list[str] = []
        self.node: dict | None = None
        self.depth = 0  # tags of the open node's name within it
        self.skip = 0

    # one open node
    def _open(self, kind: str, tag: str, **more) -> None:
        self._close()
        self.node = {"kind": kind, "tag": tag, "words": [], "items": [], "rows": [], "numbers": [], **more}
        self.depth = 1

    def _close(self) -> None:
        node, self.node = self.node, None
        if node is None:
            return
        text = " ".join(" ".join(node["words"]).split())
        level = HEADINGS.index(node["tag"]) + 1 if node["tag"] in HEADINGS else 0
        if node["kind"] == "list":
            text = "\n".join(" ".join(" ".join(i).split()) for i in node["items"] if " ".join(i).strip(" -.:0123456789"))
        elif node["kind"] == "code":
            text = "".join(node["words"]).strip("\n")
        elif node["kind"] == "table":
            node["rows"] = [[" ".join(" ".join(c).split()) for c in r] for r in node["rows"] if r]
            text = "\n".join(" | ".join(r) for r in node["rows"])
        if not text:
            return
        if level:
            self.path = [*self.path[: level - 1], text]
        region = self.regions[-1] if self.regions else ""
        self.elements.append({"type": node["kind"], "text": text, "level": level, "path": list(self.path), "semantic": region, "language": node.get("language", ""), "rows": node["rows"]})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        self.counts["nodes"] += 1
        self.counts["forms"] += tag == "form"
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "base" and given.get("href"):
            self.base = urljoin(self.base, given["href"])
        elif tag == "a" and given.get("href", "").strip():
            try:
                url = urljoin(self.base, given["href"].strip())
                self.links.append({"url": url, "external": bool(urlsplit(url).netloc) and urlsplit(url).netloc != urlsplit(self.base).netloc})
            except ValueError:  # no address
                pass
        node = self.node
        if node is not None and tag == node["tag"]:
            self.depth += tag not in VOID
        if node is not None and node["kind"] == "list":
            if tag in LISTS:
                node["numbers"].append(0 if tag == "ol" else None)
            elif tag == "li":
                counter = node["numbers"]
                if counter and counter[-1] is not None:
                    counter[-1] += 1
                mark = f"{counter[-1]}." if counter and counter[-1] is not None else "-"
                node["items"].append([mark])
            elif tag == "dt":
                node["items"].append([])
            elif tag == "dd" and node["items"]:
                node["items"][-1].append(":")
            return
        if node is not None and node["kind"] == "table":
            if tag == "tr":
                node["rows"].append([])
            elif tag in ("td", "th"):
                node["rows"] = node["rows"] or [[]]
                node["rows"][-1].append([])
            return
        if node is not None and node["kind"] == "code":
            if tag == "code":
                node["language"] = node["language"] or _language(given)
            return
        if tag in SEMANTIC:
            self._close()
            self.regions.append(tag)
        elif tag in HEADINGS:
            self._open("heading", tag)
        elif tag in TEXTS:
            self._open("paragraph", tag)
        elif tag == "pre":
            self._open("code", tag, language=_language(given))
        elif tag in LISTS:
            self._open("list", tag)
            self.node["numbers"] = [0 if tag == "ol" else None]
        elif tag == "table":
            self._open("table", tag)
        elif tag == "img":
            region = self.regions[-1] if self.regions else ""
            self.elements.append({"type": "image", "text": given.get("src", ""), "level": 0, "path": list(self.path), "semantic": region, "language": "", "rows": []})
        elif tag == "div" and node is None:
            self._open("paragraph", tag)
        elif tag == "div" and node["tag"] == "div":
            self._open("paragraph", tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        node = self.node
        if node is not None and node["kind"] == "list" and tag in LISTS and node["numbers"]:
            node["numbers"].pop()
            if not node["numbers"]:
                self._close()
            return
        if node is not None and tag == node["tag"]:
            self.depth -= 1
            if self.depth <= 0 or node["kind"] not in ("table", "code"):
                self._close()
        elif tag in SEMANTIC and tag in self.regions:
            self._close()
            while self.regions and self.regions.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        node = self.node
        if node is None or self.skip:
            return
        if node["kind"] == "list":
            if node["items"]:
                node["items"][-1].append(data)
        elif node["kind"] == "table":
            if node["rows"] and node["rows"][-1]:
                node["rows"][-1][-1].append(data)
        else:
            node["words"].append(data)


def _language(given: dict) -> str:
    return next((c.split("-", 1)[1] for c in given.get("class", "").split() if c.startswith(("language-", "lang-"))), "")


def read(html: str | None, base: str | None) -> tuple:
    """Elements, links and facts of one page; broken pages give what was read."""
    page = Page(base or "")
    page.feed(html or "")
    page.close()
    page._close()
    head = (html or "").lstrip()[:200].lower()
    version = "HTML5" if head.startswith("<!doctype html") and "xhtml" not in head else "XHTML" if "<!doctype" in head and "xhtml" in head else None
    names = ("type", "text", "level", "path", "semantic", "language", "rows")
    return [tuple(e[n] for n in names) for e in page.elements], [(x["url"], x["external"]) for x in page.links], page.counts["forms"], version


ELEMENT = "struct<type: string, text: string, level: int, path: array<string>, semantic: string, language: string, rows: array<array<string>>>"
KIND = f"struct<elements: array<{ELEMENT}>, links: array<struct<url: string, external: boolean>>, forms: int, version: string>"


def parsed(html: Column, url: Column) -> Column:
    """A page taken apart once: its elements, links, number of forms and version."""
    return by_row(read, KIND)(html, url)


def elements(pages: DataFrame) -> DataFrame:
    """``(page_id, element_index, type, text, level, path, semantic, language, rows)``."""
    found = pages.select("page_id", F.posexplode(parsed(F.col("html"), F.col("url"))["elements"]).alias("element_index", "e"))
    return found.select("page_id", "element_index", "e.*")


def facts(pages: DataFrame) -> DataFrame:
    """``(page_id, headings, paragraphs, lists, tables, codes, images, links, external, forms, version, semantic)``."""
    p = F.col("p")
    count = lambda kind: F.size(F.filter(p["elements"], lambda e: e["type"] == kind)).cast("long")
    kinds = {"headings": "heading", "paragraphs": "paragraph", "lists": "list", "tables": "table", "codes": "code", "images": "image"}
    regions = F.array_sort(F.array_distinct(F.filter(F.transform(p["elements"], lambda e: e["semantic"]), lambda s: s != "")))
    return pages.select("page_id", parsed(F.col("html"), F.col("url")).alias("p")).select(
        "page_id", *[count(k).alias(n) for n, k in kinds.items()], F.size(p["links"]).cast("long").alias("links"),
        F.size(F.filter(p["links"], lambda x: x["external"])).cast("long").alias("external"), p["forms"].cast("long").alias("forms"), p["version"].alias("version"), F.array_join(regions, ",").alias("semantic"),
    )


def links(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, url, external)``: addresses resolved against the page's own or its base."""
    found = pages.select("page_id", F.posexplode(parsed(F.col("html"), F.col("url"))["links"]).alias("pos", "l"))
    return found.select("page_id", "pos", "l.*")


def tables(pages: DataFrame) -> DataFrame:
    """``(page_id, element_index, rows)``, rows filled up to the widest, the header first."""
    from kbspark.functions.tables import padded

    return elements(pages).where("type = 'table'").select("page_id", "element_index", padded(F.col("rows")).alias("rows"))
