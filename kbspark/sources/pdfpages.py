"""Text of PDF pages with its places, and the order in which it is read. One file is one row of bytes, one page one group."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.operators.batches import by_row

#: Mean width of a letter, in its size, where a font gives none; gaps that part words and columns, in sizes.
LETTER, WORD_GAP, COLUMN_GAP = 0.5, 0.2, 1.2
#: Share of a region's width from which a line spans its columns; share of pages from which a line at one place runs along.
SPANNING, RUNNING = 0.6, 0.6
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]{}/%]*|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+[0-9]?|<<|>>", re.DOTALL)
SPANS = "array<struct<page: int, x: double, y: double, width: double, size: double, text: string>>"
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def objects(data: bytes) -> dict[int, bytes]:
    """The bodies of a file's objects by number, those in object streams too."""
    found = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.DOTALL)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            raw, first = stream(body), re.search(rb"/First\s+(\d+)", body)
            if raw and first:
                head, at = [int(x) for x in raw[: int(first[1])].split()], int(first[1])
                places = [*zip(head[::2], head[1::2], strict=False)]
                for i, (number, start) in enumerate(places):
                    end = places[i + 1][1] if i + 1 < len(places) else len(raw) - at
                    found.setdefault(number, raw[at + start : at + end])
    return found


def stream(body: bytes) -> bytes:
    """The content of a stream, inflated if it is deflated; empty where it is broken or coded otherwise."""
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.DOTALL)
    if not m:
        return b""
    if b"FlateDecode" not in body[: m.start()]:
        return m[1] if b"/Filter" not in body[: m.start()] else b""
    try:
        return zlib.decompressobj().decompress(m[1])
    except zlib.error:
        return b""


def entry(body: bytes, name: bytes, held: dict[int, bytes]) -> bytes:
    """The value of a dictionary's entry: of a reference what it leads to, else what stands behind the name."""
    m = re.search(rb"/" + name + rb"\s*(?:(\d+)\s+\d+\s+R|(?=[<\[/\d-]))", body)
    if not m:
        return b""
    if m[1]:
        return held.get(int(m[1]), b"")
    rest, depth = body[m.end() :], 0
    for t in re.finditer(rb"<<|>>|\[|\]", rest):
        depth += 1 if t[0] in (b"<<", b"[") else -1
        if depth <= 0:
            return rest[: t.end()]
    return rest


def references(value: bytes) -> list[int]:
    return [int(m[1]) for m in re.finditer(rb"(\d+)\s+\d+\s+R", value)]


def pages(held: dict[int, bytes]) -> Iterator[tuple[bytes, bytes]]:
    """``(page, resources)`` in the order of the page tree; resources are inherited."""
    root = next((b for b in held.values() if re.search(rb"/Type\s*/Catalog", b)), b"")

    def walk(body: bytes, resources: bytes, depth: int) -> Iterator[tuple[bytes, bytes]]:
        resources = entry(body, b"Resources", held) or resources
        if re.search(rb"/Type\s*/Pages\b", body) and depth < 50:
            for kid in references(entry(body, b"Kids", held)):
                yield from walk(held.get(kid, b""), resources, depth + 1)
        elif re.search(rb"/Type\s*/Page\b", body):
            yield body, resources

    yield from walk(entry(root, b"Pages", held), b"", 0)


class Font:
    """What the codes of a font mean and how wide they are."""

    def __init__(self, body: bytes, held: dict[int, bytes]):
        self.letters: dict[int, str] = {}
        self.bytes = 2 if re.search(rb"/Subtype\s*/Type0", body) else 1
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        cmap = stream(entry(body, b"ToUnicode", held))
        for block in re.finditer(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
            for m in re.finditer(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block[1]):
                self.letters[int(m[1], 16)] = text(m[2])
        for block in re.finditer(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
            for m in re.finditer(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block[1], re.DOTALL):
                codes = range(int(m[1], 16), min(int(m[2], 16), int(m[1], 16) + 0xFFFF) + 1)
                if m[3]:
                    first = text(m[3])
                    self.letters.update((c, first[:-1] + chr(ord(first[-1]) + i)) for i, c in enumerate(codes))
                else:
                    self.letters.update(zip(codes, (text(h) for h in re.findall(rb"<([0-9A-Fa-f]+)>", m[4])), strict=False))
        start = re.search(rb"/FirstChar\s+(\d+)", body)
        widths = re.findall(rb"[-\d.]+", entry(body, b"Widths", held)) if start else []
        self.widths = {int(start[1]) + i: float(w) / 1000 for i, w in enumerate(widths)} if start else {}

    def shown(self, raw: bytes) -> tuple[str, float]:
        codes = [int.from_bytes(raw[i : i + self.bytes]) for i in range(0, len(raw), self.bytes)]
        plain = lambda c: bytes([c]).decode("cp1252", "replace") if c < 256 else ""
        return "".join(self.letters.get(c, plain(c)) for c in codes), sum(self.widths.get(c, LETTER) for c in codes)


def literal(token: bytes) -> bytes:
    """The bytes of a string token."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    one = lambda m: ESCAPES.get(m[1], b"" if m[1] in b"\n" else m[1]) if not m[1][:1].isdigit() else bytes([int(m[1], 8) & 255])
    return re.sub(rb"\\([0-7]{1,3}|.)", one, token[1:-1], flags=re.DOTALL)


def times(a: tuple, b: tuple) -> tuple:
    """The matrix that does ``a`` and then ``b``."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def shown(content: bytes, fonts: dict[bytes, Font]) -> Iterator[tuple[float, float, float, float, str]]:
    """``(x, y, width, size, text)`` of each string that a page's content shows."""
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    page, text, line, font, size, leading, stack = unit, unit, unit, Font(b"", {}), 1.0, 0.0, []
    args: list = []
    for m in TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<" and t != b"<<":
            args.append(literal(t))
        elif t[:1] in b"/[]":
            args.append(t)
        elif re.match(rb"[-+.\d]", t):
            args.append(float(t))
        else:
            n = [a for a in args if isinstance(a, float)]
            if t == b"q":
                stack.append(page)
            elif t == b"Q" and stack:
                page = stack.pop()
            elif t == b"cm" and len(n) == 6:
                page = times(tuple(n), page)
            elif t == b"BT":
                text = line = unit
            elif t == b"Tf" and n:
                font, size = fonts.get(next((a[1:] for a in args if isinstance(a, bytes) and a[:1] == b"/"), b""), font), n[-1]
            elif t == b"TL" and n:
                leading = n[0]
            elif t in (b"Td", b"TD") and len(n) == 2:
                leading = -n[1] if t == b"TD" else leading
                text = line = times((1, 0, 0, 1, n[0], n[1]), line)
            elif t == b"Tm" and len(n) == 6:
                text = line = tuple(n)
            elif t in (b"T*", b"'", b'"'):
                text = line = times((1, 0, 0, 1, 0, -leading), line)
            if t in (b"Tj", b"TJ", b"'", b'"'):
                for a in args:
                    if isinstance(a, float) and t == b"TJ":
                        text = times((1, 0, 0, 1, -a / 1000 * size, 0), text)
                    elif isinstance(a, bytes) and a not in (b"[", b"]"):
                        words, width = font.shown(a)
                        at = times(text, page)
                        tall = abs(size) * (at[1] ** 2 + at[3] ** 2 or at[0] ** 2) ** 0.5
                        if words.strip():
                            yield at[4], at[5], width * abs(size) * (at[0] ** 2 + at[1] ** 2) ** 0.5, tall, words
                        text = times((1, 0, 0, 1, width * size, 0), text)
            args = []


def spans(data: bytes | None) -> list[tuple[int, float, float, float, float, str]]:
    """``(page, x, y, width, size, text)`` of a file, pages from 0; a file that is no PDF has none."""
    held, out = objects(bytes(data or b"")), []
    for number, (body, resources) in enumerate(pages(held)):
        listed = entry(resources, b"Font", held)
        fonts = {m[1]: Font(held.get(int(m[2]), b""), held) for m in re.finditer(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", listed)}
        where = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        content = b"\n".join(stream(held.get(i, b"")) for i in references(where[1])) if where else b""
        out += [(number, *s) for s in shown(content, fonts)]
    return out


def lines_of(found: list[tuple[float, float, float, float, str]]) -> list[list]:
    """Spans as pieces of lines ``[x, y, end, size, text]``: those on one base line without a column's gap between."""
    out: list[list] = []
    for x, y, width, size, text in sorted(found, key=lambda s: (-round(s[1], 1), s[0])):
        last = out[-1] if out else None
        if last and abs(last[1] - y) < 0.3 * size and x - last[2] < COLUMN_GAP * size:
            gap = x - last[2] > WORD_GAP * size and not last[4].endswith(" ") and not text.startswith(" ")
            last[2], last[4] = max(last[2], x + width), last[4] + (" " if gap else "") + text
        else:
            out.append([x, y, x + width, size, text])
    return out


def ordered(pieces: list[list]) -> list[list]:
    """Pieces of lines in reading order, by recursive cutting: columns from left to right, where lines across them
    part them into bands from top to bottom."""
    if len(pieces) < 2:
        return pieces
    low, high = min(p[0] for p in pieces), max(p[2] for p in pieces)
    wide = [p for p in pieces if p[2] - p[0] > SPANNING * (high - low)]
    narrow = sorted((p for p in pieces if p not in wide), key=lambda p: p[0])
    best, reach = (0.0, 0.0), narrow[0][2] if narrow else 0.0
    for p in narrow[1:]:
        best, reach = max(best, (p[0] - reach, (p[0] + reach) / 2)), max(reach, p[2])
    if not narrow or best[0] < COLUMN_GAP * min(p[3] for p in narrow):
        return sorted(pieces, key=lambda p: (-p[1], p[0]))
    out: list[list] = []
    tops = sorted((p[1] for p in wide), reverse=True)
    bands: list[list[list]] = [[] for _ in range(len(tops) + 1)]
    for p in narrow:
        bands[sum(p[1] < t for t in tops)].append(p)
    for i, band in enumerate(bands):
        out += ordered([p for p in band if p[0] < best[1]]) + ordered([p for p in band if p[0] >= best[1]])
        out += [p for p in wide if i < len(tops) and p[1] == tops[i] and p not in out]
    return out


def page_lines(files: DataFrame) -> DataFrame:
    """``(path, page, line, x, y, size, text)`` of the pages of ``files(path, content)``, lines in reading order.

    A file is parsed to spans in one row; each page is then a group of its own, put in order in its
    task. Pages without text have no lines.
    """
    found = by_row(spans, SPANS)
    each = files.select("path", F.explode(found("content")).alias("s")).select("path", "s.*")

    def run(page: pa.Table) -> pa.Table:
        rows = page.select(["x", "y", "width", "size", "text"]).to_pylist()
        made = ordered(lines_of([tuple(r.values()) for r in rows]))
        n = len(made)
        cols = [pa.array([page.column(c)[0].as_py()] * n, page.schema.field(c).type) for c in ("path", "page")]
        cols += [pa.array(range(n), pa.int32()), *[pa.array([p[i] for p in made], pa.float64()) for i in (0, 1, 3)], pa.array([p[4].strip() for p in made], pa.string())]
        return pa.table(cols, ["path", "page", "line", "x", "y", "size", "text"])

    return each.groupBy("path", "page").applyInArrow(run, "path string, page int, line int, x double, y double, size double, text string")


def without_running(lines: DataFrame) -> DataFrame:
    """Lines without headers and footers: those that stand at one height, digits apart, on most pages of a file of three or more."""
    key = [F.col("path"), F.round("y", 0).alias("y_"), F.regexp_replace("text", "[0-9]+", "#").alias("t_")]
    seen = lines.groupBy(*key).agg(F.count_distinct("page").alias("n"))
    many = lines.groupBy("path").agg(F.count_distinct("page").alias("pages")).where("pages >= 3")
    running = seen.join(many, "path").where(F.col("n") >= RUNNING * F.col("pages")).select("path", "y_", "t_")
    return lines.withColumns({"y_": F.round("y", 0), "t_": F.regexp_replace("text", "[0-9]+", "#")}).join(running, ["path", "y_", "t_"], "left_anti").select(*lines.columns)
