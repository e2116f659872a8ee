"""Readers of single files, used inside tasks: one file is one row of bytes or text."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
import zlib
from xml.etree import ElementTree as ET

#: Encodings tried in order; the last accepts every byte.
ENCODINGS = ("utf-8", "gb18030", "latin-1")
BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
FENCE, HEADING, ITEM = re.compile(r"^\s*(`{3,}|~{3,})\s*(\S*)"), re.compile(r"^(#{1,6})\s+(.*?)(?:\s+#+)?\s*$"), re.compile(r"^(\s*)([-*+]|[0-9]+[.)])\s+(.*)")
RULE = re.compile(r"^\s*([-*_])\s*(?:\1\s*){2,}$")


def decode(data: bytes | None) -> str:
    """Text of a file: by its byte order mark, else by the first encoding that fits; line ends become
    ``\\n``. Null is empty."""
    data = bytes(data or b"")
    for mark, name in BOMS:
        if data.startswith(mark):
            text = data[len(mark) :].decode(name, "replace")
            break
    else:
        for name in ENCODINGS:
            try:
                text = data.decode(name)
                break
            except UnicodeDecodeError:
                continue
    return text.replace("\r\n", "\n").replace("\r", "\n")


def csv_rows(text: str | None) -> list[list[str]]:
    """Rows of delimited text without blank ones; the delimiter is the likeliest of ``,;\\t|``."""
    lines = (text or "").split("\n", 5)[:5]
    count = {d: sum(x.count(d) for x in lines) for d in ",;\t|"}
    return [r for r in csv.reader(io.StringIO(text or ""), delimiter=max(count, key=lambda d: count[d])) if any(c.strip() for c in r)]


def markdown_elements(text: str | None) -> list[tuple]:
    """``(type, text, level, path, language, line_start, line_end)`` of a Markdown text in order.

    Types are heading, paragraph, list, code, quote and table; rules between paragraphs are left out.
    """
    out: list[tuple] = []
    path: list[str] = []
    block: list[str] = []
    kind, began, fence, language = "", 0, "", ""

    def close(end: int) -> None:
        nonlocal block, kind
        if kind and (kind == "code" or any(x.strip() for x in block)):
            out.append((kind, "\n".join(block).strip("\n" if kind == "code" else None), 0, " > ".join(path), language if kind == "code" else "", began, end))
        block, kind = [], ""

    lines = (text or "").split("\n")
    for n, line in enumerate(lines, 1):
        found = FENCE.match(line)
        if kind == "code":
            if found and line.strip().startswith(fence) and not found[2]:
                close(n)
            else:
                block.append(line)
            continue
        if found:
            close(n - 1)
            kind, began, fence, language = "code", n, found[1], found[2]
            continue
        if head := HEADING.match(line):
            close(n - 1)
            level = len(head[1])
            path[level - 1 :] = [head[2]]
            out.append(("heading", head[2], level, " > ".join(path), "", n, n))
            continue
        if not line.strip() or RULE.match(line):
            close(n - 1)
            continue
        item = ITEM.match(line)
        new = "list" if item else "table" if line.lstrip().startswith("|") else "quote" if line.lstrip().startswith(">") else "paragraph"
        if kind == "list" and new == "paragraph" and line[:1] in " \t":
            new = "list"  # a further line of the item
        if new != kind:
            close(n - 1)
            kind, began = new, n
        if item:
            line = f"{item[2]} {item[3]}" if item[2][0].isdigit() else f"- {item[3]}"
        block.append(line.lstrip().lstrip(">").strip() if new == "quote" else line.strip() if new != "list" else line.rstrip())
    close(len(lines))
    return out


def xml_tree(text: str | None) -> str | None:
    """An XML text as JSON: attributes in ``_attributes``, text in ``_text``, repeated tags in lists;
    null where it is malformed."""

    def node(e: ET.Element):
        out: dict = {}
        if e.attrib:
            out["_attributes"] = dict(e.attrib)
        for child in e:
            value = node(child)
            if child.tag in out:
                out[child.tag] = [*(out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]), value]
            else:
                out[child.tag] = value
        words = (e.text or "").strip()
        if words and not out:
            return words
        if words:
            out["_text"] = words
        return out

    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return None
    return json.dumps({root.tag: node(root)}, ensure_ascii=False, sort_keys=True)


def json_schema(text: str | None) -> str | None:
    """``type``, ``properties`` and, from the first element, ``items`` of a JSON text, as JSON."""

    def kind(v):
        if isinstance(v, dict):
            return {"type": "object", "properties": {k: kind(x) for k, x in v.items()}}
        if isinstance(v, list):
            return {"type": "array", "items": kind(v[0]) if v else {}}
        names = {bool: "boolean", int: "integer", float: "number", str: "string", type(None): "null"}
        return {"type": names[type(v)]}

    try:
        return json.dumps(kind(json.loads(text or "")), sort_keys=True)
    except ValueError:
        return None


def _parts(data: bytes | None) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(bytes(data or b"")))
    except zipfile.BadZipFile:
        return None


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e: ET.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == "t")


def _related(file: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """``id -> (kind, part)`` of the relations of a part; those that lead out of the file are left out."""
    folder, name = part.rsplit("/", 1) if "/" in part else ("", part)
    rels = f"{folder}/_rels/{name}.rels".lstrip("/")
    if rels not in file.namelist():
        return {}
    out = {}
    for e in ET.fromstring(file.read(rels)):
        if e.attrib.get("TargetMode") != "External":
            target = e.attrib.get("Target", "")
            steps = [] if target.startswith("/") else folder.split("/")
            for step in target.split("/"):
                steps = steps[:-1] if step == ".." else [*steps, step] if step not in ("", ".") else steps
            out[e.attrib.get("Id", "")] = (e.attrib.get("Type", "").rsplit("/", 1)[-1], "/".join(steps))
    return out


def _ordered(file: zipfile.ZipFile, main: str, tag: str, numbered: str) -> list[tuple[dict, str]]:
    """``(attributes, part)`` of the elements ``tag`` of a main part, in its order, by their relation.
    Files without relations or main part have their numbered parts in the order of their numbers."""
    names = sorted((n for n in file.namelist() if re.fullmatch(numbered, n)), key=lambda n: int(re.search("[0-9]+", n)[0]))
    listed = [e.attrib for e in ET.fromstring(file.read(main)).iter() if _local(e) == tag] if main in file.namelist() else []
    related = _related(file, main)
    if related:
        found = [(a, related.get(next((v for k, v in a.items() if k.endswith("}id")), ""), ("", ""))[1]) for a in listed]
        return [(a, part) for a, part in found if part in file.namelist()]
    return list(zip(listed, names, strict=False)) if listed else [({}, n) for n in names]


def column_of(reference: str) -> int:
    """The column's number from 0 of a cell reference as ``AB12``, -1 where it names none."""
    at = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1


def xlsx_sheets(data: bytes | None) -> list[tuple[str, list[list[str]], dict]]:
    """``(name, rows, flags)`` of the sheets of a workbook in its order, blank rows left out; a broken file has none.

    The cells of a merged range all have the value of its first one. ``flags``: how many merged
    ranges, formulas and images the sheet has.
    """
    file = _parts(data)
    if file is None or "xl/workbook.xml" not in file.namelist():
        return []
    shared = [_text(e) for e in ET.fromstring(file.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in file.namelist() else []
    out = []
    for attributes, sheet in _ordered(file, "xl/workbook.xml", "sheet", r"xl/worksheets/sheet[0-9]+\.xml"):
        tree = ET.fromstring(file.read(sheet))
        merged = [e.attrib.get("ref", "") for e in tree.iter() if _local(e) == "mergeCell"]
        rows: dict[int, dict[int, str]] = {}
        for row in (e for e in tree.iter() if _local(e) == "row"):
            y = int(row.attrib.get("r", len(rows) + 1))
            cells = rows.setdefault(y, {})
            for c in (e for e in row if _local(e) == "c"):
                place = column_of(c.attrib.get("r", ""))
                value = next((e.text or "" for e in c if _local(e) == "v"), _text(c))
                cells[place if place >= 0 else len(cells)] = shared[int(value)] if c.attrib.get("t") == "s" and value else value
        for ref in merged:
            (x, y), (to_x, to_y) = ((column_of(r), int(re.search("[0-9]+", r)[0])) for r in (ref.split(":") * 2)[:2])
            value = rows.get(y, {}).get(x, "")
            for line in [n for n in rows if y <= n <= to_y]:
                rows[line].update(dict.fromkeys(range(x, to_x + 1), value))
        drawn = [part for kind, part in _related(file, sheet).values() if kind == "drawing" and part in file.namelist()]
        images = sum(kind == "image" for part in drawn for kind, _ in _related(file, part).values())
        formulas = sum(_local(e) == "f" for e in tree.iter())
        kept = [[r.get(i, "") for i in range(max(r) + 1)] for _, r in sorted(rows.items()) if any(v.strip() for v in r.values())]
        out.append((attributes.get("name", ""), kept, {"merged": len(merged), "formulas": formulas, "images": images}))
    return out


#: Styles of the lines of a table of contents, as word processors name them.
TOC_STYLE = re.compile(r"(?i)^(toc|contents|verzeichnis|tdm)[ ]?[0-9]*$|^toc ?heading$")


def docx_elements(data: bytes | None) -> list[tuple[str, str, str, list[list[str]]]]:
    """``(type, style, text, cells)`` of the paragraphs, tables and images of a document in order; an
    image's text is the name of its part. Tables of contents, by field or by style, are left out."""
    file = _parts(data)
    if file is None or "word/document.xml" not in file.namelist():
        return []
    body = next((e for e in ET.fromstring(file.read("word/document.xml")) if _local(e) == "body"), [])
    related = _related(file, "word/document.xml")
    out = []

    def images(e: ET.Element) -> None:
        for x in e.iter():
            if _local(x) in ("blip", "imagedata"):
                kind, part = related.get(next((v for k, v in x.attrib.items() if k.endswith(("}embed", "}id"))), ""), ("", ""))
                if kind == "image":
                    out.append(("image", "", part, []))

    def visit(blocks) -> None:
        for e in blocks:
            if _local(e) == "sdt":  # a block of its own, unless it is a table of contents
                if not any(_local(x) == "docPartGallery" and "Contents" in "".join(x.attrib.values()) for x in e.iter()):
                    visit(next((x for x in e if _local(x) == "sdtContent"), []))
            elif _local(e) == "p":
                style = next((v for x in e.iter() if _local(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
                if _text(e).strip() and not TOC_STYLE.match(style):
                    out.append(("text", style, _text(e).strip(), []))
                images(e)
            elif _local(e) == "tbl":
                out.append(("table", "", "", [[_text(c).strip() for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]))
                images(e)

    visit(body)
    return out


def slide_texts(shapes: list[tuple[str, bool]]) -> tuple[str, str]:
    """Title and body of a slide from ``(text, is_title)`` shapes: the title shape, else the first
    short text; the other texts by line."""
    shapes = [(t.strip(), is_title) for t, is_title in shapes if t and t.strip()]
    marked = next((i for i, (_, is_title) in enumerate(shapes) if is_title), None)
    at = marked if marked is not None else next((i for i, (t, _) in enumerate(shapes) if len(t) < 200), None)
    title = "" if at is None else shapes[at][0]
    return title, "\n".join(t for i, (t, _) in enumerate(shapes) if i != at)


def pptx_slides(data: bytes | None) -> list[tuple[str, str, str, list[list[list[str]]]]]:
    """``(title, body, notes, tables)`` of the slides of a presentation, in the order of the deck."""
    file = _parts(data)
    if file is None:
        return []
    out = []
    for _, name in _ordered(file, "ppt/presentation.xml", "sldId", r"ppt/slides/slide[0-9]+\.xml"):
        tree = ET.fromstring(file.read(name))
        title, body = slide_texts(_shapes(tree))
        tables = [[[_text(c).strip() for c in r if _local(c) == "tc"] for r in t if _local(r) == "tr"] for t in tree.iter() if _local(t) == "tbl"]
        noted = [part for kind, part in _related(file, name).values() if kind == "notesSlide" and part in file.namelist()]
        notes = "\n".join(t.strip() for part in noted for t, kind in _shapes(ET.fromstring(file.read(part)), "body") if t.strip())
        out.append((title, body, notes, tables))
    return out


def _shapes(tree: ET.Element, only: str | None = None) -> list[tuple[str, bool]]:
    """``(text, is_title)`` of the shapes with text; with ``only`` those whose place holder is of this kind."""
    shapes = []
    for shape in (e for e in tree.iter() if _local(e) == "sp"):
        kinds = [x.attrib.get("type", "") for x in shape.iter() if _local(x) == "ph"]
        if only is None or only in kinds:
            words = "\n".join(_text(p) for p in shape.iter() if _local(p) == "p")
            shapes.append((words, any(k in ("title", "ctrTitle") for k in kinds)))
    return shapes


def pdf_texts(data: bytes | None) -> list[str]:
    """The texts that the content streams of a PDF show, one for each stream with any. Streams may be
    deflated; strings in the fonts' own codings other than Latin are not mapped."""
    out = []
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", bytes(data or b""), re.DOTALL):
        stream = m[2]
        if b"FlateDecode" in m[1]:
            try:
                stream = zlib.decompressobj().decompress(stream)
            except zlib.error:
                continue
        lines: list[str] = []
        for shown in re.finditer(rb"\[((?:[^\[\]\\]|\\.)*)\]\s*TJ|(\((?:[^()\\]|\\.)*\))\s*(?:Tj|'|\")|(T\*|ET)", stream, re.DOTALL):
            if shown[3]:
                lines.append("\n")
                continue
            for part in re.finditer(rb"\(((?:[^()\\]|\\.)*)\)", shown[1] or shown[2], re.DOTALL):
                lines.append(re.sub(rb"\\([()\\])", rb"\1", part[1]).decode("latin-1"))
        text = re.sub(r"\n+", "\n", "".join(lines)).strip()
        if text:
            out.append(text)
    return out


# Writers of the same formats, for exports
def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for name, text in parts.items():
            file.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{text}')
    return out.getvalue()


def _safe(text: str | None) -> str:
    """Text for XML: characters that it does not allow become blanks."""
    plain = re.sub("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]", " ", text or "")
    return plain.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def write_xlsx(name: str, rows: list[list[str]] | None) -> bytes:
    """A workbook of one sheet with text cells."""

    def letters(n: int) -> str:
        return (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)

    cells = lambda r, y: "".join(f'<c r="{letters(x)}{y}" t="inlineStr"><is><t xml:space="preserve">{_safe(v)}</t></is></c>' for x, v in enumerate(r))
    body = "".join(f'<row r="{y}">{cells(r, y)}</row>' for y, r in enumerate(rows or [], 1))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "".join(f'<Override PartName="/xl/{p}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{t}+xml"/>' for p, t in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet")))
    return _zip({
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{kinds}</Types>',
        "_rels/.rels": _relations(rel, "officeDocument", "xl/workbook.xml"), "xl/_rels/workbook.xml.rels": _relations(rel, "worksheet", "worksheets/sheet1.xml"),
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{_safe(name)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    })


def _relations(base: str, kind: str, target: str) -> str:
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{base}/{kind}" Target="{target}"/></Relationships>'


def write_docx(title: str | None, paragraphs: list[str] | None) -> bytes:
    """A document with a heading and paragraphs."""
    w, rel = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    line = lambda t, style="": f'<w:p>{style}<w:r><w:t xml:space="preserve">{_safe(t)}</w:t></w:r></w:p>'
    body = line(title, '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + "".join(map(line, paragraphs or []))
    return _zip({
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": _relations(rel, "officeDocument", "word/document.xml"), "word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>',
    })


def write_pdf(lines: list[str] | None) -> bytes:
    """A page of Latin lines, without line breaking."""
    shown = b" T*\n".join(b"(" + re.sub(rb"([()\\])", rb"\\\1", x.replace("\n", " ").encode("latin-1", "replace")) + b") Tj" for x in lines or [])
    stream = zlib.compress(b"BT /F1 11 Tf 14 TL 50 780 Td\n" + shown + b"\nET")
    parts = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>",
        b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>",
        b"<</Length %d/Filter/FlateDecode>>\nstream\n" % len(stream) + stream + b"\nendstream", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>",
    ]
    out, places = b"%PDF-1.4\n", []
    for i, part in enumerate(parts, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + part + b"\nendobj\n"
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(parts) + 1) + table + b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(parts) + 1, len(out))


def write_pptx(slides: list[tuple[str, str]] | None) -> bytes:
    """The slides' parts of a presentation: a title and a text box each."""
    p, a = "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main"
    box = lambda text, mark: f'<p:sp><p:nvSpPr><p:nvPr>{mark}</p:nvPr></p:nvSpPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{_safe(x)}</a:t></a:r></a:p>" for x in (text or "").split(chr(10)))}</p:txBody></p:sp>'
    title = '<p:ph type="title"/>'
    return _zip({f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{box(t, title)}{box(b, "")}</p:spTree></p:cSld></p:sld>' for i, (t, b) in enumerate(slides or [], 1)})
