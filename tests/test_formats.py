"""Order, names and parts of office files by their relations, on files made by hand."""

import io
import zipfile
import zlib

from kbspark.sources import files, formats, pdfpages

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
A, P, W, S = (f"http://schemas.openxmlformats.org/{x}/2006/main" for x in ("drawingml", "presentationml", "wordprocessingml", "spreadsheetml"))


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        for name, text in parts.items():
            file.writestr(name, text)
    return out.getvalue()


def relations(*rows):
    one = lambda i, kind, target: f'<Relationship Id="{i}" Type="{REL}/{kind}" Target="{target}"/>'
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(one(*r) for r in rows)}<Relationship Id="x" Type="{REL}/hyperlink" Target="http://a.b" TargetMode="External"/></Relationships>'


def slide(text, table=""):
    return f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>{table}</p:spTree></p:cSld></p:sld>'


def test_a_moved_slide_keeps_its_place_in_the_deck():
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = f'<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>{cell("h1")}{cell("h2")}</a:tr><a:tr>{cell("1")}{cell("")}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    notes = slide("not this").replace('type="title"', 'type="sldNum"').replace("</p:spTree>", '<p:sp><p:nvSpPr><p:nvPr><p:ph type="body" idx="1"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>say</a:t></a:r><a:r><a:t> this</a:t></a:r></a:p></p:txBody></p:sp></p:spTree>')
    deck = packed({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{REL}"><p:sldIdLst><p:sldId id="257" r:id="r3"/><p:sldId id="256" r:id="r1"/><p:sldId id="258" r:id="gone"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": relations(("r1", "slide", "slides/slide1.xml"), ("r3", "slide", "/ppt/slides/slide12.xml")),
        "ppt/slides/slide1.xml": slide("made first", table), "ppt/slides/slide12.xml": slide("moved to the front"), "ppt/slides/slide2.xml": slide("no longer in the deck"),
        "ppt/slides/_rels/slide1.xml.rels": relations(("n", "notesSlide", "../notesSlides/notesSlide1.xml")), "ppt/notesSlides/notesSlide1.xml": notes,
    })
    assert formats.pptx_slides(deck) == [("moved to the front", "", "", []), ("made first", "", "say this", [[["h1", "h2"], ["1", ""]]])]
    assert formats.pptx_slides(b"broken") == [] and formats.pptx_slides(None) == []


def test_sheets_have_their_own_names_and_flags(spark):
    cell = lambda r, v, extra="": f'<c r="{r}">{extra}<v>{v}</v></c>'
    book = packed({
        "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{REL}"><sheets><sheet name="Shown first" sheetId="7" r:id="b"/><sheet name="Made first" sheetId="1" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations(("a", "worksheet", "worksheets/sheet1.xml"), ("b", "worksheet", "worksheets/sheet2.xml")),
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}"><sheetData><row r="1">{cell("A1", "one")}</row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{S}"><sheetData><row r="2">{cell("A2", "wide")}{cell("D2", "3", "<f>1+2</f>")}</row><row r="3">{cell("C3", "x")}</row></sheetData><mergeCells><mergeCell ref="A2:B3"/></mergeCells></worksheet>',
        "xl/worksheets/_rels/sheet2.xml.rels": relations(("d", "drawing", "../drawings/drawing1.xml")), "xl/drawings/drawing1.xml": "<d/>",
        "xl/drawings/_rels/drawing1.xml.rels": relations(("i", "image", "../media/image1.png"), ("j", "image", "../media/image2.png")),
    })
    rows = spark.createDataFrame([("a", bytearray(book)), ("b", bytearray(b"broken")), ("c", None)], "path string, content binary")
    got = [(r.sheet_index, r.sheet, r.rows, r.merged, r.formulas, r.images) for r in files.xlsx(rows).orderBy("sheet_index").collect()]
    assert got == [(0, "Shown first", [["wide", "wide", "", "3"], ["wide", "wide", "x"]], 1, 1, 2), (1, "Made first", [["one"]], 0, 0, 0)]


def test_images_stand_in_their_place_and_contents_are_left_out():
    line = lambda t, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    picture = f'<w:p><w:r><w:drawing><a:blip xmlns:a="{A}" r:embed="p"/></w:drawing></w:r></w:p>'
    contents = f'<w:sdt><w:sdtPr><w:docPartObj><w:docPartGallery w:val="Table of Contents"/></w:docPartObj></w:sdtPr><w:sdtContent>{line("Start .... 1")}</w:sdtContent></w:sdt>'
    block = f'<w:sdt><w:sdtPr/><w:sdtContent>{line("in a control")}</w:sdtContent></w:sdt>'
    file = packed({
        "word/document.xml": f'<w:document xmlns:w="{W}" xmlns:r="{REL}"><w:body>{contents}{line("Start", "Heading1")}{line("Start 1", "TOC2")}{picture}{block}{line("tocsin", "Body")}</w:body></w:document>',
        "word/_rels/document.xml.rels": relations(("p", "image", "media/image1.png")),
    })
    got = [(k, s, t, c) for k, s, t, c in formats.docx_elements(file)]
    assert got == [("text", "Heading1", "Start", []), ("image", "", "word/media/image1.png", []), ("text", "", "in a control", []), ("text", "Body", "tocsin", [])]


def pdf(pages, fonts=b""):
    """A file of pages with these contents; the page tree has them in this order, the file in another."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    parts = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[%s]/Count %d/Resources<</Font<</F1 3 0 R /F2 4 0 R>>>>>>" % (kids, len(pages)), 3: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", 4: fonts or b"<</Type/Font/Subtype/Type1>>"}
    for i, content in enumerate(pages):
        packed_ = zlib.compress(content)
        parts[10 + 2 * i] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (11 + 2 * i)
        parts[11 + 2 * i] = b"<</Length %d/Filter/FlateDecode>>\nstream\n" % len(packed_) + packed_ + b"\nendstream"
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, parts[n]) for n in sorted(parts, reverse=True))


def column(x, y, words, lead=12):
    return b"BT /F1 10 Tf %d TL 1 0 0 1 %d %d Tm " % (lead, x, y) + b" T* ".join(b"(%s) Tj" % w for w in words) + b" ET\n"


def test_two_columns_under_a_title_and_a_running_header(spark):
    title = b"A title that spans both of the columns of this page and more words to make it wide"
    made = []
    for n in range(3):
        left, right = ([b"%s%d of page %s" % (side, i, b"xyz"[n : n + 1]) for i in range(4)] for side in (b"left ", b"right "))
        # Right column first in the stream; header by a matrix; footer with a number.
        body = column(320, 700, right) + column(50, 700, left) + b"q 1 0 0 1 50 0 cm BT /F1 10 Tf 0 780 Td (Running) Tj ( header) Tj ET Q\n" + column(50, 30, [b"Page %d" % n])
        made.append(body + (column(50, 740, [title]) + column(50, 600, [b"a line below that spans both of the columns of this page, again a wide one, end"]) if n == 1 else b""))
    rows = spark.createDataFrame([("a", bytearray(pdf(made))), ("b", bytearray(b"no pdf")), ("c", None)], "path string, content binary")
    lines = pdfpages.page_lines(rows)
    got = {}
    for r in pdfpages.without_running(lines).orderBy("page", "line").collect():
        got.setdefault(r.page, []).append(r.text)
    both = lambda n: [f"{side} {i} of page {'xyz'[n]}" for side in ("left", "right") for i in range(4)]
    assert got[0] == both(0) and got[2] == both(2)
    assert got[1] == [title.decode(), *both(1), "a line below that spans both of the columns of this page, again a wide one, end"]
    whole = [r.text for r in lines.where("page = 0").orderBy("line").collect()]
    assert "Running header" in whole and "Page 0" in whole


def test_font_maps_kerning_and_escapes():
    cmap = zlib.compress(b"1 beginbfchar <0001> <00C9> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <D83DDE42>] endbfrange")
    file = pdf([b"BT /F2 10 Tf 1 0 0 1 10 100 Tm <0001001000110012> Tj ET BT /F2 10 Tf 10 80 Td <00200021> Tj ET BT /F1 10 Tf 10 60 Td [(one) -20 (s) -600 (two \\(x\\) \\101)] TJ ET"], b"<</Type/Font/Subtype/Type0/ToUnicode 5 0 R>>")
    file += b"5 0 obj\n<</Length %d/Filter/FlateDecode>>\nstream\n" % len(cmap) + cmap + b"\nendstream\nendobj\n"
    pieces = pdfpages.ordered(pdfpages.lines_of([s[1:] for s in pdfpages.spans(file)]))
    assert [p[4] for p in pieces] == ["Éabc", "x🙂", "ones two (x) A"]
    assert pdfpages.spans(formats.write_pdf(["plain (a) line", "next"]))[0][5] == "plain (a) line"
    assert pdfpages.spans(None) == [] and pdfpages.spans(b"%PDF-1.4 1 0 obj <</Type/Catalog>> endobj") == []


def test_a_large_brand_is_several_workbooks(spark, tmp_path, monkeypatch):
    import duckdb

    from pyspark.sql import functions as F

    from kbspark.plans import files as plans
    from kbspark.plans import registry
    from kbspark.sources import sinks

    monkeypatch.setattr(plans, "BOOK_ROWS", 20)
    write = sinks.xlsx_file
    monkeypatch.setattr(sinks, "xlsx_file", lambda name, rows: write(name, F.when(F.size(rows) <= 100, rows)))  # larger ones come out empty
    rows = [(i, f"n{i}", "big" if i % 10 else "small", i % 7) for i in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = registry.QUERIES["A08_xlsx_source"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.SQL["A08_xlsx_source"]).fetchall())
