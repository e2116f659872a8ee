"""Library functions on literal cases that the tables do not hold."""

import io
import json
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from kbspark.functions import rules as R
from kbspark.functions import tables as TB
from kbspark.functions import text as T
from kbspark.functions import values as V
from kbspark.operators import chunks, cluster, filters, pages, search
from kbspark.operators.diffs import line_diff
from kbspark.operators.skew import join_found
from kbspark.sources import files, formats, sinks


def one(spark, column, *rows, schema="text string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column).collect()]


# Chunks and layout
def brute_pack(elements, most):
    """Texts of the chunks that no title touches, one after another."""
    out, held = [], ""
    for text in elements:
        for piece in [text[i : i + most] for i in range(0, len(text), most)]:
            if held and len(held) + 1 + len(piece) > most:
                out.append(held)
                held = piece
            else:
                held = f"{held}\n{piece}" if held else piece
    return [*out, held] if held else out


def test_pack_keeps_every_character_and_the_limit():
    rng = random.Random(1)
    for _ in range(300):
        elements = [(rng.choice(["Title", "ListItem", "NarrativeText", "NarrativeText", "Table"]), "".join(rng.choices("ab ", k=rng.randrange(60))), i) for i in range(rng.randrange(12))]
        made = chunks.pack(elements, 40, 20)
        kept = "".join(t.strip() for k, t, _ in elements if k != "Table")
        assert "".join(c.content.replace("\n", "") for c in made) == kept
        assert all(len(c.content) <= 40 or c.is_parent for c in made)
        merged = chunks.merge_small(made, 40, 20)
        assert "".join(c.content.replace("\n", "") for c in merged) == kept and len(merged) <= len(made)
        assert all(len(c.content) <= 40 or c.is_parent for c in merged)
    short = ["abc", "de", "f" * 30, "g" * 9]
    assert [c.content for c in chunks.pack([("NarrativeText", t, i) for i, t in enumerate(short)], 20, 0)] != []
    assert [c.content for c in chunks.pack([("NarrativeText", t, i) for i, t in enumerate(["aa", "bb", "c" * 15])], 20, 5)] == brute_pack(["aa", "bb", "c" * 15], 20)


def test_pack_titles_and_gaps():
    made = chunks.pack([("NarrativeText", "x" * 30, 0), ("Title", "Head", 1), ("NarrativeText", "body", 2), ("NarrativeText", "more", 9), ("Header", "no", 10)], 100, 20)
    assert [(c.content, c.section, c.is_parent, c.first, c.last) for c in made] == [("x" * 30, 0, False, 0, 0), ("Head", 1, True, 1, 1), ("body\nmore", 1, False, 2, 9)]
    assert [c.content for c in chunks.pack([("NarrativeText", "ab", 0), ("Title", "T", 1)], 100, 20)] == ["ab\nT"]


def test_paragraphs_and_toc(spark):
    text = "one\ntwo  \n\n \nthree\n"
    assert [tuple(p) for p in one(spark, chunks.paragraphs(F.col("text")), text)[0]] == [(1, 2, "one\ntwo"), (5, 5, "three")]
    assert one(spark, chunks.is_toc(F.col("text")), "Table of Contents\nx", "a ..... 3\nb", "a\nb .... 3", "a\nb ... 1\nc .. 2", "", None) == [True, True, False, True, False, False]
    assert one(spark, chunks.is_toc_line(F.col("text")), "目录", "x ... 3", "x ... 3 y", " ", "") == [True, True, False, True, False]


def test_merge_tables(spark):
    kind = "array<struct<cells: array<array<string>>, left: double, top: double, right: double, bottom: double, page_width: double>>"
    rows = [([["h"], ["1"]], 0.0, 0.0, 10.0, 10.0, 100.0), ([["1"], ["2"]], 0.0, 12.0, 10.0, 20.0, 100.0), ([["far"]], 50.0, 12.0, 60.0, 20.0, 100.0)]
    got = spark.createDataFrame([(rows,)], f"t {kind}").select(chunks.merge_tables(F.col("t"))).first()[0]
    assert [(t.cells, t.bottom) for t in got] == [([["h"], ["1"], ["2"]], 20.0), ([["far"]], 20.0)]


def test_stream_chunks_equal_plain_cutting(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for d in range(5):
        held, counter = [], 0
        for i in range(12):
            kind = rng.choice(["text", "text", "text", "table"])
            text = " " + "".join(rng.choices("abc ", k=rng.randrange(40)))
            rows.append((d, i, kind, text))
            held.append(None if kind == "table" else text.strip())
        for island in "\n".join("\0" if h is None else h for h in held if h != "").split("\0"):
            whole = island.strip("\n")
            for piece in [whole[k : k + 25].strip() for k in range(0, len(whole), 25)]:
                if piece:
                    want[d, counter] = piece
                    counter += 1
    got = chunks.stream_chunks(spark.createDataFrame(rows, "doc_id long, element_index int, type string, text string"), 25).collect()
    assert {(r.doc_id, r.chunk_index): r.content for r in got} == want


# Tables
def test_tables(spark):
    rows = [["", ""], ["Name", "Age"], ["Ann", "31"], ["Bob", "4.5"]]
    cells = "t array<array<string>>"
    first = lambda c: spark.createDataFrame([(rows,)], cells).select(c).first()[0]
    t = F.col("t")
    assert first(TB.header_row(t)) == 1 and first(TB.numeric_columns(t)) == [] and first(TB.is_real(t)) is True
    assert first(TB.markdown(F.slice(t, 2, 2))) == "| Name | Age |\n| --- | --- |\n| Ann | 31 |"
    wide = [[str(i) if i % 5 == 0 else "x" if i < 12 else "" for i in range(22)]] * 3
    kept = spark.createDataFrame([(wide,)], cells).select(TB.kept_columns(t)).first()[0]
    assert kept == [*range(10), 10, 15, 20]
    assert spark.createDataFrame([([],)], cells).select(TB.markdown(t), TB.header_row(t), TB.is_real(t), TB.kept_columns(t)).first() == ("", None, False, [])
    assert one(spark, TB.split_rows(F.col("text")), "| a | b |\n|---|---|\n| 1 | 2 |\nplain") == [[["a", "b"], ["1", "2"]]]


# Files
def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_office_files(spark):
    book = zipped(
        xl__workbook_xml='<workbook><sheets><sheet name="S"/></sheets></workbook>', xl__sharedStrings_xml="<sst><si><t>head</t></si></sst>",
        xl__worksheets__sheet1_xml='<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="A2"/></row></sheetData></worksheet>',
    )
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    text = zipped(word__document_xml=f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    slides = zipped(ppt__slides__slide1_xml='<s xmlns:p="p"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><p:p><p:t>Title</p:t></p:p></p:sp><p:sp><p:p><p:t>body</p:t></p:p></p:sp></s>')
    stream = zlib.compress(b"BT (Hello \\(x\\)) Tj T* [(Wor) 2 (ld)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode>> stream\n" + stream + b"\nendstream endobj"
    rows = spark.createDataFrame([("a", bytearray(x)) for x in (book, text, slides, pdf, b"broken")], "path string, content binary")
    assert [(r.sheet, r.rows) for r in files.xlsx(rows).collect()] == [("S", [["head", "", "3"]])]
    assert [(r.type, r.style, r.text, r.cells) for r in files.docx(rows).collect()] == [("text", "Heading1", "Top", []), ("table", "", "", [["x"]])]
    assert [(r.title, r.body) for r in files.pptx(rows).collect()] == [("Title", "body")]
    assert [r.text for r in files.pdf(rows).collect()] == ["Hello (x)\nWorld"]


def test_text_files(tmp_path, spark):
    (tmp_path / "a.txt").write_bytes("﻿eins\r\nzwei".encode())
    (tmp_path / "b.txt").write_bytes("中文测试".encode("gb18030"))
    (tmp_path / "c.txt").write_bytes(b"")  # Spark lists no empty files
    got = {r.path[-5]: r.text for r in files.texts(files.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a": "eins\nzwei", "b": "中文测试"}


def test_markdown_csv_xml_json(spark):
    text = "# A\npara\nline\n\n## B\n- x\n  more\n1. y\n```py\ncode\n\n```\n> q\n| a | b |\n|---|---|\n\n# C #"
    got = [(e[0], e[1], e[3]) for e in formats.markdown_elements(text)]
    assert got == [("heading", "A", "A"), ("paragraph", "para\nline", "A"), ("heading", "B", "A > B"), ("list", "- x\n  more\n1. y", "A > B"), ("code", "code", "A > B"), ("quote", "q", "A > B"), ("table", "| a | b |\n|---|---|", "A > B"), ("heading", "C", "C")]
    assert formats.csv_rows('a;b\n\n"x;1";2') == [["a", "b"], ["x;1", "2"]] and formats.csv_rows(None) == []
    assert json.loads(formats.xml_tree('<a k="1"><b>x</b><b>y</b> t</a>')) == {"a": {"_attributes": {"k": "1"}, "b": ["x", "y"]}}
    assert formats.xml_tree("<a>") is None and formats.json_schema("[") is None
    assert json.loads(formats.json_schema('{"a": [1], "b": null}')) == {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "integer"}}, "b": {"type": "null"}}}
    assert files.csv_tables(spark.createDataFrame([("p", "")], "path string, text string")).collect()[0].rows == []


def test_upsert_and_batches(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, t long")
    new = spark.createDataFrame([(2, "c", 5), (2, "d", 4), (3, "e", 1)], "k long, v string, t long")
    assert sorted((r.k, r.v) for r in sinks.upsert(old, new, ["k"], F.col("t")).collect()) == [(1, "a"), (2, "c"), (3, "e")]
    assert spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>").select(sinks.batches(F.col("a"), 2)).collect() == [([[1, 2], [3]],), ([],)]


# Pages
def test_page_elements(spark):
    html = "<!DOCTYPE html><base href='/d/'><main><h1>A</h1><p>one <a href='x'>two</a></p><ol><li>p<ul><li>q</li></ul></li><li>r</li></ol><dl><dt>t</dt><dd>d</dd></dl><pre><code class='language-py'>f()\n  g</code></pre><table><tr><th>h</th><th>i</th></tr><tr><td>1</td></tr></table><div>loose<div>inner</div></div></main><form></form><img src='i.png'><script>no</script>"
    rows = spark.createDataFrame([(1, html, "http://h.o/p"), (2, None, None)], "page_id long, html string, url string")
    got = [(e.type, e.text, e.language) for e in pages.elements(rows).orderBy("element_index").collect()]
    assert got == [("heading", "A", ""), ("paragraph", "one two", ""), ("list", "1. p\n- q\n2. r", ""), ("list", "t : d", ""), ("code", "f()\n  g", "py"), ("table", "h | i\n1", ""), ("paragraph", "loose", ""), ("paragraph", "inner", ""), ("image", "i.png", "")]
    assert [(r.url, r.external) for r in pages.links(rows).collect()] == [("http://h.o/d/x", False)]
    fact = pages.facts(rows).orderBy("page_id").collect()
    assert (fact[0].version, fact[0].forms, fact[0].semantic, fact[1].headings) == ("HTML5", 1, "main", 0)
    assert pages.tables(rows).first().rows == [["h", "i"], ["1", ""]]


# Search, rules, values
def test_compatible_boolean(spark):
    ask = lambda q: one(spark, filters.compatible_query(q, T.tokens(F.col("text"))), "a", "a b", "c", "")
    assert ask("a AND b") == [False, True, False, False] and ask("b OR c") == [False, True, True, False]
    assert ask("a OR c NOT b") == [True, False, True, False] and ask("a and b") == [True, True, False, False]


def test_search_modes_and_empty(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, None)], "doc_id long, text string")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.doc_id for r in search.search(docs, rows, "red", [1.0, 0.0], "keyword").collect()] == [2, 1]
    assert [r.doc_id for r in search.search(docs, rows, "red", [1.0, 0.0], "vector", 1).collect()] == [1]
    assert [r.doc_id for r in search.search(docs, rows, "red dog", [1.0, 0.0], "exact").collect()] == [2]
    assert search.search(docs.limit(0), rows.limit(0), "red", [1.0, 0.0]).count() == 0
    with pytest.raises(ValueError):
        search.knn_join(spark.range(1001).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("q")), rows, 1)


def test_selectors_and_rules(spark):
    services = spark.createDataFrame([("n", "s", {"a": "1", "b": "2"}), ("n", "t", {}), ("n", "u", {"a": "1"})], "namespace string, service string, selector map<string, string>")
    pods = spark.createDataFrame([("n", "p", {"a": "1"}), ("n", "q", {"a": "1", "b": "2", "c": "3"}), ("m", "r", {"a": "1"})], "namespace string, pod string, labels map<string, string>")
    assert sorted((r.service, r.pod) for r in cluster.selected(services, pods).collect()) == [("s", "q"), ("u", "p"), ("u", "q")]
    assert cluster.expand("rate(x[{window}])", {"window": "5m"}) == "rate(x[5m])"
    with pytest.raises(ValueError, match="pod"):
        cluster.expand("{pod}", {})
    assert one(spark, R.is_error_line(F.col("text")), "a ERROR b", "NO ERROR here", "Caused by: x", "java.lang.X", "errors", None) == [True, False, True, True, True, False]
    assert one(spark, R.without_hedges(F.col("text"), F.lit(0.9)), "可能 坏了 也许") == ["坏了"]


def test_counter_rate_with_reset(spark):
    rows = spark.createDataFrame([(1, f"2024-01-01 00:0{i}:00", v) for i, v in enumerate([10.0, 20.0, 5.0, 8.0])], "id long, t string, value double").withColumn("ts", F.to_timestamp("t"))
    assert [r.rate for r in cluster.counter_rate(rows, "10 minutes", ["id"]).collect()] == [(10 + 5 + 3) / 600]


def test_values(spark):
    fixed = lambda t: V.repair_json(t)
    assert fixed('x ```json\n{"a": 1,}\n``` y') == '{"a": 1}' and fixed("so {'a': {b: [1,],}} z") == '{"a": {"b": [1]}}' and fixed("none") is None and fixed(None) is None and fixed('{"a": {"b": 1}') == '{"a": {"b": 1}}'
    assert one(spark, V.problem_summary(F.col("text")), "<think>x</think>**坏了** 服务器磁盘空间不足了", "短\nPod 重启", None) == ["坏了 服务器磁盘空间不足了", "Pod 重启", ""]
    assert one(spark, V.string_to_list(F.col("text")), "", "a,b") == [[], ["a", "b"]]
    assert one(spark, V.stem(F.col("text")), "a/b.tar.gz", ".env", "x") == ["b.tar", ".env", "x"]
    with pytest.raises(ValueError):
        V.hashed(F.col("x"), "crc")


def test_line_diff_rebuilds_both(spark):
    rng = random.Random(4)
    rows = [("\n".join(rng.choices("abcd", k=rng.randrange(8))), "\n".join(rng.choices("abcd", k=rng.randrange(8)))) for _ in range(40)] + [(None, "x")]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", line_diff("a", "b").alias("d")).collect():
        assert [x.content for x in r.d if x.type != "insert"] == (r.a or "").splitlines() and [x.content for x in r.d if x.type != "delete"] == (r.b or "").splitlines()
        assert [x.old_line for x in r.d if x.old_line] == list(range(1, len((r.a or "").splitlines()) + 1))


def test_lock_cache_lockout(spark):
    rows = spark.createDataFrame([("k", f"2024-01-01 00:{m:02d}:00", i) for i, m in enumerate([0, 5, 10, 12, 20])], "key string, t string, id long").withColumn("ts", F.to_timestamp("t"))
    assert {r.id: r.granted for r in cluster.claim(rows, 600).collect()} == {0: True, 1: False, 2: True, 3: False, 4: True}
    tries = spark.createDataFrame([(1, f"2024-01-01 00:{i:02d}:00", i, i in (2, 10)) for i in range(12)], "user_id long, t string, id long, ok boolean").withColumn("ts", F.to_timestamp("t"))
    assert [r.locked for r in R.lockouts(tries).orderBy("id").collect()] == [False] * 8 + [True] * 4


def test_join_found_splits_hot_keys(spark):
    rows = spark.createDataFrame([(7 if i % 2 else i, i) for i in range(400)], "k long, v long")
    found = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("m"))
    assert sorted(map(tuple, join_found(rows, found, ["k"], "n", shares=10).collect())) == sorted(map(tuple, rows.join(found.drop("n"), "k").collect()))


def test_term_counts_equal_tokens(spark):
    from kbspark.operators.retrieval import term_counts

    texts = ["the the cat", "The, THE! the-cat", "", None, "  the  ", "thé the_x 中文 the"]
    got = one(spark, term_counts(F.col("text"), ["the", "cat"]), *[(t,) for t in texts])
    words = [r or [] for r in one(spark, T.tokens(F.col("text")), *[(t,) for t in texts])]
    assert [(r.dl or 0, r.tf0 or 0, r.tf1 or 0) for r in got] == [(len(w), w.count("the"), w.count("cat")) for w in words]


def test_short_numbers_fuzzy_terms_similarity(spark):
    import difflib

    from kbspark.operators.diffs import similarity

    rows = spark.createDataFrame([(999.0,), (1500.0,), (2_500_000.0,), (3e9,), (-5.0,)], "n double")
    assert [r[0] for r in rows.select(T.format_number(F.col("n"))).collect()] == ["999", "1.5K", "2.5M", "3.0B", "-5"]
    near = lambda term: one(spark, search.fuzzy(T.tokens(F.col("text")), term), "ab there", "ac thier", "theer abc")
    assert near("ab") == [True, False, False] and near("there") == [True, False, False] and near("thiere") == [True, True, True]
    rng = random.Random(9)
    pairs = [("".join(rng.choices("abc ", k=rng.randrange(30))), "".join(rng.choices("abc ", k=rng.randrange(30)))) for _ in range(60)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(similarity("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_office_writers_are_read_back(spark):
    rows = spark.createDataFrame([("x", [["a & b", "", "<c>"], ["1", "2", "3"]], ["one\x00", "two (x)"])], "path string, r array<array<string>>, p array<string>")
    assert files.xlsx(rows.select("path", sinks.xlsx_file(F.lit("S"), F.col("r")).alias("content"))).first().rows == [["a & b", "", "<c>"], ["1", "2", "3"]]
    assert [e.text for e in files.docx(rows.select("path", sinks.docx_file(F.lit("T"), F.col("p")).alias("content"))).collect()] == ["T", "one", "two (x)"]
    assert files.pdf(rows.select("path", sinks.pdf_file(F.array(F.lit("a (b) \\ c"), F.lit("d"))).alias("content"))).first().text == "a (b) \\ c\nd"


def test_folds_follow_order_whatever_the_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4) or None, i, f"2024-01-01 {rng.randrange(24):02d}:{rng.randrange(60):02d}:00") for i in range(300)]
    asked = spark.createDataFrame(rows, "key long, id long, t string").withColumn("ts", F.to_timestamp("t"))
    got = {r.id: (r.granted, r.limited) for r in cluster.limited(cluster.claim(asked.repartition(7), 1800), 2, 3600).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        until = begun = None
        n = 0
        for _, i, t in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            at = int(t[11:13]) * 60 + int(t[14:16])
            granted = until is None or at >= until
            until = at + 30 if granted else until
            begun, n = (at, 1) if begun is None or at >= begun + 60 else (begun, n + 1)
            want[i] = (granted, n > 2)
    assert got == want
    assert cluster.claim(asked.limit(0)).count() == 0


def test_knn_join_scores_tiles_as_the_column_does(spark, monkeypatch):
    from pyspark.sql import Window as W

    from kbspark.operators.retrieval import cosine

    monkeypatch.setattr(search, "SHARD_ROWS", 40)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 7)
    rng = random.Random(3)
    vectors = [[rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)] for _ in range(150)] + [[0.0] * 3, [float("nan"), 1.0, 0.0], None, [1.0, None, 2.0]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    asked = rows.where("vec_id % 5 = 0 or vec_id > 148").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    scored = asked.crossJoin(rows).select("query_id", "vec_id", cosine(F.col("embedding"), F.col("q")).alias("score"))
    key = lambda r: (r.query_id, r.rank, r.vec_id, str(r.score))
    for few, k in ((rows, 5), (rows.where("vec_id > 148"), 4)):
        best = scored.join(few.select("vec_id"), "vec_id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        got = search.knn_join(asked, few, k)
        assert sorted(map(key, got.collect())) == sorted(map(key, best.collect()))
        if few is rows:  # a null query alone meets rows outside the tiles
            assert "BroadcastNestedLoopJoin" not in search.knn_join(asked.where("query_id < 100"), few, k)._jdf.queryExecution().executedPlan().toString()


def test_short_numbers_beyond_the_tables(spark, tmp_path):
    import duckdb

    from kbspark.plans import registry

    keys = [1, 1003, 999_999, 1_003_009, 1_003_010, 5_000_001, 36_000_003]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = registry.QUERIES["I19_short_number"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.SQL["I19_short_number"]).fetchall())


def test_html_titles_with_open_references(spark, tmp_path):
    import duckdb

    from kbspark.plans import registry

    titles = ["a &amp; b", "a &amp", "a &amp;amp", "&lt;b&gt; &amp;&amp", "x & y", "R&D &lt", "&amp;#x27;"]
    spark.createDataFrame([(i, f"<body><h1>{t}</h1><p>one</p><p>two</p></body>") for i, t in enumerate(titles)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.QUERIES["A05_html_source"](spark, str(tmp_path)).collect()
    assert sorted((int(r.page_id), r.title, r.paragraphs) for r in got) == sorted(con.sql(registry.SQL["A05_html_source"]).fetchall())


def test_rules_by_row_hold_few_rows_at_once():
    """Of a batch of many rows only a slice becomes Python objects before its results leave."""
    import pyarrow as pa

    from kbspark.operators import batches

    texts = pa.array(["x" * 5000] * 1000)
    sizes = [len(p[0]) for p in batches.pieces(texts)]
    assert sum(sizes) == 1000 and max(sizes) <= batches.ROWS
    big = pa.array(["y" * batches.BYTES, "z", None, "w" * 2 * batches.BYTES])
    assert [len(p[0]) for p in batches.pieces(big)][0] == 1 and [x for p in batches.pieces(big) for x in p[0].to_pylist()] == big.to_pylist()


def test_rules_by_row_are_what_the_plain_rule_gives(spark):
    from kbspark.operators.batches import by_row

    rows = spark.range(300, numPartitions=1).select("id", F.when(F.col("id") % 7 > 0, F.array(F.struct(F.col("id").cast("string").alias("t"), (F.col("id") % 2 == 0).alias("b")))).alias("l"))
    rule = by_row(lambda i, l: None if l is None else [(t * 2, b, [i]) for t, b in l], "array<struct<t: string, b: boolean, n: array<long>>>")
    got = {r.id: r.x for r in rows.select("id", rule("id", "l").alias("x")).collect()}
    assert len(got) == 300 and all(got[i] == (None if i % 7 == 0 else [(str(i) * 2, i % 2 == 0, [i])]) for i in got)


def test_index_carried_on_tokenises_only_what_came(spark, tmp_path, monkeypatch):
    """Postings of chunks that stay are those of the old index, marked here; the new ones replace those of their chunks."""
    from kbspark.sources import sinks

    docs = spark.createDataFrame([(1, "s", "red red fox"), (2, "s", "red dog"), (3, "t", None)], "chunk_id long, source string, content string")
    first, second = (str(tmp_path / x) for x in ("a", "b"))
    sinks.write_index(docs, first)
    found = {(r.term, r.doc_id, r.tf) for r in spark.read.parquet(f"{first}/postings").collect()}
    assert found == {("red", 1, 2), ("fox", 1, 1), ("red", 2, 1), ("dog", 2, 1)}
    seen, inner = [], sinks.chunk_postings
    monkeypatch.setattr(sinks, "chunk_postings", lambda d: seen.extend(r.chunk_id for r in d.select("chunk_id").collect()) or inner(d))
    sinks.write_index(docs.where("chunk_id = 2").selectExpr("chunk_id", "source", "'new cat cat' AS content"), second, first)
    found = {(r.term, r.doc_id, r.tf) for r in spark.read.parquet(f"{second}/postings").collect()}
    assert found == {("red", 1, 2), ("fox", 1, 1), ("new", 2, 1), ("cat", 2, 2)} and seen == [2]
    assert {(r.doc_id, r.dl) for r in spark.read.parquet(f"{second}/doc_len").collect()} == {(1, 3), (2, 3)}
