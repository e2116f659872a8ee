"""Queries on tables, layout, chunks and diffs of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.functions import tables as TB
from kbspark.operators import chunks
from kbspark.plans.native import doc, on, query
from kbspark.sources.tables import load

#: DuckDB's form of the rows of a text that has the separator, and of cell tests.
ROWS = r"""list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|') AND NOT regexp_matches(x, '^\s*[|]?[\s:|-]*-[\s:|-]*$')),
    lambda x: list_transform(string_split(regexp_replace(trim(x, ' '), '^[|]|[|]$', '', 'g'), '|'), lambda c: trim(c, ' ')))"""
TABLES = f"SELECT * FROM (SELECT doc_id, {ROWS} AS r FROM documents) WHERE len(r) > 0"
WIDE = f"SELECT doc_id, r, list_max(list_transform(r, lambda x: len(x))) AS w FROM ({TABLES})"
NUMERIC = "coalesce(regexp_matches(regexp_replace({}, '[.-]', '', 'g'), '^[0-9]+$'), false)"


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with rows that have a separator, as ``(doc_id, r)``."""
    found = load(spark, sf_dir, "documents").select("doc_id", TB.split_rows(doc()).alias("r"))
    return found.where(F.size("r") > 0)


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda x: F.array_join(x, "\t")), "\n")


@query("D13_table_extraction", f"SELECT doc_id, len(r) AS n_rows, w AS n_cols, md5(array_to_string(list_transform(r, lambda x: array_to_string(list_concat(x, list_transform(range(w - len(x)), lambda i: '')), chr(9))), chr(10))) AS h FROM ({WIDE})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).select("doc_id", F.size("r").cast("long").alias("n_rows"), TB.width(F.col("r")).cast("long").alias("n_cols"), F.md5(_joined(TB.padded(F.col("r")))).alias("h"))


@query("D14_markdown_render", f"""SELECT doc_id, md5('| ' || array_to_string(list_concat(p[1:1], [list_transform(range(w), lambda i: '---')], p[2:]).list_transform(lambda x: array_to_string(x, ' | ')), ' |' || chr(10) || '| ') || ' |') AS h
    FROM (SELECT doc_id, w, list_transform(r, lambda x: list_concat(x, list_transform(range(w - len(x)), lambda i: ''))) AS p FROM ({WIDE}))""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).select("doc_id", F.md5(TB.markdown(F.col("r"))).alias("h"))


@query("D15_header_row", f"""
    WITH s AS (SELECT doc_id, list_transform(r[1:5], lambda x: CASE WHEN len(list_filter(x, lambda c: c <> '')) > 0 THEN
      len(list_filter(x, lambda c: c <> '')) / len(x) * 0.6 + len(list_filter(x, lambda c: c <> '' AND NOT {NUMERIC.format('c')})) / len(x) * 0.4 END) AS k FROM ({TABLES}))
    SELECT doc_id, CASE WHEN list_max(k) > 0.5 THEN CAST(list_position(k, list_max(k)) - 1 AS BIGINT) END AS header FROM s""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).select("doc_id", TB.header_row(F.col("r")).cast("long").alias("header"))


#: Sheets: the rows of a brand with the part's number, name, size, price and a date made of its number.
SHEET = """SELECT p_brand, list([CAST(p_partkey AS VARCHAR), p_name, CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'x1' END, '2024-01-' || lpad(CAST(p_partkey % 40 AS VARCHAR), 2, '0')] ORDER BY p_partkey) AS r FROM part GROUP BY p_brand"""


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("p_partkey") % 40).cast("string"), 2, "0"))
    cells = F.array(F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise("x1"), day)
    grouped = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("c")))).alias("s"))
    return grouped.select("p_brand", F.transform("s", lambda x: x["c"]).alias("r"))


def _places(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda j: j.cast("string")), ",")


@query("D16_numeric_column_places", f"SELECT p_brand, array_to_string(list_filter(range(5), lambda j: len(list_filter(r[1:100], lambda x: {NUMERIC.format('x[j + 1]')})) > len(r) * 0.5), ',') AS places FROM ({SHEET})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets(spark, sf_dir).select("p_brand", _places(TB.numeric_columns(F.col("r"))).alias("places"))


@query("D17_datetime_columns", f"SELECT p_brand, array_to_string(list_filter(range(5), lambda j: len(list_filter(r[1:100], lambda x: regexp_matches(x[j + 1], '{TB.ISO_TIME}') AND TRY_CAST(substring(x[j + 1], 1, 10) AS DATE) IS NOT NULL)) > len(r) * 0.3), ',') AS places FROM ({SHEET})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets(spark, sf_dir).select("p_brand", _places(TB.datetime_columns(F.col("r"))).alias("places"))


@query("D21_real_table", f"""
    SELECT doc_id, coalesce(len(r) > 1 AND w >= 2 AND full_rows >= 2 AND n >= 4 AND m <= 100 AND ((len(r) >= 3 AND m < 50) OR m < 30 OR short / n >= 0.6), false) AS is_real FROM (
      SELECT doc_id, r, w, len(list_filter(r, lambda x: len(list_filter(x, lambda c: c <> '')) > 0)) AS full_rows, len(k) AS n, list_avg(k) AS m, len(list_filter(k, lambda v: v < 20)) AS short
      FROM (SELECT doc_id, r, w, list_filter(list_transform(flatten(r), lambda c: length(c)), lambda v: v > 0) AS k FROM ({WIDE})))""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).select("doc_id", TB.is_real(F.col("r")).alias("is_real"))


@query("D34_kept_columns", f"""
    SELECT doc_id, array_to_string(CASE WHEN w <= 20 THEN range(w) ELSE list_concat(b, list_filter(z, lambda j: NOT list_contains(b, j))) END, ',') AS places FROM (
      SELECT doc_id, w, list_filter(range(w), lambda j: len(list_filter(r[1:100], lambda x: {NUMERIC.format('x[j + 1]')})) > len(r) * 0.5) AS z,
        list_transform(list_sort(list_transform(range(w), lambda j: [-len(list_filter(r, lambda x: coalesce(x[j + 1] <> '', false))), j]))[1:10], lambda s: s[2]) AS b FROM ({WIDE}))""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).select("doc_id", _places(TB.kept_columns(F.col("r"))).alias("places"))


on("D60_sheet_layout", "part", "SELECT p_partkey, CASE WHEN p_size = 7 OR p_partkey % 11 = 0 OR p_retailprice > 1800 OR (p_size < 10 AND length(p_name) > 20) THEN 'layout' ELSE 'tabular' END AS layout FROM part",
    lambda: ["p_partkey", TB.layout(F.col("p_size") == 7, F.when(F.col("p_partkey") % 11 == 0, 1).otherwise(0), F.lit(0), F.when(F.col("p_retailprice") > 1800, 51).otherwise(8), F.col("p_size"), F.when(F.length("p_name") > 20, 6).otherwise(5)).alias("layout")])


# Paragraphs, headings, chunks
@query("D23_paragraphs", r"""
    WITH l AS (SELECT conv_id, turn, list_transform(string_split(regexp_replace(text, '[.] ', '.' || chr(10) || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '\s+$', '')) AS k FROM conversations),
    e AS (SELECT conv_id, turn, unnest(k) AS x, unnest(range(len(k))) + 1 AS i FROM l),
    g AS (SELECT *, count(*) FILTER (WHERE trim(x, ' ') = '') OVER (PARTITION BY conv_id, turn ORDER BY i) AS island FROM e)
    SELECT conv_id, turn, min(i) AS line_start, max(i) AS line_end, md5(trim(string_agg(x, chr(10) ORDER BY i), ' ')) AS h FROM g WHERE trim(x, ' ') <> '' GROUP BY conv_id, turn, island""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.regexp_replace(doc(), "[.] ", ".\n\n")
    found = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(chunks.paragraphs(apart)).alias("p"))
    return found.select("conv_id", "turn", F.col("p.line_start").cast("long").alias("line_start"), F.col("p.line_end").cast("long").alias("line_end"), F.md5("p.content").alias("h"))


on("D20_toc_page", "documents", r"""
    SELECT doc_id, coalesce(regexp_matches(lower(replace(k[1], ' ', '')), '^(目录|tableofcontents)') OR len(list_filter(k, lambda x: regexp_matches(x, '[.·…]{2,}\s*[0-9]+'))) >= 2 OR regexp_matches(k[1], '[.·…]{2,}\s*[0-9]+'), false) AS is_toc
    FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: trim(x, ' ')), lambda x: x <> '') AS k FROM documents)""", lambda: ["doc_id", chunks.is_toc(doc()).alias("is_toc")])  # fmt: skip
on("D58_docx_category", "part", "SELECT p_partkey, CASE WHEN starts_with(lower(p_type), 'heading') OR contains(lower(p_type), 'title') OR contains(lower(p_type), '标题') THEN 'Title' ELSE 'NarrativeText' END AS category FROM part", lambda: ["p_partkey", chunks.category(F.col("p_type"), F.col("p_name")).alias("category")])
on("D59_toc_line", "conversations", r"SELECT conv_id, turn, text <> '' AND (trim(text, ' ') = '' OR regexp_matches(lower(trim(text, ' ')), '^(目录|table of contents)') OR regexp_matches(trim(text, ' '), '[.·…]{2,}\s*[0-9]+$')) AS is_toc FROM conversations", lambda: ["conv_id", "turn", chunks.is_toc_line(doc()).alias("is_toc")])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as elements: their lines that are not blank, those with cells as tables."""
    found = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("element_index", "text"))
    return found.where(F.trim("text") != "").withColumn("type", F.when(F.contains("text", F.lit("|")), "table").otherwise("text"))


@query("D29_stream_chunks", r"""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS k FROM documents),
    e AS (SELECT doc_id, unnest(k) AS text, unnest(range(len(k))) AS i FROM l),
    g AS (SELECT doc_id, i, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, contains(text, '|') AS tab FROM e WHERE trim(text, ' ') <> ''),
    s AS (SELECT *, count(*) FILTER (WHERE tab) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
    o AS (SELECT doc_id, island, i, t, sum(length(t) + 1) OVER (PARTITION BY doc_id, island ORDER BY i) - length(t) - 1 AS beg FROM s WHERE NOT tab AND t <> ''),
    w AS (SELECT doc_id, island, string_agg(t, chr(10) ORDER BY i) AS whole, list({'i': i, 'beg': beg} ORDER BY i) AS starts FROM o GROUP BY doc_id, island),
    c AS (SELECT doc_id, island, starts, unnest(range(0, length(whole), 1000)) AS cut, whole FROM w),
    p AS (SELECT doc_id, island, cut, regexp_replace(substring(whole, cut + 1, 1000), '^\s+|\s+$', '', 'g') AS content, list_last(list_filter(starts, lambda x: x.beg <= cut)).i AS first FROM c),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY island, cut) - 1 AS chunk_index FROM p WHERE content <> '')
    SELECT doc_id, first * 1000 + chunk_index AS pos, chunk_index, md5(content) AS h FROM n""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.stream_chunks(lines(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk_index", F.md5("content").alias("h"))


def _elements() -> Column:
    """The lines of a document as ``struct<category, text, place>``; short ones without a stop are titles."""
    each = lambda x, i: F.struct(F.when((F.length(x) < 60) & ~x.rlike(r"[.,;]\s*$"), "Title").when(x.rlike(r"^\s*[-*] "), "ListItem").otherwise("NarrativeText").alias("category"), x.alias("text"), i.alias("place"))
    return F.transform(F.split(doc(), "\n"), each)


@query("D27_structure_chunks")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks.structure_chunks(_elements(), merge=False)).alias("chunk_index", "c"))
    return found.select("doc_id", "chunk_index", "c.first", "c.last", "c.section", "c.is_parent", F.md5("c.content").alias("h"))


@query("D28_merged_chunks")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks.structure_chunks(_elements())).alias("chunk_index", "c"))
    return found.select("doc_id", "chunk_index", "c.first", "c.last", "c.section", "c.is_parent", F.md5("c.content").alias("h"))


#: Page items: each turn of a conversation cut to 40 letters, at a place that its number gives.
@query("D22_short_text_merge", r"""
    WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, substring(text, 1, 40) AS t, (turn * 7 % 10) / 10 AS l, (turn * 7 % 10) / 10 + 0.7 AS r FROM conversations),
    m AS (SELECT conv_id, i, 1 AS g, t, l, r FROM p WHERE i = 1
      UNION ALL SELECT p.conv_id, p.i, CASE WHEN ok THEN m.g ELSE m.g + 1 END, CASE WHEN ok THEN regexp_replace(m.t || ' ' || p.t, '^\s+|\s+$', '', 'g') ELSE p.t END, CASE WHEN ok THEN least(m.l, p.l) ELSE p.l END, CASE WHEN ok THEN greatest(m.r, p.r) ELSE p.r END
      FROM m JOIN p ON p.conv_id = m.conv_id AND p.i = m.i + 1, LATERAL (SELECT p.t <> '' AND m.t <> '' AND length(m.t) <= 60 AND length(p.t) <= 60 AND abs(m.r - p.l) <= 0.05 AS ok))
    SELECT conv_id, g - 1 AS place, arg_max(t, i) AS text FROM m GROUP BY conv_id, g""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.col("turn") * 7 % 10 / 10
    item = F.struct("turn", F.substring("text", 1, 40).alias("text"), left.alias("left"), (left + 0.7).alias("right"), F.lit(1.0).alias("page_width"))
    pages = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    few = F.transform("items", lambda x: F.struct(*[x[c] for c in ("text", "left", "right", "page_width")]))
    return pages.select("conv_id", F.posexplode(chunks.merge_short(few)).alias("place", "m")).select("conv_id", F.col("place").cast("long").alias("place"), "m.text")


@query("D26_toc_tree", """
    WITH h AS (SELECT conv_id, turn AS pos, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS lvl FROM conversations),
    t AS (SELECT a.conv_id, a.pos, max(b.pos) AS parent FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id AND b.pos < a.pos AND b.lvl < a.lvl GROUP BY ALL)
    SELECT t.conv_id, t.pos, coalesce((SELECT string_agg(k.pos, ',' ORDER BY k.pos) FROM t k WHERE k.conv_id = t.conv_id AND k.parent = t.pos), '') AS children FROM t""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    tree = chunks.toc_tree(load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), level.alias("level")), "conv_id")
    return chunks.toc_children(tree, "conv_id").select("conv_id", "pos", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"))


@query("C19_table_reassembly", """
    WITH parts AS (SELECT p_brand, CAST(floor((rn - 1) / 40) AS BIGINT) AS part_index, list(p_name ORDER BY p_partkey) AS cells
      FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) GROUP BY ALL),
    whole AS (SELECT p_brand, flatten(list(cells ORDER BY part_index)) AS cells FROM parts GROUP BY p_brand)
    SELECT c.p_partkey, len(w.cells) AS n_rows, md5(array_to_string(w.cells, ',')) AS h FROM part c JOIN whole w USING (p_brand) WHERE c.p_size = 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits name a table's group in their meta; its stored parts are put together in order."""
    part = load(spark, sf_dir, "part")
    number = F.floor((F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1) / 40)
    stored = part.select(F.col("p_brand").alias("group_uid"), "p_partkey", "p_name", number.alias("part_index"))
    stored = stored.groupBy("group_uid", "part_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda c: c["p_name"]).alias("cells"))
    hits = part.where("p_size = 1").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("table_group_uid"))).alias("meta"))
    asked = hits.withColumn("group_uid", F.get_json_object("meta", "$.table_group_uid"))
    wanted = stored.join(asked.select("group_uid").distinct(), "group_uid", "left_semi")
    whole = wanted.groupBy("group_uid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part_index", "cells"))), lambda c: c["cells"])).alias("cells"))
    return asked.join(whole, "group_uid").select("p_partkey", F.size("cells").cast("long").alias("n_rows"), F.md5(F.array_join("cells", ",")).alias("h"))
