"""Sources of files and of captured service answers, as DataFrames.

Files come as rows ``(path, content)`` of ``spark.read.format("binaryFile")``, which leaves out empty
ones; each is parsed where it lies. Answers of services come as rows with one JSON text; built-in functions take them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import tables as TB
from kbspark.operators.batches import by_row
from kbspark.sources import formats

ELEMENT = "struct<type: string, text: string, level: int, path: string, language: string, line_start: int, line_end: int>"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")


def text_of(content: Column) -> Column:
    """Decoded text without byte order mark, with ``\\n`` as line end."""
    return by_row(formats.decode, "string")(content)


def texts(files: DataFrame) -> DataFrame:
    return files.select("path", text_of(F.col("content")).alias("text"))


def markdown(texts: DataFrame) -> DataFrame:
    """``(path, element_index, type, text, level, path_of_headings, language, lines)``."""
    parsed = by_row(formats.markdown_elements, f"array<{ELEMENT}>")(F.col("text"))
    found = texts.select("path", F.posexplode(parsed).alias("element_index", "e"))
    return found.select("path", "element_index", "e.type", "e.text", "e.level", F.col("e.path").alias("heading_path"), "e.language", "e.line_start", "e.line_end")


def csv_tables(texts: DataFrame) -> DataFrame:
    """``(path, header, names, rows)``: the place of the header row, its cells and the rows behind it.
    Without a header columns are named by number."""
    seen = texts.select("path", by_row(formats.csv_rows, "array<array<string>>")(F.col("text")).alias("all"))
    seen = seen.withColumn("header", TB.header_row(F.col("all")))
    numbered = F.transform(F.when(TB.width(F.col("all")) > 0, F.sequence(F.lit(1), TB.width(F.col("all")))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("column_"), i.cast("string")))
    names = F.when(F.col("header").isNull(), numbered).otherwise(F.get("all", F.col("header").cast("int")))
    begin = F.coalesce(F.col("header") + 2, F.lit(1)).cast("int")
    return seen.select("path", "header", names.alias("names"), F.slice("all", begin, F.greatest(F.size("all") - begin + 1, F.lit(0))).alias("rows"))


def xlsx(files: DataFrame) -> DataFrame:
    """A row for each sheet in the workbook's order, with its numbers of merged ranges, formulas and images."""
    flags = "struct<merged: int, formulas: int, images: int>"
    sheets = by_row(formats.xlsx_sheets, f"array<struct<sheet: string, rows: array<array<string>>, flags: {flags}>>")
    return files.select("path", F.posexplode(sheets("content")).alias("sheet_index", "s")).select("path", "sheet_index", "s.sheet", "s.rows", "s.flags.*")


def docx(files: DataFrame) -> DataFrame:
    parsed = by_row(formats.docx_elements, "array<struct<type: string, style: string, text: string, cells: array<array<string>>>>")
    return files.select("path", F.posexplode(parsed("content")).alias("element_index", "e")).select("path", "element_index", "e.*")


def pptx(files: DataFrame) -> DataFrame:
    """A row for each slide in the deck's order, with its speaker's notes and tables."""
    parsed = by_row(formats.pptx_slides, "array<struct<title: string, body: string, notes: string, tables: array<array<array<string>>>>>")
    return files.select("path", F.posexplode(parsed("content")).alias("slide", "s")).select("path", "slide", "s.*")


def pdf(files: DataFrame) -> DataFrame:
    parsed = by_row(formats.pdf_texts, "array<string>")
    return files.select("path", F.posexplode(parsed("content")).alias("page", "text"))


def slide_text(shapes: Column) -> Column:
    """``struct<title, body>`` of an array of ``struct<text, is_title>``."""
    return by_row(formats.slide_texts, "struct<title: string, body: string>")(shapes)


def preview(name: Column, text: Column) -> Column:
    """The nested form of a JSON or XML text as JSON, null for others and where it is malformed."""
    kind = structured_type(name, text)
    tree = by_row(formats.xml_tree, "string")
    return F.when(kind == "json", F.when(F.try_parse_json(text).isNotNull(), text)).when(kind == "xml", tree(text))


def structured_type(name: Column, text: Column) -> Column:
    """json, xml or csv by the file's ending; a .txt by its first 1024 characters; else null."""
    ending, head = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), F.trim(F.regexp_replace(F.substring(text, 1, 1024), r"^\s+", ""))
    sniffed = F.when(head.rlike(r"^[\[{]"), "json").when(head.rlike(r"^<(\?xml|[A-Za-z])"), "xml")
    return F.when(ending.isin("json", "xml", "csv"), ending).when(ending == "txt", sniffed)


def json_schema(text: Column) -> Column:
    """The JSON schema of a text: types, properties, and items by the first element."""
    return by_row(formats.json_schema, "string")(text)


# Answers of services
def metrics(answers: DataFrame, column: str = "body") -> DataFrame:
    """``(metric, ts, value)`` of range and instant query answers; values that are no number are null."""
    series = "struct<metric: map<string, string>, values: array<array<string>>, value: array<string>>"
    parsed = F.from_json(F.col(column), f"struct<data: struct<result: array<{series}>>>")
    each = answers.select(F.explode(parsed["data"]["result"]).alias("s"))
    points = each.select("s.metric", F.explode(F.coalesce("s.values", F.array("s.value"))).alias("p"))
    return points.select("metric", F.timestamp_micros((F.col("p")[0].cast("double") * 1_000_000).cast("long")).alias("ts"), F.col("p")[1].try_cast("double").alias("value"))


def search_hits(answers: DataFrame, source: str, column: str = "body") -> DataFrame:
    """The fields ``source``, as DDL, of the hits of search answers, with id and score."""
    hit = f"struct<_id: string, _score: double, _source: struct<{source}>>"
    parsed = F.from_json(F.col(column), f"struct<hits: struct<hits: array<{hit}>>>")
    return answers.select(F.explode(parsed["hits"]["hits"]).alias("h")).select("h._id", "h._score", "h._source.*")


def log_streams(answers: DataFrame, column: str = "body") -> DataFrame:
    """``(labels, ts, line)`` of log stream answers; times are nanoseconds, cut to microseconds."""
    stream = "struct<stream: map<string, string>, values: array<array<string>>>"
    parsed = F.from_json(F.col(column), f"struct<data: struct<result: array<{stream}>>>")
    each = answers.select(F.explode(parsed["data"]["result"]).alias("s")).select(F.col("s.stream").alias("labels"), F.explode("s.values").alias("v"))
    return each.select("labels", F.timestamp_micros(F.floor(F.col("v")[0].cast("decimal(38,0)") / 1000).cast("long")).alias("ts"), F.col("v")[1].alias("line"))


ITEM = "struct<metadata: struct<uid: string, name: string, namespace: string, resourceVersion: string, labels: map<string, string>>>"


def resources(answers: DataFrame, column: str = "body") -> DataFrame:
    """``(list_version, uid, name, namespace, resource_version, labels)`` of list answers."""
    parsed = F.from_json(F.col(column), f"struct<metadata: struct<resourceVersion: string>, items: array<{ITEM}>>")
    each = answers.select(parsed.alias("p")).select(F.col("p.metadata.resourceVersion").alias("list_version"), F.explode("p.items").alias("i"))
    return each.select("list_version", *_item(F.col("i")))


def watch_lines(rows: DataFrame, column: str = "value") -> DataFrame:
    """``(change, uid, name, ...)`` of line-delimited change events, batch or stream; events without uid go."""
    parsed = F.from_json(F.col(column), f"struct<type: string, object: {ITEM}>")
    each = rows.select(parsed.alias("p")).where(F.col("p.object.metadata.uid").isNotNull())
    return each.select(F.lower("p.type").alias("change"), *_item(F.col("p.object")))


def _item(i: Column) -> list[Column]:
    m = i["metadata"]
    return [m["uid"].alias("uid"), m["name"].alias("name"), m["namespace"].alias("namespace"), m["resourceVersion"].alias("resource_version"), m["labels"].alias("labels")]


def alerts(answers: DataFrame, column: str = "body") -> DataFrame:
    """``(cluster_id, pod, status)`` of alert hooks; alerts without cluster or pod go."""
    parsed = F.from_json(F.col(column), "struct<alerts: array<struct<status: string, labels: map<string, string>>>>")
    each = answers.select(F.explode(parsed["alerts"]).alias("a"))
    pod = F.coalesce(F.col("a.labels")["pod"], F.col("a.labels")["pod_name"])
    found = each.select(F.col("a.labels")["cluster_id"].alias("cluster_id"), pod.alias("pod"), F.col("a.status").alias("status"))
    return found.where(F.col("cluster_id").isNotNull() & F.col("pod").isNotNull())


def web_results(answers: DataFrame, most: int = 10, column: str = "body") -> DataFrame:
    """``(query, rank, title, url, source)`` of captured search answers: results without address go, the
    title defaults to it, the source is its host, and the first ``most`` stay."""
    parsed = F.from_json(F.col(column), "struct<query: string, results: array<struct<title: string, url: string>>>")
    good = F.slice(F.filter(parsed["results"], lambda r: F.coalesce(r["url"], F.lit("")) != ""), 1, most)
    each = answers.select(parsed["query"].alias("query"), F.posexplode(good).alias("at", "r"))
    return each.select("query", (F.col("at") + 1).alias("rank"), F.coalesce(F.nullif("r.title", F.lit("")), "r.url").alias("title"), "r.url", F.try_parse_url("r.url", F.lit("HOST")).alias("source"))
