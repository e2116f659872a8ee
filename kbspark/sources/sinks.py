"""Sinks: chunk archives, index tables with upserts, and exports. All write from the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.functions.text import counted_terms
from kbspark.operators.batches import by_row
from kbspark.sources import formats


def write_archive(chunks: DataFrame, path: str) -> None:
    """One gzipped JSON line for each chunk."""
    chunks.write.mode("overwrite").option("compression", "gzip").json(path)


def read_archive(spark: SparkSession, path: str, schema: str, index: int | None = None) -> DataFrame:
    """Chunks of an archive; with ``index`` those whose ``index``, or else ``chunk_index``, is this."""
    names = {f.split()[0] for f in schema.split(", ")}
    found = spark.read.schema(schema).json(path)
    if index is None:
        return found
    return found.where(F.coalesce(*[F.col(c) for c in ("index", "chunk_index") if c in names]) == index)


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], newest: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys; of several new rows of a key
    the one with the greatest ``newest`` stays, by all columns where that ties."""
    others = [c for c in new.columns if c not in keys]
    rest = F.struct(*([newest.alias("newest_")] if newest is not None else []), *others)
    last = new.groupBy(*keys).agg(F.max(rest).alias("r")).select(*keys, *[f"r.{c}" for c in others])
    return last if old is None else old.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*old.columns))


def chunk_postings(chunks: DataFrame) -> DataFrame:
    """``(term, doc_id, tf)`` of chunks with one row each: counted where they lie, nothing is shuffled."""
    found = chunks.select(F.col("chunk_id").alias("doc_id"), F.explode(counted_terms(F.lower("content"))).alias("t"))
    return found.select("t.term", "doc_id", F.col("t.n").alias("tf"))


def write_index(chunks: DataFrame, path: str, old: str | None = None, part: str = "source") -> None:
    """The tables ``chunks``, ``postings`` and ``doc_len`` of the search index, split by ``part``, and
    ``stats``; with ``old``, the index there is carried on and rows of equal ``chunk_id`` replaced."""
    spark = chunks.sparkSession
    rows = upsert(spark.read.parquet(f"{old}/chunks").select(*chunks.columns) if old else None, chunks, ["chunk_id"])
    rows.write.mode("overwrite").partitionBy(part).parquet(f"{path}/chunks")
    held = spark.read.parquet(f"{path}/chunks")
    if old:  # only what came is tokenised
        keys = chunks.select("chunk_id").distinct()
        kept = spark.read.parquet(f"{old}/postings").join(keys.withColumnRenamed("chunk_id", "doc_id"), "doc_id", "left_anti")
        terms = kept.unionByName(chunk_postings(held.join(keys, "chunk_id", "left_semi")))
    else:
        terms = chunk_postings(held)
    terms.write.mode("overwrite").parquet(f"{path}/postings")
    lengths = spark.read.parquet(f"{path}/postings").groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    lengths.write.mode("overwrite").parquet(f"{path}/doc_len")
    spark.read.parquet(f"{path}/doc_len").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """With a header in each file; nulls are empty."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def document_markdown(docs: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, body)``: a document's title as heading and its chunks in order, blank lines between."""
    body = chunks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    whole = F.array_join(F.transform("c", lambda c: c["content"]), "\n\n")
    return docs.join(body, id_col, "left").select(id_col, F.concat(F.lit("# "), F.coalesce("title", F.lit("untitled")), F.lit("\n\n"), F.coalesce(whole, F.lit(""))).alias("body"))


def store_images(images: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``(image_id, kept_id, is_new)`` of ``images(image_id, content)``: by the hash of their bytes, an
    image that is held already, or came first, is returned in place of another insert."""
    hashed = images.select("image_id", F.sha2("content", 256).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min("image_id").alias("first_id"), F.count("*").alias("n"))
    if held is not None:
        first = first.join(held.select("sha256", F.col("image_id").alias("held_id")), "sha256", "left")
    else:
        first = first.withColumn("held_id", F.lit(None).cast("long"))
    kept = F.coalesce("held_id", "first_id")
    return hashed.join(first, "sha256").select("image_id", kept.alias("kept_id"), (F.col("held_id").isNull() & (F.col("image_id") == F.col("first_id"))).alias("is_new"))


def batches(items: Column, size: int) -> Column:
    """An array in groups of ``size``, the last may be smaller."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i + 1, size))


# Files of office formats, one a row
def xlsx_file(name: Column, rows: Column) -> Column:
    return by_row(formats.write_xlsx, "binary")(name, rows)


def docx_file(title: Column, paragraphs: Column) -> Column:
    return by_row(formats.write_docx, "binary")(title, paragraphs)


def pptx_file(slides: Column) -> Column:
    """Of an array of ``struct<title, body>``."""
    return by_row(formats.write_pptx, "binary")(slides)


def pdf_file(lines: Column) -> Column:
    return by_row(formats.write_pdf, "binary")(lines)


def fetch_chunks(asked: DataFrame, index: DataFrame, table: DataFrame, most: int = 10_000) -> DataFrame:
    """The chunks of the documents ``asked(doc_id)`` in order, at most ``most`` each: those of the index,
    and of the table for documents that the index does not have."""
    found = index.join(asked, "doc_id", "left_semi")
    rest = table.join(asked, "doc_id", "left_semi").join(index.select("doc_id").distinct(), "doc_id", "left_anti")
    both = found.unionByName(rest.select(*found.columns))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_index"))
    return both.withColumn("rank_", rank).where(F.col("rank_") <= most).drop("rank_")
