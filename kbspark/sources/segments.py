"""A search index kept as append-only segments with tombstones, behind a manifest that changes atomically.

``path/segments/<name>/postings/bucket=<n>``  positional postings by a hash of their term, in blocks of documents
``path/segments/<name>/rows``                 the rows themselves with their length ``dl``
``path/dead/<name>``                          keys deleted without a successor
``path/manifest/<version>.json``              the live segments and deletions, oldest first, and the counts of live rows

A row of a segment is live unless a later segment or deletion names its key. Writers add files and then
one manifest; a writer that dies before leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.text import tokens

#: Folders that the postings of a segment are dealt to by their term's hash.
BUCKETS = 32
#: Documents and tokens after which a block of postings is closed.
BLOCK_ROWS, BLOCK_TOKENS = 4096, 2_000_000
#: Segments of one size class (powers of this number of rows) that are merged once there are so many.
TIER = 4
POSTINGS = "block long, term string, docs array<{0}>, tf array<int>, pos array<int>, dl array<int>, most array<int>, least array<int>, bucket int"


@dataclass
class Index:
    """A version of the index as a reader sees it."""

    spark: SparkSession
    path: str
    key: str
    version: int
    entries: list[dict]  # {"name", "kind": "segment" or "dead", "rows"}
    n: int
    total: int

    @property
    def segments(self) -> list[int]:
        return [i for i, e in enumerate(self.entries) if e["kind"] == "segment"]


def bucket_of(term, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


# Manifest
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    folder, fs, _ = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def commit(spark: SparkSession, path: str, version: int, body: dict) -> None:
    """Publish a version: its file is written aside and renamed, which fails where another writer came first."""
    folder, fs, Path = _fs(spark, path)
    aside, to = Path(folder, f"{uuid.uuid4().hex}.part"), Path(folder, f"{version}.json")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(body).encode()))
    out.close()
    if fs.exists(to) or not fs.rename(aside, to):
        fs.delete(aside, False)
        raise RuntimeError(f"version {version} of {path} was written by another writer; try again")


def open_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no index at {path}")
    at = found[-1] if version is None else version
    body = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest/{at}.json").collect()))
    return Index(spark, path, body["key"], at, body["entries"], body["n"], body["total"])


# Segments
def build_blocks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Postings of ``rows(key, dl, text)``, a row for each term of each block.

    Rows of like length of a task come together, so that the best term weight of a block says something; a
    block is cut from the sorted stream. Nothing is shuffled, and texts are tokenised behind the sort. In each list ``pos`` holds the places of all its documents
    in a row, ``tf`` of them for each. ``most`` and ``least`` are the frequencies and lengths of the
    documents that no other one of the list surpasses in both.
    """
    kind = rows.schema[key].dataType
    sizes = rows.withColumn("class", F.floor(2 * F.log2(F.col("dl") + 1)).cast("int"))
    near = sizes.sortWithinPartitions("class", "dl", key).select(key, "dl", tokens(F.col(text)).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        n = size = 0
        for batch in batches:
            lengths = batch.column(1).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                room = np.searchsorted(np.cumsum(lengths[at:]), max(1, BLOCK_TOKENS - size), "right") + 1
                take = int(min(batch.num_rows - at, BLOCK_ROWS - n, room))
                held.append(batch.slice(at, take))
                n, size, at = n + take, size + int(lengths[at : at + take].sum()), at + take
                if n >= BLOCK_ROWS or size >= BLOCK_TOKENS:
                    yield inverted(pa.Table.from_batches(held), number)
                    held, n, size, number = [], 0, 0, number + 1
        if held:
            yield inverted(pa.Table.from_batches(held), number)

    return near.mapInArrow(run, POSTINGS.format(kind.simpleString()).rsplit(",", 1)[0])


def inverted(block: pa.Table, number: int) -> pa.RecordBatch:
    """The lists of a block of ``(key, dl, words)``."""
    words = block.column(2).combine_chunks()
    length = block.column(1).to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
    order = np.lexsort((place, row, code))
    code, row, place = code[order], row[order], place[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    tf, term, row = np.diff(np.append(at, len(code))), code[at], row[at]
    n = len(coded.dictionary)
    docs = np.cumsum(np.bincount(term, minlength=n))
    places = np.cumsum(np.bincount(code, minlength=n))
    best = np.lexsort((-tf, length[row], term))
    climbing = np.maximum.accumulate(term[best] * (1 << 40) + tf[best]) if len(best) else best
    front = np.ones(len(best), bool)
    front[1:] = climbing[1:] > climbing[:-1]
    best = best[front]
    fronts = np.cumsum(np.bincount(term[best], minlength=n))

    def lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)

    ints = lambda v: pa.array(v, pa.int32())
    cols = {
        "block": pa.array(np.full(n, number), pa.int64()), "term": coded.dictionary, "docs": lists(block.column(0).combine_chunks().take(pa.array(row)), docs),
        "tf": lists(ints(tf), docs), "pos": lists(ints(place), places), "dl": lists(ints(length[row]), docs),
        "most": lists(ints(tf[best]), fronts), "least": lists(ints(length[row][best]), fronts),
    }
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def write_segment(rows: DataFrame, path: str, key: str, text: str) -> dict:
    """The files of a segment with one row a key; the greatest row wins where a key comes twice.

    Only keys are shuffled to find those, and the rows that have one; the texts of all other rows and the postings are
    written where they lie, each task's postings in the order of buckets and terms.
    """
    spark, name = rows.sparkSession, uuid.uuid4().hex
    others = [c for c in rows.columns if c not in (key, "dl")]
    named = rows.where(F.col(key).isNotNull()).select(key, *others)
    often = named.groupBy(key).agg(F.count("*").alias("n_")).where("n_ > 1").select(key)
    often.write.parquet(f"{path}/segments/{name}/twice")
    often, once = spark.read.parquet(f"{path}/segments/{name}/twice"), named
    if not often.isEmpty():
        best = named.join(often, key, "left_semi").groupBy(key).agg(F.max(F.struct(*others)).alias("r")).select(key, *[f"r.{c}" for c in others])
        once = named.join(often, key, "left_anti").unionByName(best)
    once.withColumn("dl", F.coalesce(F.size(tokens(F.coalesce(F.col(text), F.lit("")))), F.lit(0))).write.parquet(f"{path}/segments/{name}/rows")
    held = spark.read.parquet(f"{path}/segments/{name}/rows")
    lists = build_blocks(held.where("dl > 0").select(key, "dl", text), key, text).withColumn("bucket", bucket_of("term"))
    lists.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/segments/{name}/postings")
    return {"name": name, "kind": "segment", "rows": held.count()}


def segment_rows(index: Index, i: int) -> DataFrame:
    return index.spark.read.parquet(f"{index.path}/segments/{index.entries[i]['name']}/rows")


def _keys(index: Index, i: int) -> DataFrame:
    e = index.entries[i]
    folder = f"segments/{e['name']}/rows" if e["kind"] == "segment" else f"dead/{e['name']}"
    return index.spark.read.parquet(f"{index.path}/{folder}").select(F.col(index.key).alias("key_"), F.lit(i).alias("at_"))


def dead(index: Index) -> DataFrame | None:
    """``(key_, at_)``: the place of the last entry that names a key, of all entries but the first one."""
    later = [_keys(index, i) for i in range(1, len(index.entries))]
    return reduce(DataFrame.unionByName, later).groupBy("key_").agg(F.max("at_").alias("at_")) if later else None


def live(index: Index, rows: DataFrame, key: str, segment: str = "segment") -> DataFrame:
    """Those of ``rows`` that no later entry replaces or deletes; ``segment`` is the place of theirs."""
    gone = dead(index)
    if gone is None:
        return rows
    return rows.join(gone, (rows[key] == gone["key_"]) & (rows[segment] < gone["at_"]), "left_anti")


def rows_of(index: Index, columns: list[str] | None = None) -> DataFrame:
    """All live rows, without ``dl`` unless it is named."""
    parts = [segment_rows(index, i).withColumn("segment", F.lit(i)) for i in index.segments]
    whole = live(index, reduce(DataFrame.unionByName, parts), index.key)
    return whole.select(*columns) if columns else whole.drop("segment", "dl")


def postings_of(index: Index) -> DataFrame:
    """The postings of all segments with the segment's place; a filter on ``bucket`` prunes folders."""
    kind = segment_rows(index, index.segments[0]).schema[index.key].dataType.simpleString()
    parts = []
    for i in index.segments:
        base = f"{index.path}/segments/{index.entries[i]['name']}/postings"
        parts.append(index.spark.read.schema(POSTINGS.format(kind)).parquet(base).withColumn("segment", F.lit(i)))
    return reduce(DataFrame.unionByName, parts)


def _lost(index: Index, keys: DataFrame) -> tuple[int, int]:
    """Number and length of the live rows that have one of ``keys(key_)``."""
    mine = rows_of(index, [index.key, "dl"])
    r = mine.join(keys, mine[index.key] == keys["key_"], "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
    return r["n"], r["t"]


# Writers
def create(rows: DataFrame, path: str, key: str = "chunk_id", text: str = "content") -> Index:
    spark = rows.sparkSession
    e = write_segment(rows, path, key, text)
    total = spark.read.parquet(f"{path}/segments/{e['name']}/rows").agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
    commit(spark, path, 1, {"key": key, "text": text, "entries": [e], "n": e["rows"], "total": total})
    return open_index(spark, path)


def upsert(index: Index, rows: DataFrame, text: str = "content") -> Index:
    """Rows with their keys' older ones replaced: one more segment, nothing else is rewritten."""
    spark = index.spark
    e = write_segment(rows, index.path, index.key, text)
    new = spark.read.parquet(f"{index.path}/segments/{e['name']}/rows")
    n, t = _lost(index, new.select(F.col(index.key).alias("key_")))
    total = new.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
    body = {"key": index.key, "text": text, "entries": [*index.entries, e], "n": index.n - n + e["rows"], "total": index.total - t + total}
    commit(spark, index.path, index.version + 1, body)
    return compact(open_index(spark, index.path), text)


def delete(index: Index, keys: DataFrame) -> Index:
    """Without the rows whose key is the first column of ``keys``; unknown keys do nothing."""
    spark, name = index.spark, uuid.uuid4().hex
    asked = keys.select(F.col(keys.columns[0]).alias(index.key)).where(F.col(index.key).isNotNull()).distinct()
    asked.write.parquet(f"{index.path}/dead/{name}")
    held = spark.read.parquet(f"{index.path}/dead/{name}")
    n, t = _lost(index, held.select(F.col(index.key).alias("key_")))
    body = {"key": index.key, "entries": [*index.entries, {"name": name, "kind": "dead", "rows": held.count()}], "n": index.n - n, "total": index.total - t}
    commit(spark, index.path, index.version + 1, body)
    return open_index(spark, index.path)


def compact(index: Index, text: str = "content", all_of_it: bool = False) -> Index:
    """Segments of one size class merged where ``TIER`` neighbours are of it; all of them if so asked.

    Only the live rows of a run of entries are written again, as one segment in their place. Deletions within the
    run vanish only if nothing stands before it; else their keys go on as a deletion.
    """
    level = lambda e: 0 if e["rows"] < TIER else int(np.log(e["rows"]) / np.log(TIER) + 1e-9)
    entries, first = index.entries, None
    if all_of_it:
        first, last = 0, len(entries)
    else:
        for start in range(len(entries) - TIER + 1):
            if all(level(e) <= level(entries[start + TIER - 1]) + 1 for e in entries[start:]) and len(entries) - start >= TIER:
                first, last = start, len(entries)
                break
    if first is None or last - first < 2:
        return index
    spark = index.spark
    parts = [segment_rows(index, i).withColumn("segment", F.lit(i)) for i in index.segments if first <= i < last]
    gone = [e for e in entries[first:last] if e["kind"] == "dead"] if first else []
    merged = live(index, reduce(DataFrame.unionByName, parts), index.key).drop("segment", "dl")
    e = write_segment(merged, index.path, index.key, text)
    body = {"key": index.key, "text": text, "entries": [*entries[:first], *gone, e, *entries[last:]], "n": index.n, "total": index.total}
    commit(spark, index.path, index.version + 1, body)
    return open_index(spark, index.path)


def sweep(index: Index) -> list[str]:
    """Delete the files that no manifest from this version on names, those of dead writers too, and the
    manifests before it. No writer and no reader of an older version may be at work."""
    folder, fs, Path = _fs(index.spark, index.path)
    named, removed = {e["name"] for e in index.entries}, []
    for part in ("segments", "dead"):
        where = Path(f"{index.path}/{part}")
        for f in fs.listStatus(where) if fs.exists(where) else []:
            if f.getPath().getName() not in named:
                fs.delete(f.getPath(), True)
                removed.append(f.getPath().getName())
    for f in fs.listStatus(folder):
        if f.getPath().getName() != f"{index.version}.json":
            fs.delete(f.getPath(), False)
    return removed
