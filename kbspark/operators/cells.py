"""Nearest neighbours by cosine through an inverted file: cells as folders, probes, bounds, exact scores.

``path/cells``                         the centroids, fitted on a bounded sample
``path/vectors/<name>/cell=<n>``       the vectors of one write by the cell of their nearest centroid
``path/radii/<name>``                  for each cell of a write, the widest angle to its centroid
``path/manifest/<version>.json``       the writes that count, oldest first (see ``sources.segments``)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.sources.scratch import folder
from kbspark.sources.segments import commit, versions

#: Vectors that the centroids are fitted on at most, rounds of fitting.
SAMPLE, ROUNDS = 20_000, 12
#: Cells that each query visits in the first round.
PROBES = 4
#: Vectors of a cell that are scored in one task, queries that are multiplied at once.
PART_ROWS, PART_QUERIES = 50_000, 256
#: Angles are compared with this margin, since cosines near 1 lose half of their digits.
MARGIN = 1e-7
#: The cell of vectors without a direction: null, empty, zero or not finite. Their score is 0.
NOWHERE = -1


@dataclass
class Cells:
    spark: SparkSession
    path: str
    key: str
    kind: str  # of the keys
    version: int
    names: list[str]
    ids: np.ndarray  # of the cells
    centroids: np.ndarray


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, and which of them have a direction; the others are zero."""
    flat = column.flatten()
    if dim and not column.null_count and not flat.null_count and (np.diff(column.offsets.to_numpy()) == dim).all():
        out = flat.to_numpy().reshape(-1, dim).astype(float)
        good = np.isfinite(out).all(axis=1) & out.any(axis=1)
        out[~good] = 0
        return out, good
    out, good = np.zeros((len(column), dim)), np.zeros(len(column), bool)
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == dim and None not in v:
            out[i] = v
            good[i] = np.isfinite(out[i]).all() and out[i].any()
    out[~good] = 0
    return out, good


def units(v: np.ndarray) -> np.ndarray:
    scale = np.abs(v).max(axis=1, keepdims=True)
    v = v / np.where(scale == 0, 1, scale)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def lloyd(v: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors; an empty cell takes the vector that fits its own cell worst."""
    centres = v[np.linspace(0, len(v) - 1, min(cells, len(v))).astype(int)].copy()
    for _ in range(rounds):
        cosine = v @ centres.T
        cell, fit = cosine.argmax(axis=1), cosine.max(axis=1)
        worst = iter(np.argsort(fit))
        for c in range(len(centres)):
            mine = v[cell == c]
            centres[c] = mine.sum(axis=0) if len(mine) else v[next(worst)]
        centres = units(centres)
    return centres


def _vectors(rows: DataFrame, key: str, vec: str) -> DataFrame:
    return rows.select(F.col(key).alias(key), F.col(vec).cast("array<double>").alias("v"))


def create(rows: DataFrame, path: str, cells: int = 64, key: str = "vec_id", vec: str = "embedding", sample: int = SAMPLE) -> Cells:
    """An index of ``rows``: centroids from about ``sample`` vectors, twice as many at most, in one task."""
    spark, few = rows.sparkSession, _vectors(rows, key, vec)
    n = few.count()
    drawn = few.where(F.pmod(F.xxhash64(key), F.lit(max(n, 1))) < sample).limit(2 * sample).select("v").coalesce(1)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [v for b in batches for v in b.column(0).to_pylist() if v]
        dim = max({len(v) for v in lists}, key=[len(v) for v in lists].count) if lists else 0
        m, good = matrix(pa.array(lists, pa.list_(pa.float64())), dim)
        found = lloyd(units(m[good]), cells) if good.any() else np.zeros((0, dim))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found.tolist(), pa.list_(pa.float64()))], ["cell", "centroid"])

    drawn.mapInArrow(fit, "cell int, centroid array<double>").write.parquet(f"{path}/cells")
    return _write(spark, few, path, key, 1, [])


def add(index: Cells, rows: DataFrame, vec: str = "embedding") -> Cells:
    """Rows with those of equal keys replaced: only the new ones are written."""
    return _write(index.spark, _vectors(rows, index.key, vec), index.path, index.key, index.version + 1, index.names)


def _centroids(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    held = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
    lists = held.column("centroid").to_pylist()
    return np.array(held.column("cell").to_pylist(), int), np.array(lists) if lists else np.zeros((0, 0))


def _write(spark: SparkSession, few: DataFrame, path: str, key: str, version: int, names: list[str]) -> Cells:
    name, (ids, centroids) = uuid.uuid4().hex, _centroids(spark, path)
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for b in batches:
            m, good = matrix(b.column(1), centres.shape[1])
            cosine = units(m) @ centres.T if len(centres) else np.zeros((b.num_rows, 1))
            cell = np.where(good, cosine.argmax(axis=1), NOWHERE)
            angle = np.where(good, np.arccos(np.clip(cosine.max(axis=1), -1, 1)), 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(angle), pa.array(cell, pa.int32())], [key, "v", "angle", "cell"])

    last = few.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("v").alias("v"))
    placed = last.mapInArrow(assign, f"{key} {few.schema[key].dataType.simpleString()}, v array<double>, angle double, cell int")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors/{name}")
    kind = f"{key} {few.schema[key].dataType.simpleString()}, v array<double>, angle double, cell int"
    spark.read.schema(kind).parquet(f"{path}/vectors/{name}").groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).write.parquet(f"{path}/radii/{name}")
    commit(spark, path, version, {"key": key, "kind": few.schema[key].dataType.simpleString(), "names": [*names, name]})
    return Cells(spark, path, key, few.schema[key].dataType.simpleString(), version, [*names, name], ids, centroids)


def open_cells(spark: SparkSession, path: str, version: int | None = None) -> Cells:
    at = versions(spark, path)[-1] if version is None else version
    body = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest/{at}.json").collect()))
    return Cells(spark, path, body["key"], body["kind"], at, body["names"], *_centroids(spark, path))


def rows_of(index: Cells) -> DataFrame:
    """``(key, v, cell)`` of the live rows: those that no later write replaces. A filter on ``cell`` prunes folders."""
    spark, key = index.spark, index.key
    held = lambda i: spark.read.schema(f"{key} {index.kind}, v array<double>, cell int").parquet(f"{index.path}/vectors/{index.names[i]}")
    parts = reduce(DataFrame.unionByName, [held(i).withColumn("write_", F.lit(i)) for i in range(len(index.names))])
    if len(index.names) == 1:
        return parts.drop("write_")
    later = reduce(DataFrame.unionByName, [held(i).select(F.col(key).alias("key_"), F.lit(i).alias("at_")) for i in range(1, len(index.names))])
    gone = later.groupBy("key_").agg(F.max("at_").alias("at_"))
    return parts.join(gone, (parts[key] == gone["key_"]) & (parts["write_"] < gone["at_"]), "left_anti").drop("write_")


def radii(index: Cells) -> tuple[np.ndarray, dict[int, int]]:
    """The widest angle of each cell, negative where it is empty, and the rows of each cell, ``NOWHERE`` too."""
    parts = reduce(DataFrame.unionByName, [index.spark.read.parquet(f"{index.path}/radii/{n}") for n in index.names])
    found = {r["cell"]: (r["radius"], r["n"]) for r in parts.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()}
    return np.array([found[c][0] if c in found else -1.0 for c in index.ids]), {c: n for c, (_, n) in found.items()}


def bounds(index: Cells, queries: DataFrame, factor: float) -> DataFrame:
    """``(query_id, q, cell, bound, place)``: the cosine that no vector of the cell surpasses, cells by descending bound.

    By the triangle inequality of angles it is that of the query's angle to the centroid less the cell's radius. A ``factor``
    over 1 divides the radius, so that more cells can be left out and some near vectors may be missed; 1 is exact.
    """
    radius, sizes = radii(index)
    sent = index.spark.sparkContext.broadcast((index.ids, index.centroids, radius))
    nowhere = NOWHERE in sizes
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centres, wide = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, PART_QUERIES):
                b = whole.slice(start, PART_QUERIES)
                m, good = matrix(b.column(1), centres.shape[1])
                angle = np.arccos(np.clip(units(m) @ centres.T, -1, 1)) if len(centres) else np.zeros((b.num_rows, 0))
                bound = np.cos(np.maximum(angle - wide / factor - MARGIN, 0))
                bound[~good] = 0.0
                bound[:, wide < 0] = -2.0
                cells = ids
                if nowhere:
                    bound, cells = np.column_stack([bound, np.zeros(b.num_rows)]), np.append(ids, NOWHERE)
                order = np.argsort(-bound, axis=1, kind="stable")
                place = np.tile(np.arange(order.shape[1]), b.num_rows)
                whose = pa.array(np.repeat(np.arange(b.num_rows), order.shape[1]))
                cols = [b.column(0).take(whose), b.column(1).take(whose), pa.array(cells[order].ravel(), pa.int32()), pa.array(np.take_along_axis(bound, order, 1).ravel()), pa.array(place, pa.int32())]
                out = pa.RecordBatch.from_arrays(cols, ["query_id", "q", "cell", "bound", "place"])
                yield out.filter(pa.array(np.take_along_axis(bound, order, 1).ravel() > -2))

    return queries.select("query_id", F.col("q").cast("array<double>").alias("q")).mapInArrow(run, f"query_id {kind}, q array<double>, cell int, bound double, place int")


def visit(index: Cells, asks: DataFrame, k: int) -> DataFrame:
    """``(query_id, key, score)``: the best ``k`` of each part of each asked cell, by exact cosine.

    Only folders of asked cells are read. A large cell is dealt over several tasks, its queries are sent to each."""
    key, (_, sizes) = index.key, radii(index)
    cells = [r[0] for r in asks.select("cell").distinct().collect()]
    parts = {c: -(-sizes[c] // PART_ROWS) for c in cells}
    table = F.create_map(*[F.lit(x) for c, p in parts.items() for x in (c, p)]) if parts else None
    rows = rows_of(index).where(F.col("cell").isin(*cells)) if cells else rows_of(index).where("false")
    n = F.element_at(table, F.col("cell")) if parts else F.lit(1)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(key), n).cast("int"))
    sent = asks.select("query_id", "q", "cell", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("part"))
    kinds = [f.dataType.simpleString() for f in (asks.schema["query_id"], rows.schema[key])]

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        q_type, id_type = queries.schema.field("query_id").type, vectors.schema.field(key).type
        if vectors.num_rows and queries.num_rows:
            ids = vectors.column(key).to_pylist()
            rank = np.argsort(np.array(sorted(range(len(ids)), key=ids.__getitem__)), kind="stable")
            lists = vectors.column("v").combine_chunks()
            dim = next((len(v.as_py()) for v in lists if v.is_valid and len(v.as_py())), 0)
            m = units(matrix(lists, dim)[0])
            names, asked = queries.column("query_id").to_pylist(), queries.column("q").combine_chunks()
            for at in range(0, len(names), PART_QUERIES):
                cosine = units(matrix(asked.slice(at, PART_QUERIES), dim)[0]) @ m.T
                for i, line in enumerate(cosine):
                    some = np.arange(len(line)) if len(line) <= k else np.flatnonzero(line >= np.partition(line, -k)[-k])
                    some = some[np.lexsort((rank[some], -line[some]))[:k]]
                    out[0].extend([names[at + i]] * len(some))
                    out[1].extend(ids[j] for j in some)
                    out[2].extend(line[some].tolist())
        return pa.table([pa.array(out[0], q_type), pa.array(out[1], id_type), pa.array(out[2], pa.float64())], ["query_id", key, "score"])

    joined = dealt.groupBy("cell", "part").cogroup(sent.groupBy("cell", "part"))
    return joined.applyInArrow(run, f"query_id {kinds[0]}, {key} {kinds[1]}, score double")


def nearest(index: Cells, queries: DataFrame, k: int, factor: float = 1.0, probes: int = PROBES) -> DataFrame:
    """``(query_id, key, rank, score)``: for each of any number of ``queries(query_id, q)`` its ``k``
    nearest rows by cosine, ties by key.

    Each query visits the cells of the highest bounds, then those further ones whose bound reaches the k-th score found. With
    factor 1 nothing can be missed. Rows and queries without a direction have score 0.
    """
    spark, key = index.spark, index.key
    path = folder(spark, "probes")
    bounds(index, queries, factor).write.parquet(path)
    asked = spark.read.parquet(path)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = folder(spark, "visited")
    best(visit(index, asked.where(F.col("place") < probes), k)).write.parquet(first)
    held = spark.read.parquet(first)
    reach = held.where(F.col("rank") == k).select("query_id", F.col("score").alias("reach"))
    rest = asked.where(F.col("place") >= probes).join(reach, "query_id", "left").where("reach is null or bound >= reach")
    second = visit(index, rest, k)
    return best(held.select(*second.columns).unionByName(second)).select("query_id", key, "rank", "score")
