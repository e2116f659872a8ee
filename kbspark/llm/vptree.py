"""Nearest neighbours by inner product: vantage-point trees per shard, pruned by the triangle inequality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.llm.common import table

#: Production parameters: rows of a shard and of a block of queries, queries that walk a tree at once,
#: rows of a leaf, pruning factor.
SHARD_ROWS, BLOCK_ROWS, WALK_ROWS, LEAF_ROWS, FACTOR = 16_384, 16_384, 1_024, 512, 1.0
SLACK = 1e-9  # rounding allowed before the exact score decides


class VpTree:
    """Built over ``points`` lifted so that the largest inner product is the least distance.

    A point x of norm at most M becomes (x, sqrt(M² - |x|²)), a query q becomes (q, 0); their
    squared distance is |q|² + M² - 2 q·x.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS):
        norms = np.einsum("ij,ij->i", points, points)
        self.points, self.top = points, norms.max(initial=0.0)
        self.lifted = np.hstack([points, np.sqrt(np.maximum(self.top - norms, 0))[:, None]])
        self.leaves: list[np.ndarray] = []
        self.root = self._build(np.arange(len(points)), leaf, np.random.default_rng(len(points)))

    def _build(self, rows: np.ndarray, leaf: int, rng: np.random.Generator):
        if len(rows) > leaf:
            vantage = self.lifted[rng.choice(rows)]
            far = np.sqrt(((self.lifted[rows] - vantage) ** 2).sum(1))
            border = float(np.median(far))
            inside = far <= border
            if 0 < inside.sum() < len(rows):
                return vantage, border, self._build(rows[inside], leaf, rng), self._build(rows[~inside], leaf, rng)
        self.leaves.append(rows)  # small, or all points at one distance
        return len(self.leaves) - 1

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float = FACTOR):
        """``(query row, id, score)`` arrays of the best ``k`` per query; ``own``: ids to leave out.

        First each query visits the leaf it falls into, then one walk over the tree visits what the
        triangle inequality cannot exclude. The far side of a border is left out if ``factor`` times
        the query's distance to the border exceeds that to its k-th best so far; with factor 1 no
        result is lost, larger factors visit less.
        """
        m = len(queries)
        lifted = np.hstack([queries, np.zeros((m, 1))])
        self.queries, self.own, self.ids, self.k = queries, own, ids, k
        self.square = np.einsum("ij,ij->i", queries, queries)
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.kth = np.full(m, -np.inf)
        home = np.full(m, -1)

        def descend(node, rows):
            if not len(rows):
                return
            if isinstance(node, int):
                home[rows] = node
                self._visit(node, rows)
                return
            vantage, border, near, far = node
            inside = np.sqrt(((lifted[rows] - vantage) ** 2).sum(1)) <= border
            descend(near, rows[inside])
            descend(far, rows[~inside])

        def walk(node, rows):
            if not len(rows):
                return
            if isinstance(node, int):
                self._visit(node, rows[home[rows] != node])
                return
            vantage, border, near, far = node
            gap = np.sqrt(((lifted[rows] - vantage) ** 2).sum(1)) - border
            reach = np.sqrt(np.maximum(self.square[rows] + self.top - 2 * self.kth[rows], 0)) * (1 + SLACK) + SLACK
            walk(near, rows[factor * gap <= reach])
            reach = np.sqrt(np.maximum(self.square[rows] + self.top - 2 * self.kth[rows], 0)) * (1 + SLACK) + SLACK
            walk(far, rows[-factor * gap <= reach])

        descend(self.root, np.arange(m))
        walk(self.root, np.arange(m))
        return self.found

    def _visit(self, leaf: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        members = self.leaves[leaf]
        rough = self.queries[rows] @ self.points[members].T
        rough[self.own[rows][:, None] == self.ids[members][None, :]] = -np.inf
        floor = self.kth[rows]
        if len(members) > self.k:
            floor = np.maximum(floor, np.partition(rough, len(members) - self.k, axis=1)[:, len(members) - self.k])
        margin = SLACK * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))
        q, c = np.nonzero((rough >= (floor - margin)[:, None]) & (rough > -np.inf))
        if not len(q):
            return
        q, c = rows[q], members[c]
        score = np.zeros(len(q))
        for j in range(self.points.shape[1]):  # in the order of the components, so that equal vectors tie exactly
            score += self.queries[q, j] * self.points[c, j]
        old = self.found
        q, i, s = np.concatenate([old[0], q]), np.concatenate([old[1], self.ids[c]]), np.concatenate([old[2], score])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        keep = place < self.k
        self.found = (q[keep], i[keep], s[keep])
        last = place == self.k - 1
        self.kth[q[last]] = s[last]


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows that take part, as ``(vec_id, v array<double>, dim)``."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    few = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return few.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def nearest(
    rows: DataFrame,
    is_query,
    k: int = 20,
    factor: float = FACTOR,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` largest inner products of each query.

    Rows are dealt to shards and queries to blocks by a hash; one task has one shard and one block,
    both of bounded size, builds the shard's tree once and searches it for the block, some queries
    at a time. Each tile gives at most k rows a
    query, and a rank over the tiles gives the result. Vectors that are null, empty, zero or hold
    null or non-finite components take no part, nor do rows with a null id; vectors meet only those
    of their own length. Ties go to the smaller id; an id that is repeated is several candidates,
    none of which answers a query of that same id.
    """
    all_rows = usable(rows, id_col, vec_col)
    sizes = all_rows.agg(F.count("*").alias("n"), F.count_if(is_query(F.col("vec_id"))).alias("q")).first()
    shards, blocks = -(-max(sizes["n"], 1) // shard_rows), -(-max(sizes["q"], 1) // block_rows)
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = all_rows.select("dim", deal(shards, 1).alias("shard"), spread(blocks).alias("block"), "vec_id", "v")
    asked = all_rows.where(is_query(F.col("vec_id"))).select(
        "dim", spread(shards).alias("shard"), deal(blocks, 2).alias("block"), "vec_id", "v"
    )

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        tree, members = VpTree(matrix(left)), left["vec_id"].to_numpy()
        parts = []
        for at in range(0, right.num_rows, WALK_ROWS):
            some = right.slice(at, WALK_ROWS)
            ids = some["vec_id"].to_numpy()
            q, i, s = tree.search(matrix(some), ids, members, k, factor)
            parts.append(pa.table([pa.array(ids[q]), pa.array(i), pa.array(s)], names))
        return pa.concat_tables(parts)

    key = ["dim", "shard", "block"]
    found = base.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(tile, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors with the largest inner product for every twentieth one, exactly."""
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


SQL5 = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
