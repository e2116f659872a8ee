"""Joins of intervals with points: overlap through bins, nearest through one sort. No pairs of a whole document are made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Width of a bin; an interval is repeated in each bin that it touches.
BIN = 64


def overlapping(intervals: DataFrame, points: DataFrame, on: list[str], first: str, last: str, at: str, reach: tuple[int, int] = (0, 0), width: int = BIN) -> DataFrame:
    """Every interval with every point between ``first - reach[0]`` and ``last + reach[1]``, ends
    included, of the same ``on`` columns; the other columns of both, whose names must differ.

    Both sides are cut into bins of ``width``: a point lies in one, an interval in those that it
    touches. So a document of any length is dealt over as many keys as it has bins, and rows meet
    only where they may overlap. Intervals with a null or reversed end and null points find nothing.
    """
    low, high = F.col(first) - reach[0], F.col(last) + reach[1]
    bin_ = lambda c: F.floor(c / width).cast("long")
    spread = intervals.where(F.col(first) <= F.col(last)).withColumn("bin_", F.explode(F.sequence(bin_(low), bin_(high))))
    placed = points.where(F.col(at).isNotNull()).withColumn("bin_", bin_(F.col(at)))
    return spread.join(placed, [*on, "bin_"]).where(F.col(at).between(low, high)).drop("bin_")


def nearest(asked: DataFrame, points: DataFrame, on: list[str], at: str, to: str, point_id: str) -> DataFrame:
    """``asked`` with ``point_id`` and ``to`` of the nearest point of the same ``on`` columns, or nulls: the one of
    least distance between ``at`` and ``to``, then the lesser place, then the lesser id.

    Both sides are sorted together once; the nearest point is the last before or the first behind. Of
    points at one place only the least id can be an answer. Rows of a null place have none.
    """
    best = points.where(F.col(to).isNotNull()).groupBy(*on, to).agg(F.min(point_id).alias(point_id))
    place = F.struct(F.col(to).alias("to"), F.col(point_id).alias("id"))
    fields = [F.struct(*[c for c in asked.columns if c not in on]).alias("row_")]
    left = asked.select(*on, F.col(at).alias("place_"), F.lit(1).alias("side_"), *fields, F.lit(None).cast(best.select(place.alias("p")).schema["p"].dataType).alias("p_"))
    right = best.select(*on, F.col(to).alias("place_"), F.lit(0).alias("side_"), F.lit(None).cast(left.schema["row_"].dataType).alias("row_"), place.alias("p_"))
    order = W.partitionBy(*on).orderBy("place_", "side_")
    before = F.last("p_", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    # One running window each way: the second is a running last over the reversed order.
    behind = F.last("p_", ignorenulls=True).over(W.partitionBy(*on).orderBy(F.desc("place_"), "side_").rowsBetween(W.unboundedPreceding, W.currentRow))
    swept = left.unionByName(right).withColumns({"before_": before, "behind_": behind}).where("side_ = 1")
    far = lambda p: F.abs(F.col("place_") - F.col(f"{p}.to"))
    pick = F.when(F.col("place_").isNull(), None).when(F.col("behind_").isNull() | (far("before_") <= far("behind_")), F.col("before_")).otherwise(F.col("behind_"))
    return swept.withColumn("pick_", pick).select(*[F.col(c) if c in on else F.col(f"row_.{c}").alias(c) for c in asked.columns], F.col("pick_.id").alias(point_id), F.col("pick_.to").alias(to))


def chunk_images(chunks: DataFrame, images: DataFrame, near: int = 10, early: int = 5) -> DataFrame:
    """``(d, c, i, strategy)`` of ``chunks(d, c, first, last, page)`` and ``images(d, i, e, image_page)``.

    An image belongs to a chunk within whose range it stands, or up to ``near`` behind it on its page, or
    among the first ``early`` elements of the next page: the first of these that holds.
    """
    gap, same = F.col("e") - F.col("last"), F.col("page") == F.col("image_page")
    within = F.col("e").between(F.col("first"), F.col("last"))
    close = overlapping(chunks, images, ["d"], "first", "last", "e", (0, near))
    close = close.withColumn("strategy", F.when(within, "within_range").when(same & (gap > 0), "nearby_same_page"))
    start = images.where(F.col("e") <= early).withColumn("page", F.col("image_page") - 1)
    follows = chunks.join(start, ["d", "page"]).where(~within)
    both = close.where("strategy IS NOT NULL").select("d", "c", "i", "strategy")
    return both.unionByName(follows.select("d", "c", "i", F.lit("adjacent_page").alias("strategy")))


def image_chunks(images: DataFrame, chunks: DataFrame, near: int = 10) -> DataFrame:
    """``(d, i, e, c, strategy)``: the chunks around each image, up to ``near`` before or behind it on its page,
    else all chunks of its page."""
    e, first, last, same = F.col("e"), F.col("first"), F.col("last"), F.col("page") == F.col("image_page")
    strategy = F.when(e.between(first, last), "within_range").when(same & (e > last), "before_image").when(same & (first > e), "after_image")
    hits = overlapping(chunks, images, ["d"], "first", "last", "e", (near, near)).withColumn("strategy", strategy).where("strategy IS NOT NULL")
    hits = hits.select("d", "i", "e", "c", "strategy")
    alone = images.join(hits.select("d", "i", "e").distinct(), ["d", "i", "e"], "left_anti")
    rest = alone.withColumn("page", F.col("image_page")).join(chunks, ["d", "page"]).select("d", "i", "e", "c", F.lit("fallback").alias("strategy"))
    return hits.unionByName(rest)
