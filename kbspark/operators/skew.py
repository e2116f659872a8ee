"""Joins to one row per key when a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_found(rows: DataFrame, found: DataFrame, on: list[str], count: str, how: str = "inner", shares: int = 1000) -> DataFrame:
    """``rows`` joined to ``found``, which has one row a key and in ``count`` the number of rows with it.

    Keys that hold more than one in ``shares`` of all rows are hot; at most ``shares`` keys can be, so
    their list is broadcast. Rows of a hot key are dealt by a hash of their other columns, and its row
    of ``found`` is repeated for each part.
    """
    total = found.agg(F.sum(count)).first()[0] or 0
    least = max(1, -(-total // shares))
    parts = F.ceil(F.col(count) / F.lit(least)).cast("int")
    hot = found.where(F.col(count) > least).select(*on, parts.alias("parts_"))
    deal = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in on]), F.col("parts_")).cast("int")
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("part_", F.coalesce(deal, F.lit(0))).drop("parts_")
    copied = found.withColumn("part_", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > least, parts).otherwise(F.lit(1)) - 1))).drop(count)
    return dealt.join(copied, [*on, "part_"], how).drop("part_")
