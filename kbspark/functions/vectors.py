"""Likeness of images by their feature points, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO = 0.7


def feature_similarity(a: Column, b: Column) -> Column:
    """Share of the features of ``a``, arrays of numbers, whose nearest feature of ``b`` is clearly nearer
    than the second (under ``RATIO`` times its distance), of the larger number of features. 0 without
    two features to compare."""
    distance = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    nearest = lambda x: F.array_sort(F.transform(b, lambda y: distance(x, y)))
    good = F.size(F.filter(F.transform(a, nearest), lambda d: d[0] < RATIO * d[1]))
    enough = (F.size(a) > 0) & (F.size(b) > 1)
    return F.coalesce(F.when(enough, F.least(F.lit(1.0), good / F.greatest(F.size(a), F.size(b)))), F.lit(0.0))
