"""Rates and gauges over moving ranges on a step grid, as range and instant vectors of a metrics store define them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed rules: how far a value reaches if no newer one comes, and the share of the mean distance of
#: samples up to which a range counts as covered to its edge.
STALE_SECONDS, EDGE = 300, 1.1


def seconds(rows: DataFrame, ts: str) -> Column:
    """Seconds since 1970 with fractions; of a timestamp without a zone as its own clock counts them."""
    if rows.schema[ts].dataType.simpleString() == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts)) / F.lit(1_000_000.0)
    return F.unix_micros(F.col(ts)) / F.lit(1_000_000.0)


def grid(samples: DataFrame, by: list[str], step: int, start: float | None = None, end: float | None = None) -> DataFrame:
    """``(by, t)``: every step of every series, from the first multiple of ``step`` to the last one within the samples' time."""
    if start is None or end is None:
        seen = samples.agg(F.min("s").alias("a"), F.max("s").alias("z")).first()
        start, end = (seen["a"] if start is None else start), (seen["z"] if end is None else end)
    if start is None or end is None:
        return samples.select(*by, F.col("s").alias("t")).where("false")
    first, last = -int(-start // step) * step, int(end // step) * step
    steps = F.sequence(*[F.lit(x).cast("long") for x in (first, last, step)]) if last >= first else F.array().cast("array<long>")
    return samples.select(*by).distinct().select(*by, F.explode(steps).alias("t")).withColumn("t", F.col("t").cast("double"))


def numbered(rows: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """``(by, s, v, up, n)``: samples in seconds, the increase of the counter up to each since the first one, and their
    number. A value below the one before is a reset and counts from zero. Of equal times the greatest value counts."""
    samples = rows.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).groupBy(*by, seconds(rows, ts).alias("s")).agg(F.max(value).alias("v"))
    order = W.partitionBy(*by).orderBy("s")
    prior = F.lag("v").over(order)
    gain = F.when(prior.isNull(), 0.0).when(F.col("v") >= prior, F.col("v") - prior).otherwise(F.col("v"))
    return samples.withColumn("gain", gain).select(*by, "s", "v", F.sum("gain").over(order).alias("up"), F.row_number().over(order).alias("n"))


def range_rate(rows: DataFrame, by: list[str], window: int, step: int, ts: str = "ts", value: str = "value", start: float | None = None, end: float | None = None) -> DataFrame:
    """``(by, t, rate)``: the increase a second over the ``window`` seconds up to each step, both ends included.

    The increase between the first and the last sample of the range, resets counted, is extended to its edges where the
    samples reach near them, by half the mean distance else, and never below a counter of zero.
    Ranges of fewer than two samples have no rate. ``t`` is in seconds.

    Ranges overlap as they will: each one's ends are looked up by a sort of the samples with the
    steps, and the increase is a difference of running sums. So the work does not depend on how
    many ranges a sample is in.
    """
    held = numbered(rows, by, ts, value)
    steps = grid(held, by, step, start, end)
    sample = F.struct("s", "v", "up", "n")
    kind = held.select(sample.alias("p")).schema["p"].dataType
    probes = [steps.select(*by, "t", at.alias("place"), F.lit(side).alias("side"), F.lit(None).cast(kind).alias("p")) for side, at in ((1, F.col("t")), (2, F.col("t") - window))]
    points = held.select(*by, F.lit(None).cast("double").alias("t"), F.col("s").alias("place"), F.lit(0).alias("side"), sample.alias("p"))
    rows_ = points.unionByName(probes[0]).unionByName(probes[1])
    upto = F.last("p", ignorenulls=True).over(W.partitionBy(*by).orderBy("place", "side").rowsBetween(W.unboundedPreceding, W.currentRow))
    # From the left edge on: in the reversed order samples at its own place come before it as well.
    after = F.last("p", ignorenulls=True).over(W.partitionBy(*by).orderBy(F.desc("place"), "side").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = rows_.withColumns({"upto": upto, "after": after}).where("side > 0")
    ends = found.groupBy(*by, "t").agg(F.max(F.when(F.col("side") == 1, F.col("upto"))).alias("z"), F.max(F.when(F.col("side") == 2, F.col("after"))).alias("a"))
    ends = ends.where("z.n > a.n")
    span = F.col("z.s") - F.col("a.s")
    mean = span / (F.col("z.n") - F.col("a.n"))
    gain = F.col("z.up") - F.col("a.up")
    left, right = F.col("a.s") - (F.col("t") - window), F.col("t") - F.col("z.s")
    left = F.when(left < mean * EDGE, left).otherwise(mean / 2)
    zero = F.when((gain > 0) & (F.col("a.v") >= 0), span * F.col("a.v") / gain)
    left = F.when(zero.isNotNull() & (zero < left), zero).otherwise(left)
    right = F.when(right < mean * EDGE, right).otherwise(mean / 2)
    return ends.select(*by, "t", (gain * (span + left + right) / span / window).alias("rate"))


def instant(rows: DataFrame, by: list[str], step: int, ts: str = "ts", value: str = "value", stale: int = STALE_SECONDS, start: float | None = None, end: float | None = None) -> DataFrame:
    """``(by, t, value)``: each series' last value at each step, if it is not older than ``stale`` seconds."""
    held = numbered(rows, by, ts, value).select(*by, "s", "v")
    steps = grid(held, by, step, start, end)
    both = held.select(*by, F.col("s").alias("place"), F.lit(0).alias("side"), F.struct("s", "v").alias("p")).unionByName(
        steps.select(*by, F.col("t").alias("place"), F.lit(1).alias("side"), F.lit(None).cast("struct<s: double, v: double>").alias("p"))
    )
    last = F.last("p", ignorenulls=True).over(W.partitionBy(*by).orderBy("place", "side").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = both.withColumn("last", last).where("side = 1")
    return found.where(F.col("place") - F.col("last.s") < stale).select(*by, F.col("place").alias("t"), F.col("last.v").alias("value"))


def by_label(vector: DataFrame, label: Column, name: str, what: str, how=F.sum) -> DataFrame:
    """A vector's series brought together by a label: ``how`` of ``what`` at each step."""
    return vector.groupBy(label.alias(name), "t").agg(how(what).alias(what))
