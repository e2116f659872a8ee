"""Change events and windowed counts over streams of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def apply_watch(stream: DataFrame, key: str = "user_id", state: str = "event_type", order: str = "event_id") -> DataFrame:
    """``(key, order, change)``: created, updated, none or deleted for each watch event.

    One state per key holds the last value; ``deleted`` removes it, so that a revived key counts as
    created. Events without a key are ignored. Within a batch events are applied in ``order``.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, value in zip(rows[order], rows[state], strict=True):
            if value == "deleted":
                out.append((k[0], o, "deleted" if last is not None else "none"))
                last = None
            else:
                out.append((k[0], o, "created" if last is None else "none" if value == last else "updated"))
                last = value
        if last is None:
            held.remove() if held.exists else None
        else:
            held.update((last,))
        yield pd.DataFrame(out, columns=[key, order, "change"])

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    return (
        stream.where(F.col(key).isNotNull())
        .groupBy(key)
        .applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, change string", "last string", "append", GroupStateTimeout.NoTimeout)
    )


def windowed_counts(stream: DataFrame, ts: str = "ts", width: str = "15 minutes", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts per tumbling window and ``by``; rows later than ``late`` are dropped, as the watermark says."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def resolution(hours: float) -> str:
    """The bucket width for a time range: up to 1 h a minute, up to 4 h five, else fifteen."""
    return "1 minute" if hours <= 1 else "5 minutes" if hours <= 4 else "15 minutes"
