"""State that follows the rows of a key in order, without holding them and without a task for each key."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from kbspark.sources.scratch import checkpointed


def fold(rows: DataFrame, key: str, order: list[str], takes: list[str], start: Any, step: Callable, to: str, kind: DataType) -> DataFrame:
    """``rows`` with a column ``to``: what ``step(state, *takes)``, which gives the next state and a
    result, says for each row of a key in ``order``; every key begins with ``start``.

    Rows are dealt by ranges of key and order, so a key of any size is cut into slices over as many
    tasks as it needs, and a slice passes through its task as a stream. Each slice is first run from
    ``start``. Where a key goes on from the slice before, the state that reaches its border is carried over
    and slices that lie in one key as a whole are run again from it, side by side, until no border
    changes; states that forget, as limits and locks with a time do, settle in a round or two, and others
    in as many as the key has slices. Only one state for each slice comes to the driver. Rows with a null
    key are a key of their own; ``order`` must tell the rows of a key apart, or equal ones come in any order.
    """
    names = rows.columns
    at, given = names.index(key), [names.index(c) for c in takes]
    slices_ = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = checkpointed(rows.repartitionByRange(slices_, key, *order).sortWithinPartitions(key, *order))

    def follow(batches: Iterator[pa.RecordBatch], entry: Any, report: dict) -> Iterator[tuple[pa.RecordBatch, list]]:
        state, last = entry, None
        for b in batches:
            results = []
            for k, *values in zip(b.column(at).to_pylist(), *[b.column(i).to_pylist() for i in given], strict=True):
                if "first" not in report:
                    report["first"], report["whole"] = k, True
                elif k != last:
                    state, report["whole"] = start, False
                last = k
                state, result = step(state, *values)
                results.append(result)
            yield b, results
        report["last"], report["state"] = last, state

    def slices(entries: dict[int, bytes] | None) -> dict[int, tuple]:
        """What each slice, or each of ``entries``, says of itself: first and last key, whether these are one, last state."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, report = TaskContext.get().partitionId(), {}
            if entries is None or number in entries:
                for _ in follow(batches, start if entries is None else pickle.loads(entries[number]), report):
                    pass
            body = [pickle.dumps((report["first"], report["last"], report["whole"], report["state"]))] if "first" in report else []
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(body), pa.int32()), pa.array(body, pa.binary())], ["number", "body"])

        return {r["number"]: pickle.loads(r["body"]) for r in held.mapInArrow(run, "number int, body binary").collect()}

    seen = slices(None)
    numbers = sorted(seen)
    entered: dict[int, Any] = dict.fromkeys(numbers, start)
    while True:
        wanted = {}
        for before, n in zip(numbers, numbers[1:], strict=False):
            state = seen[before][3] if seen[before][1] == seen[n][0] else start
            if state != entered[n]:
                entered[n] = state
                if seen[n][2]:  # its last state depends on the one it is entered with
                    wanted[n] = pickle.dumps(state)
        if not wanted:
            break
        seen |= slices(wanted)
    entries = {n: pickle.dumps(s) for n, s in entered.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        entry = pickle.loads(entries[number]) if number in entries else start
        for b, results in follow(batches, entry, {}):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(results, to_arrow_type(kind))], [*names, to])

    return held.mapInArrow(run, StructType([*rows.schema.fields, StructField(to, kind)]))
