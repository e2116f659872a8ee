"""Python rules on columns, some rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Rows, and bytes unless one row has more, that are Python objects at once, whatever the size of Spark's batches.
ROWS, BYTES = 64, 1 << 20
SIMPLE = {S.StringType: pa.string(), S.BinaryType: pa.binary(), S.IntegerType: pa.int32(), S.LongType: pa.int64(), S.DoubleType: pa.float64(), S.BooleanType: pa.bool_()}


def arrow_of(kind: S.DataType) -> pa.DataType:
    if isinstance(kind, S.ArrayType):
        return pa.list_(arrow_of(kind.elementType))
    if isinstance(kind, S.StructType):
        return pa.struct([(f.name, arrow_of(f.dataType)) for f in kind.fields])
    return SIMPLE[type(kind)]


def pieces(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """The same rows in slices of at most ``ROWS`` and about ``BYTES``."""
    at, total = 0, len(columns[0])
    while at < total:
        n = min(ROWS, total - at)
        while n > 1 and sum(c.slice(at, n).nbytes for c in columns) > BYTES:
            n //= 2
        yield tuple(c.slice(at, n) for c in columns)
        at += n


def values(column: pa.Array) -> list:
    """Python values; structs in a list are tuples."""
    found = column.to_pylist()
    if pa.types.is_list(column.type) and pa.types.is_struct(column.type.value_type):
        return [x and [e and tuple(e.values()) for e in x] for x in found]
    return found


def by_row(rule: Callable, kind: str) -> Callable[..., Column]:
    """A column function of type ``kind`` that calls ``rule`` with the values of each row; structs in
    lists come and go as tuples. Results leave in slices, so no batch of them is held."""
    made = arrow_of(S.StructType.fromDDL(f"x {kind}")["x"].dataType)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            for part in pieces(*(columns if isinstance(columns, (tuple, list)) else (columns,))):
                yield pa.array([rule(*v) for v in zip(*[values(c) for c in part], strict=True)], made)

    return F.arrow_udf(run, kind)
