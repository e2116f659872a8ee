"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.skew import join_found as lookup  # noqa: F401  (the operators take it from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; a temporary one is made only
    where that is unset and Spark runs on this machine alone, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="kbspark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage. Spark removes the files once the frame
    is unreachable if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on; else they stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: for frames with whole texts, and in loops with joins."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def rows(batches: Iterable[pa.RecordBatch], per: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller slices of the same batches, so that what is derived from one slice stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, per):
            yield batch.slice(at, per)


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names: other columns, whatever their names, cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def hex64(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")

