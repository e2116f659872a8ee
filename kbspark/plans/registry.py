"""All registered queries on the reference's operators, with their SQL equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kbspark.plans import documents, files, indexed, inputs, more_rules, native, operations, rules, search, structures  # noqa: F401  (they register their queries)
from kbspark.plans.portable import PORTABLE as FIRST
from kbspark.plans.portable_more import PORTABLE as MORE
from kbspark.sources.tables import TABLES, load

Query = Callable[[SparkSession, str], DataFrame]


def portable(text: str) -> Query:
    """A query that runs ``text`` over views of just the tables it names."""
    named = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in named:
            load(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(text)

    return run


PORTABLE = FIRST | MORE
QUERIES: dict[str, Query] = {name: portable(text) for name, text in PORTABLE.items()} | native.QUERIES
SQL: dict[str, str] = PORTABLE | native.SQL
