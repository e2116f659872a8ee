"""Every registered query of the reference's operators against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from kbspark.plans import registry
from kbspark.sources.tables import TABLES

from .conftest import SF


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, float):
            return f"{v:.6f}"
        return v.isoformat()[:19].replace("T", " ") if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, con, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = normal(frame.select(*[f"`{c}`" for c in columns]).collect())
    if name in registry.SQL:
        want = con.sql(registry.SQL[name])
        assert sorted(want.columns) == columns
        assert got == normal(want.project(",".join(f'"{c}"' for c in columns)).fetchall())
    else:
        assert got
