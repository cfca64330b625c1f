"""Every query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from datetime import datetime

import duckdb
import pytest

from planeweave.plans import catalogue
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v.isoformat() if isinstance(v, datetime) else v


def rows(columns, found):
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: [(v is None, str(type(v)), v) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    sql = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema.fields} == dict(zip(sql.columns, map(str, sql.types), strict=True))
    at = [sql.columns.index(c) for c in columns]
    assert rows(columns, [[r[c] for c in columns] for r in df.collect()]) == rows(columns, [[r[i] for i in at] for r in sql.fetchall()])


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_no_sort_in_one_task(spark):
    """A recording's intervals are an equi-join, not a window over all of it."""
    plan = catalogue.queries()["frame_intervals"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("name", ["monotonic_check", "qc_report", "qc_timestamp_not_monotonic"])
def test_windows_are_on_blocks(spark, name):
    """No window sorts a whole recording: those that are not over the ends of blocks are partitioned by block as well."""
    plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert windows and all("_b#" in x for x in windows) and "SinglePartition" not in plan
