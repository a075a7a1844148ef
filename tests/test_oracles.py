"""Every registered query against its SQL statement in DuckDB, value by value."""

import math
import time
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from wickstore.plans.oracles import ORACLES
from wickstore.plans.queries import QUERIES as CATALOG

QUERIES = {name: query for name, query in entry_points.queries().items() if name in CATALOG}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((value is None, str(type(value)), str(value)) for value in row),
    )


# No query joins everything with everything or goes through Python workers.
FORBIDDEN = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "FlatMapGroupsInPandas",
)

SPARK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def test_catalogs_agree():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf_dir, duck, name):
    began = time.time()
    frame = QUERIES[name](spark, sf_dir)
    got = frame.collect()
    took = time.time() - began
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]
    result = duck.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    types = {column[0]: str(column[1]) for column in result.description}
    want = result.fetchall()
    print(f"\n{name}: {len(got)} rows, {took:.2f}s")
    assert sorted(frame.columns) == sorted(names)
    assert {n: SPARK_TYPES[t] for n, t in frame.dtypes} == types
    assert len(got) == len(want)
    assert got, "an empty result proves nothing"
    assert _rows(frame.columns, got) == _rows(names, want)


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.count() > 0
    assert frame.columns[:5] == ["data_type", "exchange", "coin", "interval", "timestamp"]
