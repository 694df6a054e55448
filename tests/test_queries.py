"""Every registered query with SQL against DuckDB; the others must give rows."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    result = QUERIES[name](spark, FOLDER)
    columns = sorted(result.columns)
    expected = con.sql(ORACLE[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(column) for column in columns]
    want = sorted(tuple(plain(row[i]) for i in order) for row in expected.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in result.collect()) == want
    assert want


@pytest.mark.parametrize("name", ["topic_map", "topic_matching", "model_sweep", "model_evaluation", "model_heldout", "chunk_topics"])
def test_model_queries_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
