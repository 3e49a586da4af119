"""Every query with SQL gives the same rows as DuckDB on the same files."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SQL = contract.oracle_sql()
ROWS_ONLY = [n for n in contract.queries() if n not in SQL]
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "tinyint": "TINYINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def database(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, database, name):
    df = contract.queries()[name](spark, sf_dir)
    cursor = database.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema.fields} == kinds
    order = sorted(columns)
    ours = sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)
    theirs = sorted((tuple(r[columns.index(c)] for c in order) for r in expected), key=str)
    assert ours == theirs


@pytest.mark.parametrize("name", [n for n in ROWS_ONLY if n in ("fit_linear", "fit_boost_quantile", "train_run")])
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert contract.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry_columns(spark) == ["model", "split", "MAE", "RMSE", "MAPE", "R2"]


def entry_columns(spark):
    df = contract.entry(spark)
    assert df.count() == 3
    return df.columns
