"""Every registered query that has an oracle gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
OWN = sorted(n for n in QUERIES if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def tables(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(repr(r[c]) for c in names) for r in table.to_pylist())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in OWN if n in ORACLES])
def test_query_matches_oracle(name, spark, sf_dir, tables):
    assert rows(QUERIES[name](spark, sf_dir).toArrow()) == rows(tables.sql(ORACLES[name]).to_arrow_table())


@pytest.mark.parametrize("name", [n for n in OWN if n not in ORACLES])
def test_query_without_oracle_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).columns


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
