"""Every query with SQL of its own gives DuckDB's rows."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_oracle(spark, oracle, name):
    found = contract.queries()[name](spark, SF)
    expected = oracle.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(columns)
    got, want = normal(found.columns, found.collect()), normal(columns, expected.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
