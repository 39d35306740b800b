"""Every query of the catalogue against its SQL in DuckDB, and the entry points."""

import duckdb
import pytest

import __spark_entry__
from gridscribe.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(repr(tuple(r[n] for n in names)) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sql, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toArrow(), sql.execute(ORACLES[name]).to_arrow_table()
    assert rows(got) == rows(want)
    assert [str(got.schema.field(n).type) for n in sorted(got.column_names)] == [str(want.schema.field(n).type) for n in sorted(want.column_names)]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_wrapped_lines_are_no_wider(spark, sf_dir):
    got = QUERIES["wrap_lines"](spark, sf_dir)
    assert got.where("widest > 60").count() == 0
