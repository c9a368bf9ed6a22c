"""Every registered query of the library gives its oracle's rows at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from colloquy.plans import queries as plans
from colloquy.plans.fixtures import TABLES


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_the_oracle(spark, duck, sf_dir, name):
    want = duck.execute(plans.ORACLES[name])
    names = [c[0] for c in want.description]
    df = plans.QUERIES[name](spark, sf_dir)
    order = sorted(df.columns)
    assert sorted(names) == order
    got = sorted(repr([r[c] for c in order]) for r in df.collect())
    assert got == sorted(repr([r[names.index(c)] for c in order]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["chunk_id", "recording_id", "title", "start_ms", "end_ms", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
