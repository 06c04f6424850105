"""Every registered array query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from arrayframe.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def normal(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, small, name):
    frame = QUERIES[name](spark, small)
    got = duck.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(got.columns)
    names = sorted(frame.columns)
    a = sorted(tuple(normal(r[c]) for c in names) for r in frame.collect())
    at = [got.columns.index(c) for c in names]
    b = sorted(tuple(normal(r[i]) for i in at) for r in got.fetchall())
    assert a == b


def test_entry_and_registration(spark):
    assert driver.entry(spark).count() == 2
    assert set(QUERIES) <= set(driver.queries())
    assert set(ORACLES) == set(QUERIES)


def test_rest_does_not_import_the_corpus_operators():
    from pathlib import Path

    root = Path(driver.__file__).parent / "arrayframe"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text(), f
