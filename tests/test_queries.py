"""Every registered query against the same rows by DuckDB."""

import duckdb
import pytest
from where import SF

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = sorted(entry.core.QUERIES)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(None if v != v else v for v in r)) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    ours = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(ours) > 0
        return
    theirs = duck.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    if name == "computed_shard":
        ours["shard"], theirs["shard"] = ours["shard"].astype("Int64"), theirs["shard"].astype("Int64")
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
