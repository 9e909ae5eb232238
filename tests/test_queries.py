"""Each query against its SQL twin, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        found.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return found


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    result = db.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(str(tuple(r[k] for k in at)) for r in result.fetchall())


def test_entry_works_without_the_training_data_package(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
