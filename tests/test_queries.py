"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from orrery.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, DIR).toPandas()
    if name not in registry.oracle_sql():
        assert len(got)
        return
    want = db.sql(registry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    want, got = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (want, got))
    assert want.equals(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
