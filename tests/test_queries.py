"""Every registered query of the core against its SQL twin in DuckDB, on small tables."""

import duckdb
import pytest

from stockwell import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df, columns):
    values = df[columns].astype(object).where(df[columns].notna(), None).values.tolist()
    return sorted(values, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck, sf_dir):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert rows(got, columns) == rows(want, columns)
    assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
