"""Every query with SQL gives the rows that another engine gives for it."""

import math

import duckdb
import pytest

from corpusmill.jobs import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value.isoformat()[:19] if hasattr(value, "isoformat") else value


def sorted_rows(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_rows_match_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in registry.ORACLES:
        assert columns
        return
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert sorted_rows(rows) == sorted_rows(tuple(r[i] for i in order) for r in found.fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
