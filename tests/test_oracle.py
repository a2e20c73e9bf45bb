"""Every registered query that SQL can express gives the rows that DuckDB gives."""

import math
from collections import Counter

import duckdb
import pytest

from fourfold import catalog, catalog_stores

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda x: round(x, 9) if isinstance(x, float) and math.isfinite(x) else x
    return sorted(n.lower() for n in names), Counter(tuple(plain(r[k]) for k in order) for r in rows)


QUERIES = catalog.queries() | catalog_stores.queries()
SQL = catalog.oracle_sql() | catalog_stores.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    told = duck.execute(SQL[name])
    names = [d[0] for d in told.description]
    assert bag(found.collect(), found.columns) == bag(told.fetchall(), names)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert not set(catalog.queries()) & set(catalog_stores.queries())
