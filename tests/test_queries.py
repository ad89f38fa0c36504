"""Every library query that has SQL gives the same rows as it on the smallest tables."""

import os

import duckdb
import pytest

from shoebox.plans import ingest, library, people, search  # noqa: F401
from shoebox.sources.tables import BASE

FOLDER = "/root/testdata/sf0.001"


def normal(rows):
    def value(x):
        if isinstance(x, float):
            return round(x, 6) + 0.0
        return tuple(map(value, x)) if isinstance(x, list | tuple) else x

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in BASE:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, tables, name):
    found = library.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = normal(found.select(columns).collect())
    if name in library.SQL:
        names = ", ".join(f'"{c}"' for c in columns)
        assert rows == normal(tables.sql(f"SELECT {names} FROM ({library.SQL[name]})").fetchall())
    else:
        assert rows
