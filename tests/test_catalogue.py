"""Every query of the library runs on the smallest tables, and gives what its SQL gives."""

import math
from pathlib import Path

import duckdb
import pytest

from lexispan.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf):
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def rows(columns, data):
    plain = lambda v: None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, connection, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got or name == "pluta_cleaning"  # these tables have no prolated vowels; the vectors are in test_cleaning
        return
    found = connection.sql(SQL[name])
    want = rows(found.columns, found.fetchall())
    assert sorted(df.columns) == sorted(found.columns) and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6)) for x, y in zip(a, b, strict=True)), (a, b)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
