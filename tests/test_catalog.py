"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from dossier import catalog
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = catalog.queries()[name](spark, DATA)
    said = duck.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == sorted(said.columns)
    assert _rows([tuple(r) for r in found.collect()], found.columns) == _rows(said.fetchall(), said.columns)
