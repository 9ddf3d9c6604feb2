"""Every query with oracle SQL must match DuckDB on the smallest scale."""

import math

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as entry
from cohortlens.sources.io import TABLES

_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.sql(ORACLE[name])
    assert sorted(sdf.columns) == sorted(res.columns)
    spark_types = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    duck_types = {c: str(t) for c, t in zip(res.columns, res.types)}
    assert spark_types == duck_types
    drows = res.fetchall()
    assert len(srows) == len(drows)
    assert _rows(sdf.columns, srows) == _rows(res.columns, drows)
