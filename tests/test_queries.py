"""Every registered query of the library against DuckDB."""

import math
import os

import duckdb
import pytest

from quillon.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


def plain(v):
    if v is None or str(v) in ("NaT", "<NA>", "nan"):
        return None
    if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "") in ("i", "u", "f") and not getattr(v, "ndim", 0):
        return None if math.isnan(v) else round(float(v), 6)
    return tuple(v) if hasattr(v, "__iter__") and not isinstance(v, str) else str(v)


def rows(frame, columns):
    return sorted((tuple(map(plain, t)) for t in frame[columns].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
