"""Every query with an oracle agrees with DuckDB on the sf0.001 tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from attriscope.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
ORACLE = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(None if (x is None or (isinstance(x, float) and math.isnan(x))) else _norm(x) for x in rec)
           for rec in pdf[cols].itertuples(index=False)]
    return cols, sorted(out, key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF).toPandas()
    dd = con.execute(ORACLE[name]).df()
    c1, r1 = _rows(sp)
    c2, r2 = _rows(dd)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "avg_risk" in df.columns
