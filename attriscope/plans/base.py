"""Registration helpers: a query is (spark, sf_dir) -> DataFrame, with optional oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attriscope.sources.tables import employee_view_duckdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def with_v(body: str, *ctes: str) -> str:
    """Oracle text: the shared employee view as CTE ``v`` followed by ``body``."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH v AS ({employee_view_duckdb()}){extra}\n{body}"


LOSS_SQL = "CASE WHEN Risk < 0.2E0 THEN 0E0 ELSE MonthlyIncome * 6E0 * Risk END"
MEDIAN_SQL = "(SELECT quantile_cont(MonthlyIncome, 0.5) FROM v)"


_FITTED: dict = {}


def fitted_features(spark, sf: str, version: str):
    """The fitted feature pipeline of the scored table, once per application and tables."""
    from attriscope.operators.features import fit_features
    from attriscope.sources.tables import stored_employees

    key = (spark.sparkContext.applicationId, sf, version)
    if key not in _FITTED:
        _FITTED[key] = fit_features(stored_employees(spark, sf), version)
    return _FITTED[key]
