"""Batch scoring of a roster: features, probability, percent, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attriscope.functions.scorer import formula_risk

RISK_PCT = "AttritionRiskPct"


def score_formula(df: DataFrame) -> DataFrame:
    """Stand-in scorer: the fixed formula of the view (same doubles as the view's ``Risk``)."""
    return df.withColumn("Risk", formula_risk())


def score_roster(df: DataFrame, scorer=score_formula) -> tuple[DataFrame, DataFrame]:
    """Returns (display, export): the 4-column view sorted by risk, and every column + percent."""
    scored = scorer(df).withColumn(RISK_PCT, F.bround(F.col("Risk") * F.lit(100.0), 2))
    export = scored.drop("Risk")
    display = (scored.select("EmployeeNumber", "JobRole", "Department", RISK_PCT)
                     .orderBy(F.col(RISK_PCT).desc(), "EmployeeNumber"))
    return display, export
