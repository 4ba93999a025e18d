"""The reference's four unit vectors plus the edges read from its code."""

import pytest
from pyspark.sql import functions as F

from attriscope.functions.finance import expected_loss, roi


def _one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} double" for k in cols))
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("prob,income,expected", [
    (0.1, 5000.0, 0.0),        # below 0.2: no loss
    (0.5, 1000.0, 3000.0),     # 1000 * 6 * 0.5
    (0.2, 1000.0, 1200.0),     # 0.2 itself is charged
    (0.19999, 1000.0, 0.0),
])
def test_expected_loss(spark, prob, income, expected):
    assert _one(spark, expected_loss("p", "i"), p=prob, i=income) == pytest.approx(expected)


def test_expected_loss_null(spark):
    df = spark.createDataFrame([(None, 1000.0)], "p double, i double")
    assert df.select(expected_loss("p", "i").alias("r")).first()["r"] is None


@pytest.mark.parametrize("saving,investment,expected", [
    (5000.0, 1000.0, 400.0),
    (5000.0, 0.0, 0.0),        # zero investment: 0, no error
    (5000.0, -10.0, 0.0),      # negative investment: 0
    (500.0, 1000.0, -50.0),
])
def test_roi(spark, saving, investment, expected):
    assert _one(spark, roi("s", "v"), s=saving, v=investment) == pytest.approx(expected)


def test_loss_is_catalyst_expression(spark):
    df = spark.range(3).select((F.col("id") / 4).alias("p"), F.lit(1000.0).alias("i"))
    plan = df.select(expected_loss("p", "i")).__getattribute__("_jdf").queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
