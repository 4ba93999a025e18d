"""The formula scorer of the stand-in view, as a Column function.

It is written with the same operation order as the view text so that a
re-scored scenario (what-if, intervention) gives bit-identical doubles to the
view's own ``Risk`` for unchanged inputs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def formula_margin(overtime="OverTime", income="MonthlyIncome", job_sat="JobSatisfaction",
                   wlb="WorkLifeBalance", age="Age") -> Column:
    ot = F.when(_c(overtime) == F.lit("Yes"), F.lit(1.2)).otherwise(F.lit(-0.6))
    return (ot
            + (F.lit(5000.0) - _c(income)) / F.lit(4000.0)
            + (F.lit(2.5) - _c(job_sat)) * F.lit(0.4)
            + (F.lit(2.5) - _c(wlb)) * F.lit(0.2)
            + (F.lit(35.0) - _c(age)) / F.lit(40.0)
            - F.lit(0.6))


def formula_risk(**cols) -> Column:
    m = formula_margin(**cols)
    return F.lit(0.5) + F.lit(0.5) * m / (F.lit(1.0) + F.abs(m))


# Linear part of the margin: feature -> coefficient (fixed values of the scorer).
# OverTime enters as the indicator OverTime_Yes with weight 1.8 (1.2 vs -0.6).
LINEAR_TERMS = {
    "OverTime_Yes": 1.8,
    "MonthlyIncome": -1.0 / 4000.0,
    "JobSatisfaction": -0.4,
    "WorkLifeBalance": -0.2,
    "Age": -1.0 / 40.0,
}
