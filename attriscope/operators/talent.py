"""Nine-box inputs: potential score and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attriscope.functions.bands import band_label


def potential_score(edu="Education", involvement="JobInvolvement", since_promo="YearsSinceLastPromotion"):
    """Education/5*30 + JobInvolvement/4*40 + (10 - min(YearsSinceLastPromotion, 10))/10*30.

    ``least`` skips nulls, so the clip is guarded to keep a null input null.
    """
    ysp = F.col(since_promo)
    clipped = F.when(ysp.isNull(), F.lit(None)).otherwise(F.least(ysp, F.lit(10)))
    return (F.col(edu) / F.lit(5) * F.lit(30)
            + F.col(involvement) / F.lit(4) * F.lit(40)
            + (F.lit(10) - clipped) / F.lit(10) * F.lit(30))


def talent_grid(emp: DataFrame) -> DataFrame:
    ps = potential_score()
    return emp.select("EmployeeNumber", "PerformanceRating", ps.alias("potential_score"),
                      band_label(ps, "potential").alias("potential_band"),
                      band_label("Risk", "ninebox_risk").alias("risk_band"), "Risk")
