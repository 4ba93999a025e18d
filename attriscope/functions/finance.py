"""Money expressions (JVM-side Catalyst expressions, null in gives null out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the cost model.
LOSS_FLOOR_PROB = 0.2     # below this probability no loss is charged (0.2 itself is charged)
LOSS_MONTHS = 6.0         # replacement cost = six monthly salaries


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def expected_loss(prob, income) -> Column:
    """0 when prob < 0.2, else income * 6 * prob."""
    p, inc = _c(prob), _c(income)
    return F.when(p < F.lit(LOSS_FLOOR_PROB), F.lit(0.0)).otherwise(inc * F.lit(LOSS_MONTHS) * p)


def roi(saving, investment) -> Column:
    """ROI percent: 0 when investment <= 0, else (saving - investment) / investment * 100."""
    s, i = _c(saving), _c(investment)
    return F.when(i <= F.lit(0.0), F.lit(0.0)).otherwise((s - i) / i * F.lit(100.0))
