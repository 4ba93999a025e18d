"""Right-closed binning ``(a, b]`` with ordered labels, and empty-band completion.

``pandas.cut`` semantics: a value equal to the lowest edge, below it or above
the top edge gets no band (null).  Spark's ``Bucketizer`` is left-closed, so the
bands are generated as ``when`` chains instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Band:
    name: str
    edges: tuple
    labels: tuple


# Fixed band schemes (edges and label order of the reports).
BANDS = {
    "risk3": Band("risk3", (0.0, 0.3, 0.6, 1.0), ("Low", "Medium", "High")),
    "ninebox_risk": Band("ninebox_risk", (0.0, 0.3, 0.6, 1.0), ("Safe", "Risky", "Critical")),
    "risk5": Band("risk5", (0.0, 0.2, 0.4, 0.6, 0.8, 1.0), ("Very Low", "Low", "Medium", "High", "Critical")),
    "potential": Band("potential", (0.0, 45.0, 75.0, 100.0), ("Low", "Medium", "High")),
    "age": Band("age", (17, 25, 30, 35, 40, 50, 65), ("18-25", "26-30", "31-35", "36-40", "41-50", "51-65")),
    "tenure": Band("tenure", (-1, 1, 3, 5, 10, 40), ("0-1 yrs", "2-3 yrs", "4-5 yrs", "6-10 yrs", "10+ yrs")),
}


def _scheme(b) -> Band:
    return BANDS[b] if isinstance(b, str) else b


def band_index(x, scheme) -> Column:
    """0-based band position or null (right-closed)."""
    b = _scheme(scheme)
    col = F.col(x) if isinstance(x, str) else x
    expr = None
    for i in range(len(b.labels)):
        cond = (col > F.lit(b.edges[i])) & (col <= F.lit(b.edges[i + 1]))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def band_label(x, scheme) -> Column:
    b = _scheme(scheme)
    col = F.col(x) if isinstance(x, str) else x
    expr = None
    for i, lab in enumerate(b.labels):
        cond = (col > F.lit(b.edges[i])) & (col <= F.lit(b.edges[i + 1]))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def band_dim(spark: SparkSession, scheme, ix_col: str = "band_ix", label_col: str = "band") -> DataFrame:
    """The band dimension (one row per band, in order); a handful of rows by definition."""
    b = _scheme(scheme)
    return spark.createDataFrame(list(enumerate(b.labels)), f"{ix_col} int, {label_col} string")


def complete_bands(agg: DataFrame, scheme, ix_col: str = "band_ix", label_col: str = "band",
                   fill: dict | None = None) -> DataFrame:
    """Keep empty bands: band dimension LEFT JOIN the per-band aggregate.

    ``agg`` is keyed by ``ix_col`` and so has at most one row per band (plus
    the null band): the broadcast side is bounded by the scheme, not the data.
    """
    dim = band_dim(agg.sparkSession, scheme, ix_col, label_col)
    out = dim.join(F.broadcast(agg), on=ix_col, how="left")
    for c, v in (fill or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out
