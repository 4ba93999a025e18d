"""Test tables and the employee stand-in view.

The reference reads one employee table.  The driver's tables have none, so an
employee-grained view is derived from ``customer``, ``nation`` and ``orders``
(one employee per customer).  The text below is the single definition shared by
the Spark side (``spark.sql`` with DataFrame arguments) and the DuckDB oracle
(plain table names), so both engines see the same rows.

``Risk`` is a fixed formula scorer (exact IEEE operations only), standing in
for a trained model wherever a report must be checked against an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed stand-in definition (shared with the oracle; do not edit one side only).
EMPLOYEE_VIEW_SQL = """
WITH o AS (
  SELECT o_custkey,
         COUNT(*) AS n_orders,
         MIN(YEAR(o_orderdate)) AS first_year,
         MAX(YEAR(o_orderdate)) AS last_year,
         COUNT(DISTINCT YEAR(o_orderdate)) AS active_years,
         SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS n_urgent,
         SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_f,
         SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS n_o,
         SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS n_p,
         MAX(o_orderdate) AS last_ts
  FROM {orders} GROUP BY o_custkey),
b AS (
  SELECT CAST(c.c_custkey AS BIGINT) AS EmployeeNumber,
         c.c_mktsegment AS Department,
         n.n_name AS JobRole,
         CAST(c.c_acctbal AS DOUBLE) + 1000E0 AS MonthlyIncome,
         CAST(18 + (c.c_custkey * 7) % 48 AS INT) AS Age,
         CAST(COALESCE(o.n_orders, 0) AS INT) AS TotalWorkingYears,
         CAST(COALESCE(o.last_year - o.first_year, 0) AS INT) AS YearsAtCompany,
         CAST(COALESCE(2001 - o.last_year, 0) AS INT) AS YearsSinceLastPromotion,
         CAST(COALESCE(o.active_years, 0) AS INT) AS YearsInCurrentRole,
         CAST(c.c_custkey % 10 AS INT) AS NumCompaniesWorked,
         CAST(1 + c.c_nationkey % 5 AS INT) AS Education,
         CAST(1 + c.c_nationkey AS INT) AS DistanceFromHome,
         CAST(1 + COALESCE(o.n_p, 0) % 4 AS INT) AS JobInvolvement,
         CAST(1 + COALESCE(o.n_o, 0) % 4 AS INT) AS JobSatisfaction,
         CAST(1 + COALESCE(o.n_f, 0) % 4 AS INT) AS EnvironmentSatisfaction,
         CAST(1 + (COALESCE(o.n_f, 0) + COALESCE(o.n_p, 0)) % 4 AS INT) AS WorkLifeBalance,
         CAST(1 + c.c_custkey % 4 AS INT) AS RelationshipSatisfaction,
         CAST(CASE WHEN COALESCE(o.n_f, 0) >= 5 THEN 4 ELSE 3 END AS INT) AS PerformanceRating,
         CAST(100 + (c.c_custkey * 37) % 1400 AS INT) AS DailyRate,
         CASE WHEN COALESCE(o.n_urgent, 0) >= 3 THEN 'Yes' ELSE 'No' END AS OverTime,
         CASE WHEN o.last_ts IS NULL OR o.last_ts < TIMESTAMP '2000-12-01 00:00:00'
              THEN 'Yes' ELSE 'No' END AS Attrition,
         CAST(1 AS INT) AS EmployeeCount, 'Y' AS Over18, CAST(80 AS INT) AS StandardHours
  FROM {customer} c
  JOIN {nation} n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN o ON c.c_custkey = o.o_custkey),
z AS (
  SELECT b.*,
         (CASE WHEN OverTime = 'Yes' THEN 1.2E0 ELSE -0.6E0 END)
         + (5000E0 - MonthlyIncome) / 4000E0
         + (2.5E0 - JobSatisfaction) * 0.4E0
         + (2.5E0 - WorkLifeBalance) * 0.2E0
         + (35E0 - Age) / 40E0 - 0.6E0 AS RiskMargin
  FROM b)
SELECT z.*, 0.5E0 + 0.5E0 * RiskMargin / (1E0 + ABS(RiskMargin)) AS Risk FROM z
"""

# Columns of the view in order (schema contract of the employee table).
EMPLOYEE_COLUMNS = [
    "EmployeeNumber", "Department", "JobRole", "MonthlyIncome", "Age", "TotalWorkingYears",
    "YearsAtCompany", "YearsSinceLastPromotion", "YearsInCurrentRole", "NumCompaniesWorked",
    "Education", "DistanceFromHome", "JobInvolvement", "JobSatisfaction",
    "EnvironmentSatisfaction", "WorkLifeBalance", "RelationshipSatisfaction",
    "PerformanceRating", "DailyRate", "OverTime", "Attrition", "EmployeeCount", "Over18",
    "StandardHours", "RiskMargin", "Risk",
]

_registry: dict[tuple[int, str], DataFrame] = {}
_stored: dict[tuple[int, str], DataFrame] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table (column pruning / pushdown by Catalyst)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored employee table for ``sf_dir``.

    Lazy by default (Catalyst prunes the view per query); after
    :func:`register_employees` it is the materialized copy instead.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _registry:
        return _registry[key]
    return spark.sql(
        EMPLOYEE_VIEW_SQL,
        orders=load(spark, sf_dir, "orders"),
        customer=load(spark, sf_dir, "customer"),
        nation=load(spark, sf_dir, "nation"),
    )


def register_employees(spark: SparkSession, sf_dir: str, df: DataFrame | None = None) -> DataFrame:
    """Persist the scored table once (written to the shared folder) and reuse it."""
    from attriscope.session import materialize

    key = (spark.sparkContext.applicationId, sf_dir)
    _registry.pop(key, None)
    src = df if df is not None else employees(spark, sf_dir)
    out = materialize(src, "employees")
    _registry[key] = out
    return out


def stored_employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`employees` written once for each application, for plans that read it several times.

    Each read of the lazy view scans, groups and joins all orders again.
    """
    from attriscope.session import materialize

    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _registry:
        return _registry[key]
    if key not in _stored:
        _stored[key] = materialize(employees(spark, sf_dir), "employees")
    return _stored[key]


def forget_employees(spark: SparkSession, sf_dir: str) -> None:
    _registry.pop((spark.sparkContext.applicationId, sf_dir), None)
    _stored.pop((spark.sparkContext.applicationId, sf_dir), None)


def employee_view_duckdb() -> str:
    """The same view text with the plain table names (oracle side)."""
    return EMPLOYEE_VIEW_SQL.format(orders="orders", customer="customer", nation="nation")
