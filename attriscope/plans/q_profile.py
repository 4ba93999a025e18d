"""Profile and feature queries."""

from pyspark.sql import functions as F

from attriscope.operators import features as FE
from attriscope.operators import profile as P
from attriscope.operators.common import round_cols
from attriscope.plans.base import fitted_features, query, with_v
from attriscope.sources.tables import EMPLOYEE_COLUMNS, load
from attriscope.sources.tables import employees as E

# Fixed schema facts of the test tables (used to spell the oracle SQL).
LINEITEM_COLUMNS = [("l_orderkey", False), ("l_partkey", False), ("l_suppkey", False), ("l_linenumber", False),
                    ("l_quantity", True), ("l_extendedprice", True), ("l_discount", True), ("l_tax", True),
                    ("l_returnflag", False), ("l_linestatus", False), ("l_shipdate", False)]
EMP_NUMERIC = ["EmployeeNumber", "MonthlyIncome", "Age", "TotalWorkingYears", "YearsAtCompany",
               "YearsSinceLastPromotion", "YearsInCurrentRole", "NumCompaniesWorked", "Education",
               "DistanceFromHome", "JobInvolvement", "JobSatisfaction", "EnvironmentSatisfaction",
               "WorkLifeBalance", "RelationshipSatisfaction", "PerformanceRating", "DailyRate",
               "EmployeeCount", "StandardHours", "RiskMargin", "Risk"]
EMP_STRINGS = ["Department", "JobRole", "OverTime", "Attrition", "Over18"]
DEPARTMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ROLES = sorted(f"NATION_{i}" for i in range(25))
V1_NUMERIC = ["MonthlyIncome", "Age", "TotalWorkingYears", "YearsAtCompany", "YearsSinceLastPromotion",
              "YearsInCurrentRole", "NumCompaniesWorked", "Education", "DistanceFromHome", "JobInvolvement",
              "JobSatisfaction", "EnvironmentSatisfaction", "WorkLifeBalance", "RelationshipSatisfaction",
              "PerformanceRating", "DailyRate"]
RATIOS_SQL = {
    "Income_Per_Year": "CAST(MonthlyIncome AS DOUBLE) / CAST(TotalWorkingYears + 1 AS DOUBLE)",
    "Tenure_Ratio": "CAST(YearsAtCompany AS DOUBLE) / CAST(TotalWorkingYears + 1 AS DOUBLE)",
    "Education_Income_Ratio": "CAST(MonthlyIncome AS DOUBLE) / CAST(Education + 1 AS DOUBLE)",
    "Distance_Per_Income": "CAST(DistanceFromHome AS DOUBLE) / CAST(MonthlyIncome + 1 AS DOUBLE)",
    "Years_Per_Promotion": "CAST(YearsAtCompany AS DOUBLE) / CAST(YearsSinceLastPromotion + 1 AS DOUBLE)",
}


def _dummies_sql():
    out = [f'CASE WHEN Department = \'{d}\' THEN 1 ELSE 0 END AS "Department_{d}"' for d in DEPARTMENTS[1:]]
    out += [f'CASE WHEN JobRole = \'{r}\' THEN 1 ELSE 0 END AS "JobRole_{r}"' for r in ROLES[1:]]
    out.append('CASE WHEN OverTime = \'Yes\' THEN 1 ELSE 0 END AS "OverTime_Yes"')
    return out


_LABEL_SQL = "CASE WHEN Attrition = 'Yes' THEN 1 WHEN Attrition = 'No' THEN 0 END AS Attrition"


@query("scan_table", with_v("SELECT * FROM v"))
def q_scan_table(spark, sf):
    return E(spark, sf)


_NULL_ROWS = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS ordinal, "
    f"CAST(SUM(CASE WHEN {c} IS NULL{' OR isnan(' + c + ')' if fl else ''} THEN 1 ELSE 0 END) AS BIGINT) AS null_count, "
    f"ROUND_EVEN(SUM(CASE WHEN {c} IS NULL{' OR isnan(' + c + ')' if fl else ''} THEN 1 ELSE 0 END) * 100E0 / COUNT(*), 2) AS null_pct, "
    f"SUM(CASE WHEN {c} IS NULL{' OR isnan(' + c + ')' if fl else ''} THEN 1 ELSE 0 END) > 0 AS has_missing FROM lineitem"
    for i, (c, fl) in enumerate(LINEITEM_COLUMNS))


@query("null_profile", f"SELECT *, CAST(SUM(null_count) OVER () AS BIGINT) AS total_nulls FROM ({_NULL_ROWS})")
def q_null_profile(spark, sf):
    return P.null_profile(load(spark, sf, "lineitem"))


@query("numeric_summary", with_v("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT({c}) AS count, ROUND(AVG(CAST({c} AS DOUBLE)), 6) AS mean, "
    f"ROUND(STDDEV_SAMP(CAST({c} AS DOUBLE)), 6) AS std, CAST(MIN({c}) AS DOUBLE) AS min, "
    f"ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, "
    f"ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, CAST(MAX({c}) AS DOUBLE) AS max FROM v"
    for c in EMP_NUMERIC)))
def q_numeric_summary(spark, sf):
    return round_cols(P.numeric_summary(E(spark, sf), EMP_NUMERIC), {"mean": 6, "std": 6, "q25": 6, "q50": 6, "q75": 6})


@query("categorical_summary", with_v("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(SUM(c) AS BIGINT) AS count, COUNT(*) AS \"unique\", "
    f"arg_min(value, (-c, value)) AS top, MAX(c) AS freq "
    f"FROM (SELECT {c} AS value, COUNT(*) AS c FROM v WHERE {c} IS NOT NULL GROUP BY {c})"
    for c in EMP_STRINGS)))
def q_categorical_summary(spark, sf):
    return P.categorical_summary(E(spark, sf), EMP_STRINGS)


_SPARK_TYPE = ("CASE typeof(ANY_VALUE({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
               "WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' "
               "ELSE lower(typeof(ANY_VALUE({c}))) END")
_SCHEMA_ROWS = "\nUNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS ordinal, '{c}' AS column_name, {_SPARK_TYPE.format(c=c)} AS data_type, "
    f"COUNT(DISTINCT {c}) AS n_distinct FROM v" for i, c in enumerate(EMPLOYEE_COLUMNS))


@query("schema_profile", with_v(_SCHEMA_ROWS))
def q_schema_profile(spark, sf):
    return P.schema_profile(E(spark, sf))


@query("table_shape", with_v(f"SELECT COUNT(*) AS n_rows, {len(EMPLOYEE_COLUMNS)} AS n_columns FROM v"))
def q_table_shape(spark, sf):
    return P.table_shape(E(spark, sf))


_TYPE_ROWS = "\nUNION ALL ".join(f"SELECT {_SPARK_TYPE.format(c=c)} AS data_type, COUNT({c}) AS n FROM v" for c in EMPLOYEE_COLUMNS)


@query("dtype_counts", with_v(f"SELECT data_type, COUNT(*) AS n_columns, CAST(SUM(n) AS BIGINT) AS n_values FROM ({_TYPE_ROWS}) GROUP BY data_type"))
def q_dtype_counts(spark, sf):
    return P.dtype_counts(E(spark, sf))


@query("preview", with_v("SELECT " + ", ".join(EMPLOYEE_COLUMNS[:10]) + " FROM v ORDER BY EmployeeNumber LIMIT 5"))
def q_preview(spark, sf):
    return P.preview(E(spark, sf), "EmployeeNumber")


@query("zero_variance_columns", with_v("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS ordinal, CAST(MIN({c}) AS VARCHAR) AS constant FROM v "
    f"HAVING MIN({c}) IS NOT NULL AND MIN({c}) = MAX({c})"
    for i, c in enumerate(EMPLOYEE_COLUMNS))))
def q_zero_variance_columns(spark, sf):
    return P.zero_variance_columns(E(spark, sf))


@query("distinct_roles", with_v("SELECT DISTINCT JobRole FROM v WHERE JobRole IS NOT NULL"))
def q_distinct_roles(spark, sf):
    return P.distinct_values(E(spark, sf), "JobRole")


@query("ratio_features", with_v("SELECT EmployeeNumber, " + ", ".join(
    f"{e} AS {n}" for n, e in RATIOS_SQL.items()) + " FROM v"))
def q_ratio_features(spark, sf):
    return FE.ratio_features(E(spark, sf)).select("EmployeeNumber", *FE.RATIO_FEATURES)


@query("label_binarize", with_v(
    "SELECT EmployeeNumber, Attrition, CASE WHEN Attrition = 'Yes' THEN 1 WHEN Attrition = 'No' THEN 0 END AS label FROM v"))
def q_label_binarize(spark, sf):
    return E(spark, sf).select("EmployeeNumber", "Attrition", FE.label_binarize().alias("label"))


@query("one_hot", with_v("SELECT EmployeeNumber, " + ", ".join(_dummies_sql()) + " FROM v"))
def q_one_hot(spark, sf):
    emp = E(spark, sf)
    ff = fitted_features(spark, sf, "v1")
    return ff.transform(emp, with_label=False).select("EmployeeNumber", *[F.col(f"`{FE.dummy_name(c, v)}`")
                                                                         for c, v in ff.dummy_columns()])


@query("feature_matrix_v1", with_v("SELECT EmployeeNumber, " + ", ".join(V1_NUMERIC) + f", {_LABEL_SQL}, "
                                   + ", ".join(_dummies_sql()) + " FROM v"))
def q_feature_matrix_v1(spark, sf):
    return fitted_features(spark, sf, "v1").transform(E(spark, sf))


@query("feature_matrix_v2", with_v("SELECT EmployeeNumber, " + ", ".join(V1_NUMERIC) + ", "
                                   + ", ".join(f"{e} AS {n}" for n, e in RATIOS_SQL.items())
                                   + f", {_LABEL_SQL}, " + ", ".join(_dummies_sql()) + " FROM v"))
def q_feature_matrix_v2(spark, sf):
    return fitted_features(spark, sf, "v2").transform(E(spark, sf))


@query("align_features", with_v("SELECT EmployeeNumber, " + ", ".join(
    V1_NUMERIC + [f"0 AS {n}" for n in RATIOS_SQL]) + ", " + ", ".join(_dummies_sql()) + " FROM v"))
def q_align_features(spark, sf):
    """The v1 matrix aligned to the v2 manifest: ratio features absent, so 0."""
    emp = E(spark, sf)
    v1 = fitted_features(spark, sf, "v1").transform(emp)
    v2 = fitted_features(spark, sf, "v2")
    return FE.align_features(v1, v2.feature_names)


@query("one_hot_long", """WITH o AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus FROM orders),
m AS (SELECT MIN(day) AS d, MIN(o_orderstatus) AS p FROM o)
SELECT o_orderkey, 'day' AS column_name, day AS level FROM o, m WHERE day <> d
UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM o, m WHERE o_orderstatus <> p""")
def q_one_hot_long(spark, sf):
    """One-hot encoding of columns with any number of levels (over 1,000 order days)."""
    orders = load(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date").cast("string"))
    return FE.one_hot_long(orders, ["day", "o_orderstatus"], key="o_orderkey")


@query("seeded_sample", with_v("""
SELECT EmployeeNumber, Department, ROUND(Risk, 6) AS Risk FROM v
ORDER BY md5(concat('42:', CAST(EmployeeNumber AS VARCHAR))), EmployeeNumber LIMIT 100"""))
def q_seeded_sample(spark, sf):
    return round_cols(FE.seeded_sample(E(spark, sf), 100).select("EmployeeNumber", "Department", "Risk"), {"Risk": 6})


@query("order_quantiles", """
SELECT o_custkey, COUNT(*) AS n, ROUND(quantile_cont(o_totalprice, 0.25), 6) AS q25, ROUND(quantile_cont(o_totalprice, 0.5), 6) AS q50,
       ROUND(quantile_cont(o_totalprice, 0.9), 6) AS q90
FROM orders GROUP BY o_custkey""")
def q_order_quantiles(spark, sf):
    """Exact quantiles of very many groups (each customer's orders): the selection's ranges stay a table."""
    from attriscope.operators.quantiles import quantile_table

    return round_cols(quantile_table(load(spark, sf, "orders"), "o_totalprice", [0.25, 0.5, 0.9], ["o_custkey"]), {"q25": 6, "q50": 6, "q90": 6})
