"""Source / sink and split queries."""

from pyspark.sql import functions as F

from attriscope.operators import scoring as SC
from attriscope.operators import split as SP
from attriscope.operators.quantiles import exact_median
from attriscope.plans.base import MEDIAN_SQL, query, with_v
from attriscope.session import work_path
from attriscope.sources import files as FI
from attriscope.sources.tables import employees as E

RAW_COLUMNS = [f.name for f in FI.EMPLOYEE_SCHEMA.fields]
_RAW_SQL = ", ".join(RAW_COLUMNS)


def _raw(spark, sf):
    return E(spark, sf).select(*RAW_COLUMNS)


@query("scan_roundtrip", with_v(f"SELECT {_RAW_SQL} FROM v"))
def q_scan_roundtrip(spark, sf):
    """Employee rows written as header CSV and read back with the declared schema."""
    path = FI.write_csv(_raw(spark, sf), work_path(spark, "roster-csv"))
    return FI.read_csv(spark, path)


def _reordered(spark, sf, name):
    """The roster as CSV with its columns reversed and two more among them."""
    raw = _raw(spark, sf).select(F.lit("x").alias("Extra1"), *RAW_COLUMNS[::-1], F.lit(9).alias("Extra2"))
    return FI.write_csv(raw, work_path(spark, name))


@query("scan_reordered", with_v(f"SELECT {_RAW_SQL} FROM v"))
def q_scan_reordered(spark, sf):
    """Columns of a CSV are found by header name, whatever their order."""
    return FI.read_csv(spark, _reordered(spark, sf, "roster-reordered"))


@query("roster_reordered", with_v(f"""
SELECT EmployeeNumber, JobRole, Department, ROUND_EVEN(Risk * 100E0, 2) AS {SC.RISK_PCT} FROM v"""))
def q_roster_reordered(spark, sf):
    return SC.score_roster(FI.read_csv(spark, _reordered(spark, sf, "upload-reordered")))[0]


@query("entity_lookup", with_v("SELECT * FROM v WHERE EmployeeNumber = 7"))
def q_entity_lookup(spark, sf):
    return FI.lookup_entity(spark, E(spark, sf), 7)


@query("replace_table", with_v(f"SELECT {_RAW_SQL} FROM v"))
def q_replace_table(spark, sf):
    return FI.replace_table(_raw(spark, sf), "employees")


@query("score_roster", with_v(f"""
SELECT EmployeeNumber, JobRole, Department, ROUND_EVEN(Risk * 100E0, 2) AS {SC.RISK_PCT} FROM v"""))
def q_score_roster(spark, sf):
    """An uploaded roster (CSV) scored: the displayed 4 columns, sorted by risk; the export is written too."""
    path = FI.write_csv(_raw(spark, sf), work_path(spark, "upload"))
    display, export = SC.score_roster(FI.read_csv(spark, path))
    FI.write_csv(export, work_path(spark, "predictions"))
    return display


@query("entity_report", with_v(f"""
SELECT EmployeeNumber, Department, JobRole, ROUND(Risk * 100E0, 1) AS risk_pct,
       ROUND(CASE WHEN Risk < 0.2E0 THEN 0E0 ELSE MonthlyIncome * 6E0 * Risk END, 0) AS expected_loss,
       array_to_string(r, chr(10)) AS recommendations, CAST(len(r) AS INT) AS n_recommendations
FROM (SELECT *, list_filter([
        CASE WHEN Risk > 0.5E0 AND OverTime = 'Yes' THEN '- Overtime: Remove overtime' END,
        CASE WHEN Risk > 0.5E0 AND MonthlyIncome < {MEDIAN_SQL} THEN '- Pay: Improve pay' END,
        CASE WHEN Risk > 0.5E0 AND JobSatisfaction <= 2 THEN '- Career: Plan a career development talk' END],
        lambda x: x IS NOT NULL) AS r FROM v)"""))
def q_entity_report(spark, sf):
    emp = E(spark, sf)
    return FI.entity_report(emp, exact_median(emp, "MonthlyIncome"))


_LABEL = "CASE WHEN Attrition = 'Yes' THEN 1 WHEN Attrition = 'No' THEN 0 END"
_RANKED = (f"r AS (SELECT EmployeeNumber, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY "
           f"(EmployeeNumber * 7919 + 42) % 10007, EmployeeNumber) AS rank_in_class, "
           f"(COUNT(*) OVER (PARTITION BY label) * 2 + 5) // 10 AS n_test "
           f"FROM (SELECT EmployeeNumber, {_LABEL} AS label FROM v) WHERE label IS NOT NULL)")


def _labelled(spark, sf):
    return E(spark, sf).select("EmployeeNumber", F.when(F.col("Attrition") == "Yes", 1)
                               .when(F.col("Attrition") == "No", 0).alias("label"))


@query("stratified_split", with_v("""
SELECT EmployeeNumber, label, rank_in_class, CASE WHEN rank_in_class <= n_test THEN 'test' ELSE 'train' END AS split
FROM r""", _RANKED))
def q_stratified_split(spark, sf):
    return SP.stratified_split(_labelled(spark, sf), "label", "EmployeeNumber").drop("_ntest")


@query("stratified_folds", with_v("""
SELECT EmployeeNumber, label, rank_in_class, CAST((rank_in_class - n_test - 1) % 5 AS INT) AS fold
FROM r WHERE rank_in_class > n_test""", _RANKED))
def q_stratified_folds(spark, sf):
    return SP.stratified_folds(_labelled(spark, sf), "label", "EmployeeNumber")
