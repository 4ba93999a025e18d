"""Risk report queries (sections B6-B7, C1, C3, C6, D1-D11, D17-D24, F1, F5, H1, H2)."""


from attriscope.operators import risk as R
from attriscope.operators.common import round_cols
from attriscope.plans.base import LOSS_SQL, MEDIAN_SQL, query, with_v
from attriscope.sources.tables import employees as E


@query("department_profile", with_v(f"""
SELECT Department, ROUND(AVG(Risk), 6) AS avg_risk, COUNT(*) AS n_employees,
       CAST(SUM(CASE WHEN Risk > 0.5E0 THEN 1 ELSE 0 END) AS BIGINT) AS n_high_risk,
       ROUND(AVG(MonthlyIncome), 2) AS avg_income, ROUND(AVG(YearsAtCompany), 6) AS avg_tenure,
       ROUND(AVG(JobSatisfaction), 6) AS avg_satisfaction, ROUND(SUM({LOSS_SQL}), 2) AS expected_loss,
       ROUND_EVEN(SUM(CASE WHEN Risk > 0.5E0 THEN 1 ELSE 0 END) * 100E0 / COUNT(*), 1) AS high_risk_rate
FROM v WHERE Department IS NOT NULL GROUP BY Department"""))
def q_department_profile(spark, sf):
    return round_cols(R.department_profile(E(spark, sf)),
                      {"avg_risk": 6, "avg_income": 2, "avg_tenure": 6, "avg_satisfaction": 6, "expected_loss": 2})


@query("company_kpis", with_v(f"""
SELECT COUNT(*) AS n_employees,
       CAST(SUM(CASE WHEN Risk > 0.5E0 THEN 1 ELSE 0 END) AS BIGINT) AS n_high_risk,
       CAST(SUM(CASE WHEN Risk > 0.7E0 THEN 1 ELSE 0 END) AS BIGINT) AS n_critical,
       ROUND(SUM(CASE WHEN Risk > 0.7E0 THEN 1 ELSE 0 END) * 100E0 / COUNT(*), 6) AS critical_pct,
       ROUND(AVG(Risk), 6) AS avg_risk, ROUND(SUM({LOSS_SQL}), 2) AS total_expected_loss FROM v"""))
def q_company_kpis(spark, sf):
    return round_cols(R.company_kpis(E(spark, sf)), {"critical_pct": 6, "avg_risk": 6, "total_expected_loss": 2})


@query("role_risk", with_v("""
SELECT JobRole, ROUND(AVG(Risk), 6) AS avg_risk FROM v WHERE JobRole IS NOT NULL GROUP BY JobRole"""))
def q_role_risk(spark, sf):
    return round_cols(R.role_risk(E(spark, sf)), {"avg_risk": 6})


@query("risk_hierarchy", with_v("""
SELECT Department, JobRole, COUNT(*) AS n_employees, ROUND(AVG(Risk), 6) AS avg_risk,
       CAST(GROUPING(Department, JobRole) AS INT) AS level
FROM v WHERE Department IS NOT NULL AND JobRole IS NOT NULL
GROUP BY ROLLUP (Department, JobRole)"""))
def q_risk_hierarchy(spark, sf):
    return round_cols(R.risk_hierarchy(E(spark, sf)), {"avg_risk": 6})


_DEPTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("role_department_pivot", with_v(
    "SELECT JobRole, " + ", ".join(
        f"ROUND(AVG(CASE WHEN Department = '{d}' THEN Risk END), 6) AS {d}" for d in _DEPTS)
    + " FROM v WHERE JobRole IS NOT NULL AND Department IS NOT NULL GROUP BY JobRole"))
def q_role_department_pivot(spark, sf):
    df = R.role_department_pivot(E(spark, sf))
    return round_cols(df, {c: 6 for c in df.columns if c != "JobRole"})


@query("nine_box", with_v("""
SELECT b.band_ix, b.risk_band,
       CAST(COALESCE(SUM(CASE WHEN perf = 'Low' THEN 1 END), 0) AS BIGINT) AS Low,
       CAST(COALESCE(SUM(CASE WHEN perf = 'Expected' THEN 1 END), 0) AS BIGINT) AS Expected,
       CAST(COALESCE(SUM(CASE WHEN perf = 'Outstanding' THEN 1 END), 0) AS BIGINT) AS Outstanding
FROM (VALUES (0, 'Safe'), (1, 'Risky'), (2, 'Critical')) b(band_ix, risk_band)
LEFT JOIN (
  SELECT CASE WHEN Risk > 0E0 AND Risk <= 0.3E0 THEN 0 WHEN Risk > 0.3E0 AND Risk <= 0.6E0 THEN 1
              WHEN Risk > 0.6E0 AND Risk <= 1E0 THEN 2 END AS band_ix,
         CASE WHEN PerformanceRating IN (1, 2) THEN 'Low' WHEN PerformanceRating = 3 THEN 'Expected'
              WHEN PerformanceRating = 4 THEN 'Outstanding' END AS perf
  FROM v) e ON e.band_ix = b.band_ix
GROUP BY b.band_ix, b.risk_band"""))
def q_nine_box(spark, sf):
    return R.nine_box(E(spark, sf))


_AGE_CASE = ("CASE WHEN Age > 17 AND Age <= 25 THEN 0 WHEN Age > 25 AND Age <= 30 THEN 1 "
             "WHEN Age > 30 AND Age <= 35 THEN 2 WHEN Age > 35 AND Age <= 40 THEN 3 "
             "WHEN Age > 40 AND Age <= 50 THEN 4 WHEN Age > 50 AND Age <= 65 THEN 5 END")
_TEN_CASE = ("CASE WHEN YearsAtCompany > -1 AND YearsAtCompany <= 1 THEN 0 "
             "WHEN YearsAtCompany > 1 AND YearsAtCompany <= 3 THEN 1 "
             "WHEN YearsAtCompany > 3 AND YearsAtCompany <= 5 THEN 2 "
             "WHEN YearsAtCompany > 5 AND YearsAtCompany <= 10 THEN 3 "
             "WHEN YearsAtCompany > 10 AND YearsAtCompany <= 40 THEN 4 END")
_AGE_LABELS = "['18-25', '26-30', '31-35', '36-40', '41-50', '51-65']"
_TEN_LABELS = "['0-1 yrs', '2-3 yrs', '4-5 yrs', '6-10 yrs', '10+ yrs']"


@query("extreme_groups", with_v(
    "SELECT * FROM ((SELECT 'Department' AS dimension, 'max' AS extreme, Department AS group_key, "
    "ROUND(AVG(Risk), 6) AS avg_risk FROM v WHERE Department IS NOT NULL GROUP BY Department "
    "ORDER BY AVG(Risk) DESC, Department LIMIT 1)\n"
    "UNION ALL (SELECT 'Department', 'min', Department, ROUND(AVG(Risk), 6) FROM v "
    "WHERE Department IS NOT NULL GROUP BY Department ORDER BY AVG(Risk), Department LIMIT 1)\n"
    "UNION ALL (SELECT 'AgeBand', 'max', " + _AGE_LABELS + "[a + 1], ROUND(AVG(Risk), 6) FROM "
    "(SELECT *, " + _AGE_CASE + " AS a FROM v) WHERE a IS NOT NULL GROUP BY a ORDER BY AVG(Risk) DESC, a LIMIT 1)\n"
    "UNION ALL (SELECT 'TenureBand', 'max', " + _TEN_LABELS + "[t + 1], ROUND(AVG(Risk), 6) FROM "
    "(SELECT *, " + _TEN_CASE + " AS t FROM v) WHERE t IS NOT NULL GROUP BY t ORDER BY AVG(Risk) DESC, t LIMIT 1))"))
def q_extreme_groups(spark, sf):
    return round_cols(R.extreme_groups(E(spark, sf)), {"avg_risk": 6})


@query("income_by_label", with_v("""
SELECT Attrition, ROUND(AVG(MonthlyIncome), 6) AS mean_income, COUNT(*) AS n,
       ROUND(quantile_cont(MonthlyIncome, 0.5), 6) AS median_income
FROM v WHERE Attrition IS NOT NULL GROUP BY Attrition"""))
def q_income_by_label(spark, sf):
    return round_cols(R.income_by_label(E(spark, sf)), {"mean_income": 6, "median_income": 6})


@query("overtime_label_counts", with_v("""
SELECT OverTime, Attrition, COUNT(*) AS n FROM v
WHERE OverTime IS NOT NULL AND Attrition IS NOT NULL GROUP BY OverTime, Attrition"""))
def q_overtime_label_counts(spark, sf):
    return R.overtime_label_counts(E(spark, sf))


@query("overtime_label_rate", with_v("""
SELECT OverTime, ROUND(attrition_rate, 6) AS attrition_rate, n,
       ROUND(MAX(CASE WHEN OverTime = 'Yes' THEN attrition_rate END) OVER ()
             / NULLIF(MAX(CASE WHEN OverTime = 'No' THEN attrition_rate END) OVER (), 0E0), 6) AS rate_ratio
FROM (SELECT OverTime, AVG(CASE WHEN Attrition = 'Yes' THEN 1 WHEN Attrition = 'No' THEN 0 END) * 100E0 AS attrition_rate,
             COUNT(*) AS n FROM v WHERE OverTime IS NOT NULL GROUP BY OverTime)"""))
def q_overtime_label_rate(spark, sf):
    return round_cols(R.overtime_label_rate(E(spark, sf)), {"attrition_rate": 6, "rate_ratio": 6})


@query("class_balance", with_v("""
SELECT Attrition, COUNT(*) AS n, ROUND(COUNT(*) * 100E0 / SUM(COUNT(*)) OVER (), 6) AS share_pct
FROM v GROUP BY Attrition"""))
def q_class_balance(spark, sf):
    return round_cols(R.class_balance(E(spark, sf)), {"share_pct": 6})


@query("label_balance", """
SELECT toxic, COUNT(*) AS n, ROUND(COUNT(*) * 100E0 / SUM(COUNT(*)) OVER (), 6) AS share_pct
FROM labels GROUP BY toxic""")
def q_label_balance(spark, sf):
    from attriscope.sources.tables import load
    return round_cols(R.class_balance(load(spark, sf, "labels"), "toxic"), {"share_pct": 6})


@query("risk_threshold_counts", with_v("""
SELECT 0.4E0 AS threshold, CAST(SUM(CASE WHEN Risk > 0.4E0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM v
UNION ALL SELECT 0.5E0, CAST(SUM(CASE WHEN Risk > 0.5E0 THEN 1 ELSE 0 END) AS BIGINT) FROM v
UNION ALL SELECT 0.7E0, CAST(SUM(CASE WHEN Risk > 0.7E0 THEN 1 ELSE 0 END) AS BIGINT) FROM v"""))
def q_risk_threshold_counts(spark, sf):
    return R.risk_threshold_counts(E(spark, sf))


_SEGMENTS = [
    ("low_pay_high_risk", f"MonthlyIncome < {MEDIAN_SQL} AND Risk > 0.5E0"),
    ("flight_risk", "PerformanceRating = 4 AND Risk > 0.5E0"),
    ("core_star", "PerformanceRating = 4 AND Risk <= 0.3E0"),
    ("at_risk_below_median_pay", f"MonthlyIncome < {MEDIAN_SQL} AND Risk > 0.4E0"),
    ("at_risk_at_or_above_median_pay", f"MonthlyIncome >= {MEDIAN_SQL} AND Risk > 0.4E0"),
    ("low_satisfaction_at_risk", "JobSatisfaction <= 2 AND Risk > 0.4E0"),
    ("overtime_high_risk", "OverTime = 'Yes' AND Risk > 0.5E0"),
    ("young_at_risk", "Age < 30 AND Risk > 0.4E0"),
]


@query("risk_segments", with_v("\nUNION ALL ".join(
    f"SELECT '{k}' AS segment, CAST(COUNT(*) AS BIGINT) AS n FROM v WHERE {p}" for k, p in _SEGMENTS)))
def q_risk_segments(spark, sf):
    return R.risk_segments(E(spark, sf))


_RISK5 = ("CASE WHEN Risk > 0E0 AND Risk <= 0.2E0 THEN 0 WHEN Risk > 0.2E0 AND Risk <= 0.4E0 THEN 1 "
          "WHEN Risk > 0.4E0 AND Risk <= 0.6E0 THEN 2 WHEN Risk > 0.6E0 AND Risk <= 0.8E0 THEN 3 "
          "WHEN Risk > 0.8E0 AND Risk <= 1E0 THEN 4 END")


@query("risk_band_distribution", with_v(f"""
SELECT b.band_ix, b.band, CAST(COUNT(e.k) AS BIGINT) AS n
FROM (VALUES (0, 'Very Low'), (1, 'Low'), (2, 'Medium'), (3, 'High'), (4, 'Critical')) b(band_ix, band)
LEFT JOIN (SELECT {_RISK5} AS k FROM v) e ON e.k = b.band_ix GROUP BY b.band_ix, b.band"""))
def q_risk_band_distribution(spark, sf):
    return R.risk_band_distribution(E(spark, sf))


@query("age_histogram", with_v("""
SELECT h.Attrition, h.bin, h.n, ROUND(r.mean, 6) AS mean,
       ROUND(r.lo + (h.bin - 1) * ((r.hi - r.lo) / 20E0), 6) AS bin_lo,
       ROUND(r.lo + h.bin * ((r.hi - r.lo) / 20E0), 6) AS bin_hi
FROM (SELECT e.Attrition,
             CAST(CASE WHEN r.hi = r.lo THEN 1 ELSE LEAST(FLOOR((CAST(e.Age AS DOUBLE) - r.lo) / ((r.hi - r.lo) / 20E0)) + 1, 20) END AS INT) AS bin,
             COUNT(*) AS n
      FROM v e JOIN r ON e.Attrition = r.Attrition WHERE e.Age IS NOT NULL GROUP BY ALL) h
JOIN r ON h.Attrition = r.Attrition""",
    "r AS (SELECT Attrition, MIN(Age) AS lo, MAX(Age) AS hi, AVG(Age) AS mean FROM v "
    "WHERE Attrition IS NOT NULL AND Age IS NOT NULL GROUP BY Attrition)"))
def q_age_histogram(spark, sf):
    return round_cols(R.age_histogram(E(spark, sf)), {"mean": 6, "bin_lo": 6, "bin_hi": 6})


@query("risk_histogram", with_v("""
SELECT h.bin, h.n, ROUND(r.mean, 6) AS mean,
       ROUND(r.lo + (h.bin - 1) * ((r.hi - r.lo) / 30E0), 6) AS bin_lo,
       ROUND(r.lo + h.bin * ((r.hi - r.lo) / 30E0), 6) AS bin_hi
FROM (SELECT CAST(CASE WHEN r.hi = r.lo THEN 1 ELSE LEAST(FLOOR((e.Risk - r.lo) / ((r.hi - r.lo) / 30E0)) + 1, 30) END AS INT) AS bin,
             COUNT(*) AS n FROM v e, r WHERE e.Risk IS NOT NULL GROUP BY ALL) h, r""",
    "r AS (SELECT MIN(Risk) AS lo, MAX(Risk) AS hi, AVG(Risk) AS mean FROM v WHERE Risk IS NOT NULL)"))
def q_risk_histogram(spark, sf):
    return round_cols(R.risk_histogram(E(spark, sf)), {"mean": 6, "bin_lo": 6, "bin_hi": 6})


@query("box_stats", with_v("""
SELECT q.Attrition, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3, ROUND(q3 - q1, 6) AS iqr,
       ROUND(MIN(CASE WHEN MonthlyIncome BETWEEN q1 - 1.5E0 * (q3 - q1) AND q3 + 1.5E0 * (q3 - q1) THEN MonthlyIncome END), 6) AS whisker_lo,
       ROUND(MAX(CASE WHEN MonthlyIncome BETWEEN q1 - 1.5E0 * (q3 - q1) AND q3 + 1.5E0 * (q3 - q1) THEN MonthlyIncome END), 6) AS whisker_hi,
       CAST(SUM(CASE WHEN MonthlyIncome BETWEEN q1 - 1.5E0 * (q3 - q1) AND q3 + 1.5E0 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM q JOIN v ON v.Attrition = q.Attrition WHERE MonthlyIncome IS NOT NULL
GROUP BY q.Attrition, q1, median, q3""",
    "q AS (SELECT Attrition, quantile_cont(MonthlyIncome, 0.25) AS q1, quantile_cont(MonthlyIncome, 0.5) AS median, "
    "quantile_cont(MonthlyIncome, 0.75) AS q3 FROM v WHERE Attrition IS NOT NULL GROUP BY Attrition)"))
def q_box_stats(spark, sf):
    return round_cols(R.box_stats(E(spark, sf)),
                      {"q1": 6, "median": 6, "q3": 6, "iqr": 6, "whisker_lo": 6, "whisker_hi": 6})


@query("overtime_risk_compare", with_v("""
SELECT n_overtime, n_regular, ROUND(overtime_share_pct, 6) AS overtime_share_pct,
       ROUND(avg_risk_overtime, 6) AS avg_risk_overtime, ROUND(avg_risk_regular, 6) AS avg_risk_regular,
       n_overtime_high_risk,
       ROUND(CASE WHEN n_overtime > 0 AND avg_risk_overtime > avg_risk_regular THEN
             CASE WHEN avg_risk_regular > 0 THEN avg_risk_overtime / avg_risk_regular ELSE 0E0 END END, 6) AS risk_ratio
FROM (SELECT CAST(SUM(CASE WHEN OverTime = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS n_overtime,
             CAST(SUM(CASE WHEN OverTime = 'No' THEN 1 ELSE 0 END) AS BIGINT) AS n_regular,
             SUM(CASE WHEN OverTime = 'Yes' THEN 1 ELSE 0 END) * 100E0 / COUNT(*) AS overtime_share_pct,
             COALESCE(AVG(CASE WHEN OverTime = 'Yes' THEN Risk END), 0E0) AS avg_risk_overtime,
             COALESCE(AVG(CASE WHEN OverTime = 'No' THEN Risk END), 0E0) AS avg_risk_regular,
             CAST(SUM(CASE WHEN OverTime = 'Yes' AND Risk > 0.5E0 THEN 1 ELSE 0 END) AS BIGINT) AS n_overtime_high_risk
      FROM v)"""))
def q_overtime_risk_compare(spark, sf):
    return round_cols(R.overtime_risk_compare(E(spark, sf)),
                      {"overtime_share_pct": 6, "avg_risk_overtime": 6, "avg_risk_regular": 6, "risk_ratio": 6})


@query("age_band_risk", with_v(f"""
SELECT b.band_ix, b.band, ROUND(AVG(e.Risk), 6) AS avg_risk, CAST(COUNT(e.k) AS BIGINT) AS n,
       CAST(COUNT(CASE WHEN e.Risk > 0.5E0 THEN 1 END) AS BIGINT) AS n_high_risk
FROM (SELECT * FROM (VALUES (0, '18-25'), (1, '26-30'), (2, '31-35'), (3, '36-40'), (4, '41-50'), (5, '51-65')) t(band_ix, band)) b
LEFT JOIN (SELECT Risk, {_AGE_CASE} AS k FROM v) e ON e.k = b.band_ix GROUP BY b.band_ix, b.band"""))
def q_age_band_risk(spark, sf):
    return round_cols(R.age_band_risk(E(spark, sf)), {"avg_risk": 6})


@query("tenure_band_risk", with_v(f"""
SELECT b.band_ix, b.band, ROUND(AVG(e.Risk), 6) AS avg_risk, CAST(COUNT(e.k) AS BIGINT) AS n,
       ROUND(AVG(e.MonthlyIncome), 2) AS avg_income
FROM (VALUES (0, '0-1 yrs'), (1, '2-3 yrs'), (2, '4-5 yrs'), (3, '6-10 yrs'), (4, '10+ yrs')) b(band_ix, band)
LEFT JOIN (SELECT Risk, MonthlyIncome, {_TEN_CASE} AS k FROM v) e ON e.k = b.band_ix GROUP BY b.band_ix, b.band"""))
def q_tenure_band_risk(spark, sf):
    return round_cols(R.tenure_band_risk(E(spark, sf)), {"avg_risk": 6, "avg_income": 2})


@query("satisfaction_risk", with_v("""
SELECT JobSatisfaction, ROUND(AVG(Risk), 6) AS avg_risk, COUNT(*) AS n,
       CASE JobSatisfaction WHEN 1 THEN '1 - Low' WHEN 2 THEN '2 - Medium' WHEN 3 THEN '3 - High'
            WHEN 4 THEN '4 - Very High' END AS level
FROM v WHERE JobSatisfaction IS NOT NULL GROUP BY JobSatisfaction"""))
def q_satisfaction_risk(spark, sf):
    return round_cols(R.satisfaction_risk(E(spark, sf)), {"avg_risk": 6})


@query("raise_programme_roi", with_v(f"""
SELECT n_employees, ROUND(prevented_loss, 2) AS prevented_loss, ROUND(raise_cost, 2) AS raise_cost,
       ROUND(CASE WHEN raise_cost > 0 THEN (prevented_loss - raise_cost) / raise_cost * 100E0 ELSE 0E0 END, 6) AS roi_pct
FROM (SELECT CAST(COUNT(*) AS BIGINT) AS n_employees, COALESCE(SUM({LOSS_SQL}), 0E0) AS prevented_loss,
             COALESCE(SUM(MonthlyIncome), 0E0) * 0.1E0 * 12E0 AS raise_cost
      FROM v WHERE MonthlyIncome < {MEDIAN_SQL} AND Risk > 0.4E0)"""))
def q_raise_programme_roi(spark, sf):
    return round_cols(R.raise_programme_roi(E(spark, sf)), {"prevented_loss": 2, "raise_cost": 2, "roi_pct": 6})


@query("critical_alerts", with_v(f"""
SELECT EmployeeNumber, JobRole, ROUND(Risk, 6) AS Risk, ROUND({LOSS_SQL}, 2) AS expected_loss
FROM v WHERE Risk > 0.7E0 ORDER BY Risk DESC, EmployeeNumber LIMIT 5"""))
def q_critical_alerts(spark, sf):
    return round_cols(R.critical_alerts(E(spark, sf)), {"Risk": 6, "expected_loss": 2})


@query("flight_risk_stars", with_v("""
SELECT EmployeeNumber, Department, JobRole, ROUND(MonthlyIncome, 2) AS MonthlyIncome, JobSatisfaction,
       ROUND(Risk, 6) AS Risk
FROM v WHERE PerformanceRating = 4 AND Risk > 0.5E0"""))
def q_flight_risk_stars(spark, sf):
    return round_cols(R.flight_risk_stars(E(spark, sf)), {"MonthlyIncome": 2, "Risk": 6})


@query("expected_loss_by_group", with_v(f"""
SELECT Department, ROUND(SUM({LOSS_SQL}), 2) AS expected_loss FROM v WHERE Department IS NOT NULL GROUP BY Department"""))
def q_expected_loss_by_group(spark, sf):
    return round_cols(R.expected_loss_by_group(E(spark, sf)), {"expected_loss": 2})


@query("expected_loss", with_v(f"""
SELECT EmployeeNumber, ROUND(Risk, 6) AS Risk, ROUND(MonthlyIncome, 2) AS MonthlyIncome,
       ROUND({LOSS_SQL}, 2) AS expected_loss FROM v"""))
def q_expected_loss(spark, sf):
    return round_cols(R.expected_loss_rows(E(spark, sf)), {"Risk": 6, "MonthlyIncome": 2, "expected_loss": 2})


@query("roi", with_v(f"""
SELECT EmployeeNumber, ROUND(saving, 2) AS saving, investment,
       ROUND(CASE WHEN investment <= 0E0 THEN 0E0 ELSE (saving - investment) / investment * 100E0 END, 6) AS roi_pct
FROM (SELECT EmployeeNumber, {LOSS_SQL} AS saving,
             CASE WHEN OverTime = 'Yes' THEN 2500E0 ELSE 0E0 END AS investment FROM v)"""))
def q_roi(spark, sf):
    return round_cols(R.overtime_roi_rows(E(spark, sf)), {"saving": 2, "roi_pct": 6})


@query("above_median_flag", with_v(f"""
SELECT EmployeeNumber, MonthlyIncome, {MEDIAN_SQL} AS median_income, MonthlyIncome >= {MEDIAN_SQL} AS at_or_above_median
FROM v"""))
def q_above_median_flag(spark, sf):
    return R.above_median_flag(E(spark, sf))


@query("label_lookup", with_v("""
SELECT EmployeeNumber, PerformanceRating,
       CASE WHEN PerformanceRating IN (1, 2) THEN 'Low' WHEN PerformanceRating = 3 THEN 'Expected'
            WHEN PerformanceRating = 4 THEN 'Outstanding' END AS performance_level,
       JobSatisfaction,
       CASE JobSatisfaction WHEN 1 THEN '1 - Low' WHEN 2 THEN '2 - Medium' WHEN 3 THEN '3 - High'
            WHEN 4 THEN '4 - Very High' END AS satisfaction_level
FROM v"""))
def q_label_lookup(spark, sf):
    return R.label_lookup(E(spark, sf))
