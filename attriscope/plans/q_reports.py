"""Composite report queries."""

from pyspark.sql import functions as F

from attriscope.operators import compare as C
from attriscope.operators import scenario as S
from attriscope.operators import strategy as ST
from attriscope.operators import talent as T
from attriscope.operators.common import round_cols
from attriscope.plans.base import MEDIAN_SQL, query, with_v
from attriscope.sources.tables import employees as E


def risk_sql(ot="OverTime", inc="MonthlyIncome", js="JobSatisfaction", wlb="WorkLifeBalance", age="Age"):
    m = (f"((CASE WHEN {ot} = 'Yes' THEN 1.2E0 ELSE -0.6E0 END) + (5000E0 - {inc}) / 4000E0 "
         f"+ (2.5E0 - {js}) * 0.4E0 + (2.5E0 - {wlb}) * 0.2E0 + (35E0 - {age}) / 40E0 - 0.6E0)")
    return f"(0.5E0 + 0.5E0 * {m} / (1E0 + ABS({m})))"


def loss_sql(p, inc):
    return f"(CASE WHEN {p} < 0.2E0 THEN 0E0 ELSE {inc} * 6E0 * {p} END)"


def _lit(v, t):
    if v is None:
        return f"CAST(NULL AS {t})"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return f"'{v}'"
    if t == "DOUBLE":
        return f"{float(v)!r}E0" if "e" not in repr(float(v)) else repr(float(v))
    return str(v)


def _values(rows, types):
    return ", ".join("(" + ", ".join(_lit(v, t) for v, t in zip(r, types)) + ")" for r in rows)


POTENTIAL_SQL = ("(Education / 5 * 30 + JobInvolvement / 4 * 40 "
                 "+ (10 - LEAST(YearsSinceLastPromotion, 10)) / 10 * 30)")


@query("potential_score", with_v(f"""
SELECT EmployeeNumber, PerformanceRating, ROUND({POTENTIAL_SQL}, 6) AS potential_score,
       CASE WHEN {POTENTIAL_SQL} > 0 AND {POTENTIAL_SQL} <= 45 THEN 'Low'
            WHEN {POTENTIAL_SQL} > 45 AND {POTENTIAL_SQL} <= 75 THEN 'Medium'
            WHEN {POTENTIAL_SQL} > 75 AND {POTENTIAL_SQL} <= 100 THEN 'High' END AS potential_band,
       CASE WHEN Risk > 0E0 AND Risk <= 0.3E0 THEN 'Safe' WHEN Risk > 0.3E0 AND Risk <= 0.6E0 THEN 'Risky'
            WHEN Risk > 0.6E0 AND Risk <= 1E0 THEN 'Critical' END AS risk_band,
       ROUND(Risk, 6) AS Risk
FROM v"""))
def q_potential_score(spark, sf):
    return round_cols(T.talent_grid(E(spark, sf)), {"potential_score": 6, "Risk": 6})


_WI = _values(S.WHAT_IF_SCENARIOS, ["VARCHAR", "DOUBLE", "VARCHAR", "VARCHAR", "INTEGER", "INTEGER"])
_SIM = risk_sql("COALESCE(s_overtime, OverTime)", "COALESCE(s_income, MonthlyIncome)",
                "COALESCE(s_satisfaction, JobSatisfaction)")


@query("what_if_grid", with_v(f"""
SELECT EmployeeNumber, scenario, ROUND(cur, 6) AS current_prob, ROUND(sim, 6) AS sim_prob,
       ROUND(cur_loss, 2) AS current_loss, ROUND(sim_loss, 2) AS sim_loss, JobRole, DistanceFromHome,
       ROUND((sim - cur) * 100E0, 6) AS delta_pct, ROUND(sim_loss - cur_loss, 2) AS delta_loss,
       CASE WHEN sim * 100E0 < 30 THEN 'low' WHEN sim * 100E0 < 60 THEN 'medium' ELSE 'high' END AS zone
FROM (SELECT EmployeeNumber, scenario, cur, sim, {loss_sql('cur', 'MonthlyIncome')} AS cur_loss,
             {loss_sql('sim', 'inc2')} AS sim_loss, JobRole, DistanceFromHome
      FROM (SELECT v.EmployeeNumber, s.scenario, {risk_sql()} AS cur, {_SIM} AS sim, v.MonthlyIncome,
                   COALESCE(s_income, MonthlyIncome) AS inc2, COALESCE(s_role, JobRole) AS JobRole,
                   COALESCE(s_distance, DistanceFromHome) AS DistanceFromHome
            FROM v, (VALUES {_WI}) s(scenario, s_income, s_role, s_overtime, s_satisfaction, s_distance)))"""))
def q_what_if_grid(spark, sf):
    return round_cols(S.what_if_grid(E(spark, sf)),
                      {"current_prob": 6, "sim_prob": 6, "current_loss": 2, "sim_loss": 2, "delta_pct": 6, "delta_loss": 2})


_PK = _values(S.PACKAGES, ["VARCHAR", "DOUBLE", "BOOLEAN", "BOOLEAN"])
_INC2 = "(MonthlyIncome + raise_yearly / 12)"
_JS2 = "(CASE WHEN mentoring AND JobSatisfaction IS NOT NULL THEN LEAST(4, JobSatisfaction + 1) ELSE JobSatisfaction END)"
_ES2 = ("(CASE WHEN mentoring AND EnvironmentSatisfaction IS NOT NULL THEN LEAST(4, EnvironmentSatisfaction + 1) "
        "ELSE EnvironmentSatisfaction END)")
_OT2 = "(CASE WHEN overtime_off THEN 'No' ELSE OverTime END)"
_INTERVENTION = f"""
SELECT EmployeeNumber, package, p0, p1, l0, l1, inc2, es2, cost_salary, cost_overtime, cost_training,
       cost_salary + cost_overtime + cost_training AS investment, l0 - l1 AS saving
FROM (SELECT EmployeeNumber, package, p0, p1, {loss_sql('p0', 'MonthlyIncome')} AS l0, {loss_sql('p1', 'inc2')} AS l1,
             inc2, es2, cost_salary, cost_overtime, cost_training
      FROM (SELECT v.EmployeeNumber, k.package, v.MonthlyIncome, {risk_sql()} AS p0,
                   {risk_sql(_OT2, _INC2, _JS2)} AS p1, {_INC2} AS inc2, {_ES2} AS es2,
                   raise_yearly AS cost_salary, CASE WHEN overtime_off THEN 2500E0 ELSE 0E0 END AS cost_overtime,
                   CASE WHEN mentoring THEN 1500E0 ELSE 0E0 END AS cost_training
            FROM v, (VALUES {_PK}) k(package, raise_yearly, overtime_off, mentoring)))"""


@query("intervention_roi", with_v(f"""
SELECT EmployeeNumber, package, ROUND(p0, 6) AS prob_before, ROUND(p1, 6) AS prob_after,
       ROUND(l0, 2) AS loss_before, ROUND(l1, 2) AS loss_after, ROUND(inc2, 2) AS income_after,
       es2 AS environment_after, cost_salary, cost_overtime, cost_training, investment, ROUND(saving, 2) AS saving,
       ROUND(CASE WHEN investment > 0 THEN (CASE WHEN investment <= 0E0 THEN 0E0
             ELSE (saving - investment) / investment * 100E0 END) ELSE 0E0 END, 6) AS roi_pct,
       ROUND(CASE WHEN investment > 0 THEN saving / investment END, 6) AS saving_per_dollar,
       CASE WHEN investment <= 0 THEN 'no investment'
            WHEN (saving - investment) / investment * 100E0 > 0 THEN 'profitable' ELSE 'not profitable' END AS verdict
FROM i""", f"i AS ({_INTERVENTION})"))
def q_intervention_roi(spark, sf):
    return round_cols(S.intervention_roi(E(spark, sf)),
                      {"prob_before": 6, "prob_after": 6, "loss_before": 2, "loss_after": 2, "income_after": 2,
                       "saving": 2, "roi_pct": 6, "saving_per_dollar": 6})


@query("roi_waterfall", with_v("""
SELECT EmployeeNumber, package, ROUND(l1, 2) AS new_loss, step, label, measure, ROUND(amount, 2) AS amount,
       ROUND(running_level, 2) AS running_level
FROM (SELECT EmployeeNumber, package, l1, 1 AS step, 'current_loss' AS label, 'absolute' AS measure, l0 AS amount, l0 AS running_level FROM i
      UNION ALL SELECT EmployeeNumber, package, l1, 2, 'salary_cost', 'relative', cost_salary, l0 + cost_salary FROM i
      UNION ALL SELECT EmployeeNumber, package, l1, 3, 'overtime_cost', 'relative', cost_overtime, l0 + cost_salary + cost_overtime FROM i
      UNION ALL SELECT EmployeeNumber, package, l1, 4, 'training_cost', 'relative', cost_training,
                       l0 + cost_salary + cost_overtime + cost_training FROM i
      UNION ALL SELECT EmployeeNumber, package, l1, 5, 'new_loss', 'total', -l0 + investment + l1,
                       l0 + cost_salary + cost_overtime + cost_training + (-l0 + investment + l1) FROM i)""",
    f"i AS (SELECT * FROM ({_INTERVENTION}) WHERE package = 'full')"))
def q_roi_waterfall(spark, sf):
    return round_cols(S.roi_waterfall(E(spark, sf)), {"new_loss": 2, "amount": 2, "running_level": 2})


def _text(template, *args):
    """SQL of a printf-style text."""
    parts = template.replace("%%", "\0").replace("%d", "%s").split("%s")
    out = [f"'{p}'".replace("\0", "%") for p in parts]
    for i, a in enumerate(args):
        out.insert(2 * i + 1, a)
    return " || ".join(out)


_MESSAGE = f"CASE WHEN avg_risk < 0.25E0 THEN '{ST.MSG_OK}' WHEN avg_risk > 0.35E0 THEN '{ST.MSG_URGENT}' ELSE '{ST.MSG_MEDIUM}' END"

_PAIRS = ("a AS (SELECT * FROM v WHERE EmployeeNumber % 2 = 1), "
          "b AS (SELECT * FROM v WHERE EmployeeNumber % 2 = 0)")


@query("pair_compare", with_v(f"""
SELECT (a.EmployeeNumber + 1) // 2 AS pair_id, a.EmployeeNumber AS emp1, b.EmployeeNumber AS emp2,
       ROUND(a.Risk * 100E0, 6) AS risk1_pct, ROUND(b.Risk * 100E0, 6) AS risk2_pct,
       ROUND({loss_sql('a.Risk', 'a.MonthlyIncome')}, 2) AS cost1, ROUND({loss_sql('b.Risk', 'b.MonthlyIncome')}, 2) AS cost2,
       ROUND(ABS(a.Risk - b.Risk) * 100E0, 6) AS risk_diff_pct,
       CASE WHEN a.Risk > b.Risk THEN a.EmployeeNumber ELSE b.EmployeeNumber END AS more_risky,
       CASE WHEN a.Risk > 0.5E0 THEN 'High' ELSE 'Low' END AS tag1, CASE WHEN b.Risk > 0.5E0 THEN 'High' ELSE 'Low' END AS tag2
FROM a JOIN b ON (a.EmployeeNumber + 1) // 2 = (b.EmployeeNumber + 1) // 2""", _PAIRS))
def q_pair_compare(spark, sf):
    return round_cols(C.pair_compare(E(spark, sf)),
                      {"risk1_pct": 6, "risk2_pct": 6, "cost1": 2, "cost2": 2, "risk_diff_pct": 6})


@query("pair_compare_chosen", with_v(f"""
SELECT p.id AS pair_id, p.id AS emp1, p.id + 5 AS emp2,
       ROUND(a.Risk * 100E0, 6) AS risk1_pct, ROUND(b.Risk * 100E0, 6) AS risk2_pct,
       ROUND({loss_sql('a.Risk', 'a.MonthlyIncome')}, 2) AS cost1,
       ROUND(CASE WHEN b.Risk IS NOT NULL THEN {loss_sql('b.Risk', 'b.MonthlyIncome')} END, 2) AS cost2,
       ROUND(ABS(a.Risk - b.Risk) * 100E0, 6) AS risk_diff_pct,
       CASE WHEN a.Risk > b.Risk THEN p.id ELSE p.id + 5 END AS more_risky,
       CASE WHEN a.Risk > 0.5E0 THEN 'High' ELSE 'Low' END AS tag1, CASE WHEN b.Risk > 0.5E0 THEN 'High' ELSE 'Low' END AS tag2
FROM (SELECT EmployeeNumber AS id FROM v) p JOIN v a ON a.EmployeeNumber = p.id LEFT JOIN v b ON b.EmployeeNumber = p.id + 5"""))
def q_pair_compare_chosen(spark, sf):
    """A table of chosen pairs (each employee and the one five ids on); pairs without a second row stay."""
    emp = E(spark, sf)
    k = F.col("EmployeeNumber")
    chosen = emp.select(k.alias("pair_id"), k.alias("emp1"), (k + 5).alias("emp2"))
    return round_cols(C.pair_compare(emp, chosen),
                      {"risk1_pct": 6, "risk2_pct": 6, "cost1": 2, "cost2": 2, "risk_diff_pct": 6})


_LONG = "\nUNION ALL ".join(
    f"SELECT pair_id, side, EmployeeNumber, '{m}' AS metric, CAST({m} AS DOUBLE) AS value, '{lab}' AS label FROM p"
    for m, lab in C.BAR_METRICS)
_P = ("p AS (SELECT *, (EmployeeNumber + 1) // 2 AS pair_id, CASE WHEN EmployeeNumber % 2 = 1 THEN 1 ELSE 2 END AS side "
      "FROM v WHERE (EmployeeNumber + 1) // 2 IN (SELECT (EmployeeNumber + 1) // 2 FROM v GROUP BY 1 HAVING COUNT(*) = 2))")


@query("pair_metrics_long", with_v(_LONG, _P))
def q_pair_metrics_long(spark, sf):
    # values are exact casts of the inputs: identical on both engines without rounding
    return C.pair_metrics_long(E(spark, sf))


@query("pair_metrics_table", with_v("""
SELECT pair_id, metric, label, MAX(CASE WHEN side = 1 THEN value END) AS value_1,
       MAX(CASE WHEN side = 2 THEN value END) AS value_2 FROM l GROUP BY pair_id, metric, label""", _P, f"l AS ({_LONG})"))
def q_pair_metrics_table(spark, sf):
    return C.pair_metrics_table(E(spark, sf))


def _detail_rows(side):
    vals = (["'$' || format('{:,}', CAST(ROUND_EVEN(MonthlyIncome, 0) AS BIGINT))"]
            + [f"CAST({c} AS VARCHAR)" for c in ["Age", "TotalWorkingYears", "YearsAtCompany", "JobSatisfaction",
                                               "EnvironmentSatisfaction", "RelationshipSatisfaction", "WorkLifeBalance",
                                               "PerformanceRating", "Education", "DistanceFromHome", "DailyRate"]]
            + ["CASE WHEN OverTime = 'Yes' THEN 'Yes' ELSE 'No' END",
               "'%' || CAST(ROUND_EVEN(Risk * 100E0, 1) AS VARCHAR)",
               f"'$' || format('{{:,}}', CAST(ROUND_EVEN({loss_sql('Risk', 'MonthlyIncome')}, 0) AS BIGINT))"])
    return "[" + ", ".join(vals) + "]"


_METRIC_NAMES = "[" + ", ".join(f"'{m}'" for m in C.DETAIL_METRICS) + "]"


@query("pair_detail_table", with_v(f"""
SELECT pair_id, CAST(i AS INT) AS row, {_METRIC_NAMES}[i] AS metric, a.vals[i] AS value_1, b.vals[i] AS value_2
FROM (SELECT (EmployeeNumber + 1) // 2 AS pair_id, {_detail_rows(1)} AS vals FROM v WHERE EmployeeNumber % 2 = 1) a
JOIN (SELECT (EmployeeNumber + 1) // 2 AS pair_id, {_detail_rows(2)} AS vals FROM v WHERE EmployeeNumber % 2 = 0) b
USING (pair_id), range(1, {len(C.DETAIL_METRICS) + 1}) t(i)"""))
def q_pair_detail_table(spark, sf):
    return C.pair_detail_table(E(spark, sf))


def _chosen(emp):
    k = F.col("EmployeeNumber")
    return emp.select(k.alias("pair_id"), k.alias("emp1"), (k + 5).alias("emp2"))


@query("pair_detail_chosen", with_v(f"""
SELECT a.EmployeeNumber AS pair_id, CAST(i AS INT) AS row, {_METRIC_NAMES}[i] AS metric, a.vals[i] AS value_1, b.vals[i] AS value_2
FROM (SELECT EmployeeNumber, {_detail_rows(1)} AS vals FROM v) a LEFT JOIN (SELECT EmployeeNumber, {_detail_rows(2)} AS vals FROM v) b
ON b.EmployeeNumber = a.EmployeeNumber + 5, range(1, {len(C.DETAIL_METRICS) + 1}) t(i)"""))
def q_pair_detail_chosen(spark, sf):
    """The 15-row table of chosen pairs; a pair without a second employee stays, with nulls."""
    emp = E(spark, sf)
    return C.pair_detail_table(emp, _chosen(emp))


@query("pair_metrics_long_chosen", with_v("\nUNION ALL ".join(
    f"SELECT p.EmployeeNumber AS pair_id, CAST({side} AS INT) AS side, p.EmployeeNumber + {add} AS EmployeeNumber, '{m}' AS metric, "
    f"CAST(r.{m} AS DOUBLE) AS value, '{lab}' AS label FROM v p LEFT JOIN v r ON r.EmployeeNumber = p.EmployeeNumber + {add}"
    for side, add in ((1, 0), (2, 5)) for m, lab in C.BAR_METRICS)))
def q_pair_metrics_long_chosen(spark, sf):
    """The eight metrics of both employees of chosen pairs."""
    emp = E(spark, sf)
    return C.pair_metrics_long(emp, _chosen(emp))


@query("radar_scores", with_v("""
SELECT EmployeeNumber, ROUND(MonthlyIncome / m.inc * 5E0, 6) AS salary,
       ROUND(JobSatisfaction / 4E0 * 5E0, 6) AS job_satisfaction,
       ROUND(CASE WHEN m.tw > 0 THEN TotalWorkingYears / CAST(m.tw AS DOUBLE) * 5E0 ELSE 0E0 END, 6) AS total_experience,
       ROUND(CASE WHEN m.yc > 0 THEN YearsAtCompany / CAST(m.yc AS DOUBLE) * 5E0 ELSE 0E0 END, 6) AS company_tenure,
       ROUND(EnvironmentSatisfaction / 4E0 * 5E0, 6) AS environment_satisfaction,
       ROUND(RelationshipSatisfaction / 4E0 * 5E0, 6) AS relationship_satisfaction,
       ROUND(WorkLifeBalance / 4E0 * 5E0, 6) AS work_life_balance, ROUND(PerformanceRating / 4E0 * 5E0, 6) AS performance
FROM v, (SELECT MAX(MonthlyIncome) AS inc, MAX(TotalWorkingYears) AS tw, MAX(YearsAtCompany) AS yc FROM v) m"""))
def q_radar_scores(spark, sf):
    df = C.radar_scores(E(spark, sf))
    return round_cols(df, {c: 6 for c in df.columns if c != "EmployeeNumber"})


@query("group_position", with_v("""
SELECT v.Department, EmployeeNumber, MonthlyIncome, ROUND(Risk, 6) AS Risk, JobSatisfaction,
       ROUND(g.ai, 6) AS dept_avg_income, ROUND(g.ar, 6) AS dept_avg_risk, ROUND(g.asat, 6) AS dept_avg_satisfaction,
       ROUND(CASE WHEN g.ai > 0 THEN (MonthlyIncome - g.ai) / g.ai * 100E0 ELSE 0E0 END, 6) AS income_diff_pct,
       Risk <= g.ar AS risk_at_or_below_avg, JobSatisfaction >= g.asat AS satisfaction_at_or_above_avg
FROM v JOIN (SELECT Department, AVG(MonthlyIncome) AS ai, AVG(Risk) AS ar, AVG(JobSatisfaction) AS asat
             FROM v WHERE Department IS NOT NULL GROUP BY Department) g ON v.Department = g.Department"""))
def q_group_position(spark, sf):
    return round_cols(C.group_position(E(spark, sf)),
                      {"Risk": 6, "dept_avg_income": 6, "dept_avg_risk": 6, "dept_avg_satisfaction": 6,
                       "income_diff_pct": 6})


_SW_S = ("[CASE WHEN MonthlyIncome >= {med} THEN '%s' END, CASE WHEN JobSatisfaction >= 3 THEN '%s' END, "
         "CASE WHEN WorkLifeBalance >= 3 THEN '%s' END, CASE WHEN OverTime = 'No' THEN '%s' END, "
         "CASE WHEN EnvironmentSatisfaction >= 3 THEN '%s' END, CASE WHEN RelationshipSatisfaction >= 3 THEN '%s' END, "
         "CASE WHEN YearsAtCompany >= 5 THEN 'Experienced staff (' || YearsAtCompany || ' years)' END]"
         % (C.S_PAY, C.S_SAT, C.S_WLB, C.S_OT, C.S_ENV, C.S_REL)).replace("{med}", "m.med")
_SW_W = ("[CASE WHEN NOT (MonthlyIncome >= m.med) THEN '%s' END, CASE WHEN NOT (JobSatisfaction >= 3) THEN '%s' END, "
         "CASE WHEN NOT (WorkLifeBalance >= 3) THEN '%s' END, CASE WHEN NOT (OverTime = 'No') THEN '%s' END, "
         "CASE WHEN NOT (EnvironmentSatisfaction >= 3) THEN '%s' END, CASE WHEN NOT (RelationshipSatisfaction >= 3) THEN '%s' END, "
         "CASE WHEN YearsAtCompany <= 1 THEN '%s' END]"
         % (C.W_PAY, C.W_SAT, C.W_WLB, C.W_OT, C.W_ENV, C.W_REL, C.W_TEN))


@query("strengths_weaknesses", with_v(f"""
SELECT EmployeeNumber, array_to_string(s, '; ') AS strengths, array_to_string(w, '; ') AS weaknesses,
       CAST(len(s) AS INT) AS n_strengths, CAST(len(w) AS INT) AS n_weaknesses
FROM (SELECT EmployeeNumber, list_filter({_SW_S}, lambda x: x IS NOT NULL) AS s,
             list_filter({_SW_W}, lambda x: x IS NOT NULL) AS w
      FROM v, (SELECT quantile_cont(MonthlyIncome, 0.5) AS med FROM v) m)"""))
def q_strengths_weaknesses(spark, sf):
    return C.strengths_weaknesses(E(spark, sf))


@query("action_advice", with_v(f"""
SELECT EmployeeNumber, pct AS risk_pct,
       CASE WHEN Risk > 0.5E0 THEN {_text(C.ADV_URGENT, 'pct')}
            || CASE WHEN OverTime = 'Yes' THEN '{C.ADV_OT}' ELSE '' END
            || CASE WHEN MonthlyIncome < {MEDIAN_SQL} THEN '{C.ADV_PAY}' ELSE '' END
            || CASE WHEN JobSatisfaction <= 2 THEN '{C.ADV_CAREER}' ELSE '' END
            ELSE {_text(C.ADV_STABLE, 'pct')} END AS advice
FROM (SELECT *, CAST(ROUND_EVEN(Risk * 100E0, 0) AS INT) AS pct FROM v)"""))
def q_action_advice(spark, sf):
    return C.action_advice(E(spark, sf))


@query("department_actions", with_v(f"""
SELECT Department, ROUND(avg_risk, 6) AS avg_risk, n_employees, n_high_risk, ROUND(avg_income, 2) AS avg_income,
       ROUND(avg_tenure, 6) AS avg_tenure, ROUND(avg_satisfaction, 6) AS avg_satisfaction, high_risk_rate,
       ROUND(expected_loss, 2) AS expected_loss,
       CASE WHEN avg_risk > 0.35E0 THEN 'urgent' WHEN avg_risk > 0.25E0 THEN 'important' ELSE 'controlled' END AS severity,
       CASE WHEN avg_risk > 0.35E0 THEN '{ST.ADVICE["urgent"]}' WHEN avg_risk > 0.25E0 THEN '{ST.ADVICE["important"]}'
            ELSE '{ST.ADVICE["controlled"]}' END AS advice
FROM (SELECT Department, AVG(Risk) AS avg_risk, COUNT(*) AS n_employees,
             CAST(SUM(CASE WHEN Risk > 0.5E0 THEN 1 ELSE 0 END) AS BIGINT) AS n_high_risk,
             AVG(MonthlyIncome) AS avg_income, AVG(YearsAtCompany) AS avg_tenure, AVG(JobSatisfaction) AS avg_satisfaction,
             ROUND_EVEN(SUM(CASE WHEN Risk > 0.5E0 THEN 1 ELSE 0 END) * 100E0 / COUNT(*), 1) AS high_risk_rate,
             SUM({loss_sql('Risk', 'MonthlyIncome')}) AS expected_loss
      FROM v WHERE Department IS NOT NULL GROUP BY Department)"""))
def q_department_actions(spark, sf):
    return round_cols(ST.department_actions(E(spark, sf)),
                      {"avg_risk": 6, "avg_income": 2, "avg_tenure": 6, "avg_satisfaction": 6, "expected_loss": 2})


@query("strategy_report", with_v(f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY rule) AS INT) AS item, topic, text FROM (
  SELECT 1 AS rule, 'pay' AS topic, n_low_inc > 5 AS on_,
         {_text(ST.T_PAY, 'n_low_inc', "format('{:,}', CAST(ROUND_EVEN(low_inc_sum * 0.1E0 * 12E0, 0) AS BIGINT))")} AS text FROM a
  UNION ALL SELECT 2, 'overtime', n_ot > 5, {_text(ST.T_OT, 'n_ot')} FROM a
  UNION ALL SELECT 3, 'department', TRUE, {_text(ST.T_DEPT, 'riskiest')} FROM a
  UNION ALL SELECT 4, 'youth', n_young > 5, {_text(ST.T_YOUNG, 'n_young')} FROM a
  UNION ALL SELECT 5, 'general', TRUE, {_text(ST.T_GENERAL, 'CAST(ROUND_EVEN(avg_risk * 100E0, 1) AS VARCHAR)', _MESSAGE)} FROM a
) WHERE on_""", f"""a AS (SELECT
    SUM(CASE WHEN MonthlyIncome < {MEDIAN_SQL} AND Risk > 0.4E0 THEN 1 ELSE 0 END) AS n_low_inc,
    COALESCE(SUM(CASE WHEN MonthlyIncome < {MEDIAN_SQL} AND Risk > 0.4E0 THEN MonthlyIncome END), 0E0) AS low_inc_sum,
    SUM(CASE WHEN OverTime = 'Yes' AND Risk > 0.5E0 THEN 1 ELSE 0 END) AS n_ot,
    SUM(CASE WHEN Age < 30 AND Risk > 0.4E0 THEN 1 ELSE 0 END) AS n_young, AVG(Risk) AS avg_risk,
    (SELECT Department FROM v WHERE Department IS NOT NULL GROUP BY Department ORDER BY AVG(Risk) DESC, Department LIMIT 1) AS riskiest
  FROM v)"""))
def q_strategy_report(spark, sf):
    return ST.strategy_report(E(spark, sf))


@query("attrition_findings", with_v("""
SELECT COUNT(*) AS n_total, CAST(SUM(CASE WHEN Attrition = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS n_left,
       ROUND(SUM(CASE WHEN Attrition = 'Yes' THEN 1 ELSE 0 END) * 100E0 / COUNT(*), 6) AS pct_left,
       ROUND(AVG(CASE WHEN OverTime = 'No' THEN CASE WHEN Attrition = 'Yes' THEN 1 WHEN Attrition = 'No' THEN 0 END END) * 100E0, 6) AS ot_rate_no,
       ROUND(AVG(CASE WHEN OverTime = 'Yes' THEN CASE WHEN Attrition = 'Yes' THEN 1 WHEN Attrition = 'No' THEN 0 END END) * 100E0, 6) AS ot_rate_yes,
       ROUND(AVG(CASE WHEN Attrition = 'Yes' THEN Age END), 6) AS mean_age_left,
       ROUND(AVG(CASE WHEN Attrition = 'No' THEN Age END), 6) AS mean_age_stayed,
       ROUND((SELECT quantile_cont(MonthlyIncome, 0.5) FROM v WHERE Attrition = 'Yes'), 6) AS median_income_left,
       ROUND((SELECT quantile_cont(MonthlyIncome, 0.5) FROM v WHERE Attrition = 'No'), 6) AS median_income_stayed,
       ROUND((SELECT quantile_cont(MonthlyIncome, 0.5) FROM v WHERE Attrition = 'No')
             - (SELECT quantile_cont(MonthlyIncome, 0.5) FROM v WHERE Attrition = 'Yes'), 6) AS median_income_gap,
       ROUND(AVG(CASE WHEN OverTime = 'Yes' THEN CASE WHEN Attrition = 'Yes' THEN 1 WHEN Attrition = 'No' THEN 0 END END)
             / NULLIF(AVG(CASE WHEN OverTime = 'No' THEN CASE WHEN Attrition = 'Yes' THEN 1 WHEN Attrition = 'No' THEN 0 END END), 0), 6) AS ot_multiple
FROM v"""))
def q_attrition_findings(spark, sf):
    df = ST.attrition_findings(E(spark, sf))
    return round_cols(df, {c: 6 for c in ["pct_left", "ot_rate_no", "ot_rate_yes", "mean_age_left", "mean_age_stayed",
                                          "median_income_left", "median_income_stayed", "median_income_gap",
                                          "ot_multiple"]})


@query("risk_scatter_points", with_v(f"""
SELECT EmployeeNumber, Department, JobRole, MonthlyIncome, YearsAtCompany, PerformanceRating, JobSatisfaction,
       ROUND(Risk, 6) AS Risk, ROUND({POTENTIAL_SQL}, 6) AS potential_score,
       ROUND({loss_sql('Risk', 'MonthlyIncome')}, 2) AS expected_loss FROM v"""))
def q_risk_scatter_points(spark, sf):
    return round_cols(ST.risk_scatter_points(E(spark, sf)), {"Risk": 6, "potential_score": 6, "expected_loss": 2})
