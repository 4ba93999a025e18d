"""Department action plan, rule-based strategy report, narrative findings, point sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attriscope.operators.quantiles import exact_median, exact_quantiles
from attriscope.operators.risk import department_profile, label_num, loss
from attriscope.operators.talent import potential_score

# Fixed severity cut-offs and advice texts of the action plan.
URGENT, IMPORTANT = 0.35, 0.25
ADVICE = {
    "urgent": "Act this month: talk to each person, check pay against the market, loosen fixed hours.",
    "important": "Act this quarter: ask what is missing, agree growth steps, strengthen the team.",
    "controlled": "No action due: look at the figures again next quarter.",
}
# Fixed strategy rule texts (rule order is the report order).
GATE = 5
T_PAY = "Pay: lift the salaries of %d people below the median who may leave by 10%%; this costs about $%s a year"
T_OT = "Hours: %d people with regular overtime are likely to leave; cut or compensate the extra hours."
T_DEPT = "Where to begin: mean risk is highest in %s."
T_YOUNG = "Under thirty: %d people may leave; give each a mentor and a next step."
T_GENERAL = "Overall mean risk: %s%%. %s"
MSG_OK = "This is within the target."
MSG_URGENT = "This is far above the target."
MSG_MEDIUM = "This is somewhat above the target."


def severity(avg):
    return (F.when(avg > URGENT, F.lit("urgent")).when(avg > IMPORTANT, F.lit("important"))
             .otherwise(F.lit("controlled")))


def department_actions(emp: DataFrame) -> DataFrame:
    d = department_profile(emp)
    sev = severity(F.col("avg_risk"))
    adv = F.create_map(*[x for k, v in ADVICE.items() for x in (F.lit(k), F.lit(v))])
    return d.select("Department", "avg_risk", "n_employees", "n_high_risk", "avg_income", "avg_tenure",
                    "avg_satisfaction", "high_risk_rate", "expected_loss",
                    sev.alias("severity"), adv[sev].alias("advice")).orderBy(F.col("avg_risk").desc(), "Department")


def company_message(avg):
    return (F.when(avg < 0.25, F.lit(MSG_OK)).when(avg > 0.35, F.lit(MSG_URGENT)).otherwise(F.lit(MSG_MEDIUM)))


def strategy_report(emp: DataFrame, median_income: float | None = None) -> DataFrame:
    """Ordered rules; pay / overtime / youth rules only when more than 5 people qualify."""
    med = exact_median(emp, "MonthlyIncome") if median_income is None else median_income
    r = F.col("Risk")
    low_inc = (F.col("MonthlyIncome") < F.lit(med)) & (r > 0.4)
    a = emp.agg(
        F.count_if(low_inc).alias("n_low_inc"),
        F.coalesce(F.sum(F.when(low_inc, F.col("MonthlyIncome"))), F.lit(0.0)).alias("low_inc_sum"),
        F.count_if((F.col("OverTime") == "Yes") & (r > 0.5)).alias("n_ot"),
        F.count_if((F.col("Age") < 30) & (r > 0.4)).alias("n_young"),
        F.avg("Risk").alias("avg_risk"))
    riskiest = (emp.where(F.col("Department").isNotNull()).groupBy("Department").agg(F.avg("Risk").alias("m"))
                   .agg(F.min_by("Department", F.struct(-F.col("m"), F.col("Department"))).alias("riskiest"))
                   .first()["riskiest"])  # one value
    a = a.withColumn("riskiest", F.lit(riskiest).cast("string"))
    cost = F.bround(F.col("low_inc_sum") * F.lit(0.1) * F.lit(12.0), 0).cast("long")
    avg_pct = F.bround(F.col("avg_risk") * F.lit(100.0), 1).cast("string")
    def rule(i, topic, on, text):
        return F.struct(F.lit(i).alias("rule"), F.lit(topic).alias("topic"), on.alias("on"), text.alias("text"))

    rules = F.array(
        rule(1, "pay", F.col("n_low_inc") > GATE,
             F.format_string(T_PAY, F.col("n_low_inc"), F.format_number(cost, 0))),
        rule(2, "overtime", F.col("n_ot") > GATE, F.format_string(T_OT, F.col("n_ot"))),
        rule(3, "department", F.col("riskiest").isNotNull(), F.format_string(T_DEPT, F.col("riskiest"))),
        rule(4, "youth", F.col("n_young") > GATE, F.format_string(T_YOUNG, F.col("n_young"))),
        rule(5, "general", F.col("avg_risk").isNotNull(), F.format_string(T_GENERAL, avg_pct, company_message(F.col("avg_risk")))),
    )
    on = F.filter(rules, lambda x: x["on"])
    # number the emitted rules in rule order (positions inside the one-row array)
    numbered = F.transform(on, lambda x, i: F.struct((i + 1).alias("item"), x["topic"].alias("topic"),
                                                     x["text"].alias("text")))
    return a.select(F.inline(numbered))


def attrition_findings(emp: DataFrame) -> DataFrame:
    """One row of narrative numbers: totals, median pay gap, overtime multiple, mean ages."""
    src = emp.where(F.col("Attrition").isNotNull())
    med = exact_quantiles(src, "MonthlyIncome", [0.5], by=["Attrition"])
    m_yes = med.get(("Yes",), {}).get(0.5)
    m_no = med.get(("No",), {}).get(0.5)
    y = label_num()
    ot_yes, ot_no = F.col("OverTime") == "Yes", F.col("OverTime") == "No"
    a = emp.agg(
        F.count("*").alias("n_total"), F.count_if(F.col("Attrition") == "Yes").alias("n_left"),
        (F.count_if(F.col("Attrition") == "Yes") * F.lit(100.0) / F.count("*")).alias("pct_left"),
        (F.avg(F.when(ot_no, y)) * F.lit(100.0)).alias("ot_rate_no"),
        (F.avg(F.when(ot_yes, y)) * F.lit(100.0)).alias("ot_rate_yes"),
        F.avg(F.when(F.col("Attrition") == "Yes", F.col("Age"))).alias("mean_age_left"),
        F.avg(F.when(F.col("Attrition") == "No", F.col("Age"))).alias("mean_age_stayed"))
    return a.select("*",
                    F.lit(m_yes).cast("double").alias("median_income_left"),
                    F.lit(m_no).cast("double").alias("median_income_stayed"),
                    (F.lit(m_no).cast("double") - F.lit(m_yes).cast("double")).alias("median_income_gap"),
                    F.try_divide(F.col("ot_rate_yes"), F.col("ot_rate_no")).alias("ot_multiple"))


def risk_scatter_points(emp: DataFrame) -> DataFrame:
    """The point sets behind the scatter charts (every row; a projection)."""
    return emp.select("EmployeeNumber", "Department", "JobRole", "MonthlyIncome", "YearsAtCompany",
                      "PerformanceRating", "JobSatisfaction", "Risk", potential_score().alias("potential_score"),
                      loss().alias("expected_loss"))


