"""Pair comparison, radar scores, department position and rule texts.

The reference compares two picked employees.  Here every employee is paired
(``pair_id = (id + 1) DIV 2``: odd id on side 1, the next even id on side 2),
an equi-join on a key with at most two rows, so the comparison runs over the
whole table without a hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attriscope.functions.finance import expected_loss
from attriscope.operators.common import join_small, scalar_row
from attriscope.operators.quantiles import exact_median

HIGH = 0.5

# Fixed metric lists of the comparison (column, display label).
BAR_METRICS = [("MonthlyIncome", "Salary ($)"), ("Age", "Age"), ("TotalWorkingYears", "Total experience"),
               ("YearsAtCompany", "Company tenure"), ("DailyRate", "Daily rate"),
               ("DistanceFromHome", "Distance from home"), ("JobSatisfaction", "Job satisfaction"),
               ("EnvironmentSatisfaction", "Environment satisfaction")]


def pairs(emp: DataFrame) -> DataFrame:
    """(pair_id, side, row) for every employee: side 1 = odd id, side 2 = the next even id."""
    k = F.col("EmployeeNumber")
    return emp.withColumns({"pair_id": F.floor((k + F.lit(1)) / F.lit(2)).cast("long"),
                            "side": F.when(k % 2 == 1, F.lit(1)).otherwise(F.lit(2))})


def side_by_side(emp: DataFrame, columns: list[str], chosen: DataFrame | None = None) -> DataFrame:
    """(pair_id, emp1, emp2, a, b): the columns of both employees as structs.

    ``chosen(pair_id, emp1, emp2)`` names the pairs; each stays, with nulls where an id is absent.  Without
    it, employees pair as in :func:`pairs`, complete pairs only, by one join on the pair key.
    """
    one = emp.select(F.col("EmployeeNumber").alias("_id"), F.struct(*columns).alias("_row"))
    if chosen is not None:
        a = one.select(F.col("_id").alias("emp1"), F.col("_row").alias("a"))
        b = one.select(F.col("_id").alias("emp2"), F.col("_row").alias("b"))
        return chosen.join(a, "emp1", "left").join(b, "emp2", "left").select("pair_id", "emp1", "emp2", "a", "b")
    p = pairs(emp).select("pair_id", "side", F.col("EmployeeNumber").alias("_id"), F.struct(*columns).alias("_row"))
    a = p.where(F.col("side") == 1).select("pair_id", F.col("_id").alias("emp1"), F.col("_row").alias("a"))
    b = p.where(F.col("side") == 2).select("pair_id", F.col("_id").alias("emp2"), F.col("_row").alias("b"))
    return a.join(b, "pair_id").select("pair_id", "emp1", "emp2", "a", "b")


def pair_compare(emp: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Risk and loss of both employees of each pair (see :func:`side_by_side`)."""
    j = side_by_side(emp, ["Risk", "MonthlyIncome"], chosen).select(
        "pair_id", "emp1", "emp2", F.col("a.Risk").alias("risk1"), F.col("a.MonthlyIncome").alias("inc1"),
        F.col("b.Risk").alias("risk2"), F.col("b.MonthlyIncome").alias("inc2"))
    return j.select(
        "pair_id", "emp1", "emp2",
        (F.col("risk1") * F.lit(100.0)).alias("risk1_pct"), (F.col("risk2") * F.lit(100.0)).alias("risk2_pct"),
        F.when(F.col("risk1").isNotNull(), expected_loss("risk1", "inc1")).alias("cost1"),
        F.when(F.col("risk2").isNotNull(), expected_loss("risk2", "inc2")).alias("cost2"),
        (F.abs(F.col("risk1") - F.col("risk2")) * F.lit(100.0)).alias("risk_diff_pct"),
        F.when(F.col("risk1") > F.col("risk2"), F.col("emp1")).otherwise(F.col("emp2")).alias("more_risky"),
        F.when(F.col("risk1") > HIGH, F.lit("High")).otherwise(F.lit("Low")).alias("tag1"),
        F.when(F.col("risk2") > HIGH, F.lit("High")).otherwise(F.lit("Low")).alias("tag2"))


def pair_metrics_long(emp: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Wide-to-long: one row per (pair, side, metric) with the value as double.

    With ``chosen`` (see :func:`side_by_side`) every named pair has both sides; an absent id has null values.
    """
    if chosen is not None:
        both = side_by_side(emp, [m for m, _ in BAR_METRICS], chosen)
        rows = F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"emp{i}").alias("EmployeeNumber"), F.lit(m).alias("metric"),
                                  F.col(f"{ab}.{m}").cast("double").alias("value"), F.lit(lab).alias("label"))
                         for i, ab in ((1, "a"), (2, "b")) for m, lab in BAR_METRICS])
        return both.select("pair_id", F.inline(rows))
    p = pairs(emp)
    both = p.groupBy("pair_id").agg(F.count("*").alias("_n")).where(F.col("_n") == 2).select("pair_id")
    p = p.join(both, "pair_id")  # complete pairs only (equi-join on the pair key)
    ids = ["pair_id", "side", "EmployeeNumber"]
    vals = [F.col(m).cast("double").alias(m) for m, _ in BAR_METRICS]
    long = p.select(*ids, *vals).unpivot(ids, [m for m, _ in BAR_METRICS], "metric", "value")
    labels = F.create_map(*[x for m, lab in BAR_METRICS for x in (F.lit(m), F.lit(lab))])
    return long.withColumn("label", labels[F.col("metric")])


def pair_metrics_table(emp: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """One row per (pair, metric), value_1 / value_2: both sides joined once, then a fixed fan-out."""
    both = side_by_side(emp, [m for m, _ in BAR_METRICS], chosen)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(lab).alias("label"),
                              F.col(f"a.{m}").cast("double").alias("value_1"),
                              F.col(f"b.{m}").cast("double").alias("value_2")) for m, lab in BAR_METRICS])
    return both.select("pair_id", F.inline(rows))


def radar_scores(emp: DataFrame) -> DataFrame:
    """Eight 0..5 axes: income / total years / company years by the global max (guarded), ratings by 4."""
    m = scalar_row(emp, F.max("MonthlyIncome").alias("inc"), F.max("TotalWorkingYears").alias("tw"),
                   F.max("YearsAtCompany").alias("yc"))

    def by_max(c, mx, guard):
        if mx is None or (guard and mx <= 0):
            return F.lit(0.0)
        return F.col(c) / F.lit(float(mx)) * F.lit(5.0)

    def by4(c):
        return F.col(c) / F.lit(4.0) * F.lit(5.0)

    return emp.select(
        "EmployeeNumber",
        by_max("MonthlyIncome", m["inc"], False).alias("salary"),
        by4("JobSatisfaction").alias("job_satisfaction"),
        by_max("TotalWorkingYears", m["tw"], True).alias("total_experience"),
        by_max("YearsAtCompany", m["yc"], True).alias("company_tenure"),
        by4("EnvironmentSatisfaction").alias("environment_satisfaction"),
        by4("RelationshipSatisfaction").alias("relationship_satisfaction"),
        by4("WorkLifeBalance").alias("work_life_balance"),
        by4("PerformanceRating").alias("performance"))


def group_position(emp: DataFrame, key: str = "Department") -> DataFrame:
    """Each row against its group's means (group aggregate joined back; AQE broadcasts the small side)."""
    g = emp.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg("MonthlyIncome").alias("dept_avg_income"), F.avg("Risk").alias("dept_avg_risk"),
        F.avg("JobSatisfaction").alias("dept_avg_satisfaction"))
    j = join_small(emp.select("EmployeeNumber", key, "MonthlyIncome", "Risk", "JobSatisfaction"), g, key)
    return j.withColumns({
        "income_diff_pct": F.when(F.col("dept_avg_income") > 0,
                                  (F.col("MonthlyIncome") - F.col("dept_avg_income")) / F.col("dept_avg_income") * F.lit(100.0))
                            .otherwise(F.lit(0.0)),
        "risk_at_or_below_avg": F.col("Risk") <= F.col("dept_avg_risk"),
        "satisfaction_at_or_above_avg": F.col("JobSatisfaction") >= F.col("dept_avg_satisfaction"),
    })


# Fixed rule texts (strengths / weaknesses / advice), in rule order.
S_PAY, W_PAY = "Pay above the market median", "Pay below the market median"
S_SAT, W_SAT = "High job satisfaction", "Low job satisfaction"
S_WLB, W_WLB = "Good work-life balance", "Poor work-life balance"
S_OT, W_OT = "Regular working hours", "Overtime load"
S_ENV, W_ENV = "Good work-environment satisfaction", "Low work-environment satisfaction"
S_REL, W_REL = "Good working relationships", "Weak working relationships"
S_TEN_FMT, W_TEN = "Experienced staff (%d years)", "Low tenure (adaptation risk)"
ADV_URGENT = "May leave (%d%%). "
ADV_OT = "Cut extra hours. "
ADV_PAY = "Review salary. "
ADV_CAREER = "Discuss next steps."
ADV_STABLE = "Likely to stay (%d%%). Nothing to change."


def strengths_weaknesses(emp: DataFrame, median_income: float | None = None) -> DataFrame:
    med = exact_median(emp, "MonthlyIncome") if median_income is None else median_income
    inc_ok = F.col("MonthlyIncome") >= F.lit(med)
    rules = [
        (inc_ok, S_PAY, W_PAY),
        (F.col("JobSatisfaction") >= 3, S_SAT, W_SAT),
        (F.col("WorkLifeBalance") >= 3, S_WLB, W_WLB),
        (F.col("OverTime") == "No", S_OT, W_OT),
        (F.col("EnvironmentSatisfaction") >= 3, S_ENV, W_ENV),
        (F.col("RelationshipSatisfaction") >= 3, S_REL, W_REL),
    ]
    yac = F.col("YearsAtCompany")
    strengths = [F.when(c, F.lit(s)) for c, s, _ in rules] + [
        F.when(yac >= 5, F.format_string(S_TEN_FMT, yac))]
    weaknesses = [F.when(~c, F.lit(w)) for c, _, w in rules] + [F.when(yac <= 1, F.lit(W_TEN))]
    s = F.array_compact(F.array(*strengths))
    w = F.array_compact(F.array(*weaknesses))
    return emp.select("EmployeeNumber", F.array_join(s, "; ").alias("strengths"),
                      F.array_join(w, "; ").alias("weaknesses"),
                      F.size(s).alias("n_strengths"), F.size(w).alias("n_weaknesses"))


def action_advice(emp: DataFrame, median_income: float | None = None) -> DataFrame:
    med = exact_median(emp, "MonthlyIncome") if median_income is None else median_income
    pct = F.bround(F.col("Risk") * F.lit(100.0), 0).cast("int")
    urgent = F.concat(
        F.format_string(ADV_URGENT, pct),
        F.when(F.col("OverTime") == "Yes", F.lit(ADV_OT)).otherwise(F.lit("")),
        F.when(F.col("MonthlyIncome") < F.lit(med), F.lit(ADV_PAY)).otherwise(F.lit("")),
        F.when(F.col("JobSatisfaction") <= 2, F.lit(ADV_CAREER)).otherwise(F.lit("")))
    text = F.when(F.col("Risk") > HIGH, urgent).otherwise(F.format_string(ADV_STABLE, pct))
    return emp.select("EmployeeNumber", pct.alias("risk_pct"), text.alias("advice"))


# Fixed row labels of the 15-row comparison table, in display order.
DETAIL_METRICS = ["Monthly income ($)", "Age", "Total experience (years)", "Company tenure (years)",
                  "Job satisfaction (1-4)", "Environment satisfaction (1-4)", "Relationship satisfaction (1-4)",
                  "Work-life balance (1-4)", "Performance (3-4)", "Education (1-5)", "Distance from home (km)",
                  "Daily rate ($)", "Overtime", "Attrition risk (%)", "Estimated loss ($)"]


def _money(c):
    return F.concat(F.lit("$"), F.format_number(F.bround(c, 0).cast("long"), 0))


def detail_values(emp: DataFrame):
    """The 15 display values of one employee, as text, in DETAIL_METRICS order."""
    ints = ["Age", "TotalWorkingYears", "YearsAtCompany", "JobSatisfaction", "EnvironmentSatisfaction",
            "RelationshipSatisfaction", "WorkLifeBalance", "PerformanceRating", "Education", "DistanceFromHome",
            "DailyRate"]
    return F.array(
        _money(F.col("MonthlyIncome")),
        *[F.col(c).cast("string") for c in ints],
        F.when(F.col("OverTime") == "Yes", F.lit("Yes")).otherwise(F.lit("No")),
        F.concat(F.lit("%"), F.bround(F.col("Risk") * F.lit(100.0), 1).cast("string")),
        _money(expected_loss("Risk", "MonthlyIncome")))


def pair_detail_table(emp: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """15-row side-by-side table per pair: (pair_id, row, metric, value_1, value_2); ``chosen`` as in :func:`side_by_side`."""
    both = side_by_side(emp.select("EmployeeNumber", detail_values(emp).alias("vals")), ["vals"], chosen)
    names = F.array(*[F.lit(m) for m in DETAIL_METRICS])
    rows = F.transform(F.sequence(F.lit(1), F.lit(len(DETAIL_METRICS))),
                       lambda i: F.struct(i.alias("row"), F.element_at(names, i).alias("metric"),
                                          F.element_at(F.col("a.vals"), i).alias("value_1"),
                                          F.element_at(F.col("b.vals"), i).alias("value_2")))
    return both.select("pair_id", F.inline(rows))
