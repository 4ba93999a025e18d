"""Risk reports over the scored employee table (entity columns + ``Risk``).

Every report is a grouped / global aggregate with partial (map-side)
aggregation; group results are small and joined back only through broadcast
of a result bounded by the number of groups.  Global scalars (median income)
are computed once by the distributed exact-quantile operator and enter the
plans as literals, not as un-partitioned windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attriscope.functions.bands import band_index, complete_bands
from attriscope.functions.finance import expected_loss, roi
from attriscope.operators.common import join_small, known_keys
from attriscope.operators.quantiles import exact_median

# Fixed cut-offs of the reports.
HIGH = 0.5        # high risk
CRITICAL = 0.7    # critical risk
AT_RISK = 0.4     # at-risk (pay / satisfaction / youth segments)
SAFE = 0.3        # "core star" upper bound

def loss():
    """Expected loss of a scored row."""
    return expected_loss("Risk", "MonthlyIncome")


def company_kpis(emp: DataFrame) -> DataFrame:
    """Rows, high / critical counts, critical share (%), mean risk, total expected loss."""
    return emp.agg(
        F.count("*").alias("n_employees"),
        F.count_if(F.col("Risk") > HIGH).alias("n_high_risk"),
        F.count_if(F.col("Risk") > CRITICAL).alias("n_critical"),
        F.try_divide(F.count_if(F.col("Risk") > CRITICAL) * F.lit(100.0), F.count("*")).alias("critical_pct"),
        F.avg("Risk").alias("avg_risk"),
        F.sum(loss()).alias("total_expected_loss"),
    )


def department_profile(emp: DataFrame) -> DataFrame:
    """Per department: mean risk, head count, high-risk count and rate, means, expected loss.

    The reference recomputes each department's loss by re-filtering the table
    per group (a correlated subquery); here it is one more aggregate column.
    """
    g = known_keys(emp, "Department").groupBy("Department").agg(
        F.avg("Risk").alias("avg_risk"),
        F.count("*").alias("n_employees"),
        F.count_if(F.col("Risk") > HIGH).alias("n_high_risk"),
        F.avg("MonthlyIncome").alias("avg_income"),
        F.avg("YearsAtCompany").alias("avg_tenure"),
        F.avg("JobSatisfaction").alias("avg_satisfaction"),
        F.sum(loss()).alias("expected_loss"),
    )
    return g.withColumn("high_risk_rate", F.bround(F.col("n_high_risk") * F.lit(100.0) / F.col("n_employees"), 1))


def role_risk(emp: DataFrame) -> DataFrame:
    return (known_keys(emp, "JobRole").groupBy("JobRole").agg(F.avg("Risk").alias("avg_risk"))
            .orderBy("avg_risk", "JobRole"))


def risk_hierarchy(emp: DataFrame) -> DataFrame:
    """Department > role tree: leaf and parent counts / mean risk via ROLLUP."""
    return (known_keys(emp, "Department", "JobRole")
            .rollup("Department", "JobRole")
            .agg(F.count("*").alias("n_employees"), F.avg("Risk").alias("avg_risk"),
                 F.grouping_id().cast("int").alias("level")))


def role_department_pivot(emp: DataFrame, departments: list[str] | None = None) -> DataFrame:
    """Mean risk, role rows x department columns; an empty cell is null."""
    e = known_keys(emp, "JobRole", "Department")
    if departments is None:
        # one output column for each department: the caller asks for a table that wide (long form: role_department_long)
        departments = sorted(r[0] for r in e.select("Department").distinct().collect())
    return e.groupBy("JobRole").pivot("Department", departments).agg(F.avg("Risk"))



def role_department_long(emp: DataFrame) -> DataFrame:
    """Mean risk of each (role, department) as rows, for any number of departments."""
    return known_keys(emp, "JobRole", "Department").groupBy("JobRole", "Department").agg(F.avg("Risk").alias("avg_risk"))


PERFORMANCE_LEVELS = ("Low", "Expected", "Outstanding")


def performance_level(col="PerformanceRating"):
    c = F.col(col)
    return (F.when(c.isin(1, 2), F.lit("Low")).when(c == 3, F.lit("Expected"))
             .when(c == 4, F.lit("Outstanding")))


def nine_box(emp: DataFrame) -> DataFrame:
    """Count by risk band (rows, empty bands kept) x performance level (columns, 0 if empty)."""
    e = emp.select(band_index("Risk", "ninebox_risk").alias("band_ix"), performance_level().alias("perf"))
    counts = (e.where(F.col("band_ix").isNotNull() & F.col("perf").isNotNull())
               .groupBy("band_ix").pivot("perf", list(PERFORMANCE_LEVELS)).count())
    out = complete_bands(counts, "ninebox_risk", label_col="risk_band")
    return out.na.fill(0, list(PERFORMANCE_LEVELS)).select("band_ix", "risk_band", *PERFORMANCE_LEVELS)


def extreme_groups(emp: DataFrame) -> DataFrame:
    """Group with the highest / lowest mean risk; ties go to the first key (band order / name).

    The three groupings are grouping sets of one aggregate (one scan); the four picks are one more aggregate over its
    few rows.
    """
    from attriscope.functions.bands import BANDS

    src = emp.select("Department", band_index("Age", "age").alias("age"), band_index("YearsAtCompany", "tenure").alias("tenure"), "Risk")
    means = src.groupingSets([["Department"], ["age"], ["tenure"]], "Department", "age", "tenure").agg(
        F.avg("Risk").alias("m"), F.grouping("Department").alias("not_d"), F.grouping("age").alias("not_a"), F.grouping("tenure").alias("not_t"))

    def label(scheme, band):
        return F.element_at(F.array(*[F.lit(x) for x in BANDS[scheme].labels]), F.col(band) + 1)

    kinds = [("not_d", F.col("Department"), F.lit(0)), ("not_a", label("age", "age"), F.col("age")), ("not_t", label("tenure", "tenure"), F.col("tenure"))]
    picks = [("Department", "max", 0), ("Department", "min", 0), ("AgeBand", "max", 1), ("TenureBand", "max", 2)]
    aggs = []
    for i, (_, kind, which) in enumerate(picks):
        flag, key, place = kinds[which]
        here = (F.col(flag) == 0) & key.isNotNull()
        order = F.when(here, F.struct((-F.col("m") if kind == "max" else F.col("m")).alias("m"), place.alias("o"), key.alias("k")))
        aggs += [F.min_by(key, order).alias(f"k{i}"), F.min_by("m", order).alias(f"m{i}")]
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(kind).alias("extreme"), F.col(f"k{i}").alias("group_key"), F.col(f"m{i}").alias("avg_risk"))
                     for i, (d, kind, _) in enumerate(picks)])
    return means.agg(*aggs).select(F.inline(rows))


def label_num(col="Attrition"):
    c = F.col(col)
    return F.when(c == "Yes", F.lit(1)).when(c == "No", F.lit(0))


def overtime_label_counts(emp: DataFrame) -> DataFrame:
    return known_keys(emp, "OverTime", "Attrition").groupBy("OverTime", "Attrition").agg(F.count("*").alias("n"))


def overtime_label_rate(emp: DataFrame) -> DataFrame:
    """Leaver rate (%) by overtime and the Yes / No rate ratio (same on both rows)."""
    g = known_keys(emp, "OverTime").groupBy("OverTime").agg(
        (F.avg(label_num()) * F.lit(100.0)).alias("attrition_rate"), F.count("*").alias("n"))
    # window over the grouped result (one row per overtime value), not over employees
    w = Window.partitionBy()
    ratio = F.try_divide(F.max(F.when(F.col("OverTime") == "Yes", F.col("attrition_rate"))).over(w),
                         F.max(F.when(F.col("OverTime") == "No", F.col("attrition_rate"))).over(w))
    return g.withColumn("rate_ratio", ratio)


def class_balance(df: DataFrame, col: str = "Attrition") -> DataFrame:
    """Value counts with shares (%) of the whole."""
    g = df.groupBy(col).agg(F.count("*").alias("n"))
    # total over the grouped result (one row per class value)
    return g.withColumn("share_pct", F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy()))


def risk_threshold_counts(emp: DataFrame) -> DataFrame:
    row = emp.agg(*[F.count_if(F.col("Risk") > t).alias(f"c{i}") for i, t in enumerate((AT_RISK, HIGH, CRITICAL))])
    return row.select(F.expr(f"stack(3, {AT_RISK}D, c0, {HIGH}D, c1, {CRITICAL}D, c2) as (threshold, n)"))


def segment_predicates(median_income: float) -> dict:
    inc, r, perf = F.col("MonthlyIncome"), F.col("Risk"), F.col("PerformanceRating")
    med = F.lit(median_income)
    return {
        "low_pay_high_risk": (inc < med) & (r > HIGH),
        "flight_risk": (perf == 4) & (r > HIGH),
        "core_star": (perf == 4) & (r <= SAFE),
        "at_risk_below_median_pay": (inc < med) & (r > AT_RISK),
        "at_risk_at_or_above_median_pay": (inc >= med) & (r > AT_RISK),
        "low_satisfaction_at_risk": (F.col("JobSatisfaction") <= 2) & (r > AT_RISK),
        "overtime_high_risk": (F.col("OverTime") == "Yes") & (r > HIGH),
        "young_at_risk": (F.col("Age") < 30) & (r > AT_RISK),
    }


def risk_segments(emp: DataFrame, median_income: float | None = None) -> DataFrame:
    med = exact_median(emp, "MonthlyIncome") if median_income is None else median_income
    preds = segment_predicates(med)
    row = emp.agg(*[F.count_if(p).alias(k) for k, p in preds.items()])
    stack = ", ".join(f"'{k}', `{k}`" for k in preds)
    return row.select(F.expr(f"stack({len(preds)}, {stack}) as (segment, n)"))


def risk_band_distribution(emp: DataFrame) -> DataFrame:
    c = emp.select(band_index("Risk", "risk5").alias("band_ix")).where(F.col("band_ix").isNotNull()) \
           .groupBy("band_ix").agg(F.count("*").alias("n"))
    return complete_bands(c, "risk5", fill={"n": 0})


def equi_width_hist(df: DataFrame, value: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width histogram between the (group's) min and max; the max falls in the last bin."""
    keys = [by] if by else []
    src = known_keys(df, *keys) if by else df
    src = src.where(F.col(value).isNotNull())
    rng = src.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"),
                                 F.avg(value).alias("mean"))
    if not keys:  # whole-table range: three scalars enter the plan as literals
        r = rng.collect()[0]
        src = src.withColumns({"lo": F.lit(r["lo"]), "hi": F.lit(r["hi"]), "mean": F.lit(r["mean"]).cast("double")})
        x = F.col(value).cast("double")
        w = (F.col("hi") - F.col("lo")).cast("double") / F.lit(float(bins))
        b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
            F.least(F.floor((x - F.col("lo")) / w) + F.lit(1), F.lit(bins)).cast("int"))
        h = src.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
        return h.select("bin", "n", F.lit(r["mean"]).cast("double").alias("mean"),
                        (F.lit(r["lo"]) + (F.col("bin") - F.lit(1)) * (F.lit(r["hi"]) - F.lit(r["lo"])).cast("double") / F.lit(float(bins))).alias("bin_lo"),
                        (F.lit(r["lo"]) + F.col("bin") * (F.lit(r["hi"]) - F.lit(r["lo"])).cast("double") / F.lit(float(bins))).alias("bin_hi"))
    x = F.col(value).cast("double")
    w = (F.col("hi") - F.col("lo")).cast("double") / F.lit(float(bins))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor((x - F.col("lo")) / w) + F.lit(1), F.lit(bins)).cast("int"))
    # rng has one row per group: a bounded broadcast
    joined = join_small(src, rng, keys)      # one row per group, size-checked
    h = joined.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    edges = rng.select(*keys, "lo", "hi", "mean")
    out = join_small(h, edges, keys)
    wd = (F.col("hi") - F.col("lo")).cast("double") / F.lit(float(bins))
    return out.withColumns({
        "bin_lo": F.col("lo") + (F.col("bin") - F.lit(1)) * wd,
        "bin_hi": F.col("lo") + F.col("bin") * wd,
    }).drop("lo", "hi", "_k")


def age_histogram(emp: DataFrame) -> DataFrame:
    return equi_width_hist(emp, "Age", 20, by="Attrition")


def risk_histogram(emp: DataFrame) -> DataFrame:
    return equi_width_hist(emp, "Risk", 30)


def box_stats(emp: DataFrame, value: str = "MonthlyIncome", by: str = "Attrition") -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (extreme data points inside the fences) and outlier count."""
    from attriscope.operators.quantiles import exact_quantile_frame

    src = known_keys(emp, by)
    q = exact_quantile_frame(src, value, [0.25, 0.5, 0.75], by=[by], names=["q1", "median", "q3"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")).withColumns({
        "fence_lo": F.col("q1") - F.lit(1.5) * F.col("iqr"),
        "fence_hi": F.col("q3") + F.lit(1.5) * F.col("iqr")})
    x = F.col(value)
    inside = (x >= F.col("fence_lo")) & (x <= F.col("fence_hi"))
    agg = (src.join(F.broadcast(q), by)  # one row per class
              .groupBy(by).agg(F.min(F.when(inside, x)).alias("whisker_lo"),
                               F.max(F.when(inside, x)).alias("whisker_hi"),
                               F.count_if(~inside).alias("n_outliers")))
    return q.join(agg, by).drop("fence_lo", "fence_hi")


def income_by_label(emp: DataFrame) -> DataFrame:
    from attriscope.operators.quantiles import exact_quantile_frame

    src = known_keys(emp, "Attrition")
    med = exact_quantile_frame(src, "MonthlyIncome", [0.5], by=["Attrition"], names=["median_income"])
    mean = src.groupBy("Attrition").agg(F.avg("MonthlyIncome").alias("mean_income"), F.count("*").alias("n"))
    return mean.join(F.broadcast(med), "Attrition")


def overtime_risk_compare(emp: DataFrame) -> DataFrame:
    """Overtime vs not: counts, share, mean risk (0 if empty), ratio shown only if overtime is riskier."""
    yes = F.col("OverTime") == "Yes"
    no = F.col("OverTime") == "No"
    a = emp.agg(
        F.count_if(yes).alias("n_overtime"), F.count_if(no).alias("n_regular"),
        F.try_divide(F.count_if(yes) * F.lit(100.0), F.count("*")).alias("overtime_share_pct"),
        F.coalesce(F.avg(F.when(yes, F.col("Risk"))), F.lit(0.0)).alias("avg_risk_overtime"),
        F.coalesce(F.avg(F.when(no, F.col("Risk"))), F.lit(0.0)).alias("avg_risk_regular"),
        F.count_if(yes & (F.col("Risk") > HIGH)).alias("n_overtime_high_risk"),
    )
    shown = (F.col("n_overtime") > 0) & (F.col("avg_risk_overtime") > F.col("avg_risk_regular"))
    ratio = F.when(F.col("avg_risk_regular") > 0, F.col("avg_risk_overtime") / F.col("avg_risk_regular")).otherwise(F.lit(0.0))
    return a.withColumn("risk_ratio", F.when(shown, ratio))


def age_band_risk(emp: DataFrame) -> DataFrame:
    g = (emp.withColumn("band_ix", band_index("Age", "age")).where(F.col("band_ix").isNotNull())
            .groupBy("band_ix").agg(F.avg("Risk").alias("avg_risk"), F.count("*").alias("n"),
                                    F.count_if(F.col("Risk") > HIGH).alias("n_high_risk")))
    return complete_bands(g, "age", fill={"n": 0, "n_high_risk": 0})


def tenure_band_risk(emp: DataFrame) -> DataFrame:
    g = (emp.withColumn("band_ix", band_index("YearsAtCompany", "tenure")).where(F.col("band_ix").isNotNull())
            .groupBy("band_ix").agg(F.avg("Risk").alias("avg_risk"), F.count("*").alias("n"),
                                    F.avg("MonthlyIncome").alias("avg_income")))
    return complete_bands(g, "tenure", fill={"n": 0})


# Fixed satisfaction level names.
SATISFACTION_NAMES = {1: "1 - Low", 2: "2 - Medium", 3: "3 - High", 4: "4 - Very High"}


def satisfaction_name(col="JobSatisfaction"):
    m = F.create_map(*[x for k, v in SATISFACTION_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return m[F.col(col)]


def satisfaction_risk(emp: DataFrame) -> DataFrame:
    return (known_keys(emp, "JobSatisfaction").groupBy("JobSatisfaction")
            .agg(F.avg("Risk").alias("avg_risk"), F.count("*").alias("n"))
            .withColumn("level", satisfaction_name()))


RAISE_RATE = 0.10   # 10 % raise
MONTHS = 12


def raise_programme_roi(emp: DataFrame, median_income: float | None = None) -> DataFrame:
    """10 % raise for below-median-pay at-risk staff: yearly cost, loss avoided, ROI (0 if no cost)."""
    med = exact_median(emp, "MonthlyIncome") if median_income is None else median_income
    seg = (F.col("MonthlyIncome") < F.lit(med)) & (F.col("Risk") > AT_RISK)
    a = emp.agg(F.count_if(seg).alias("n_employees"),
                F.coalesce(F.sum(F.when(seg, F.col("MonthlyIncome"))), F.lit(0.0)).alias("_inc"),
                F.coalesce(F.sum(F.when(seg, loss())), F.lit(0.0)).alias("prevented_loss"))
    a = a.withColumn("raise_cost", F.col("_inc") * F.lit(RAISE_RATE) * F.lit(float(MONTHS))).drop("_inc")
    return a.withColumn("roi_pct", F.when(F.col("raise_cost") > 0,
                                          (F.col("prevented_loss") - F.col("raise_cost")) / F.col("raise_cost") * F.lit(100.0))
                        .otherwise(F.lit(0.0)))


def critical_alerts(emp: DataFrame, n: int = 5) -> DataFrame:
    """Top-n critical (> 0.7) employees by risk; ties by id (a distributed top-k)."""
    return (emp.where(F.col("Risk") > CRITICAL)
               .orderBy(F.col("Risk").desc(), F.col("EmployeeNumber"))
               .limit(n)
               .select("EmployeeNumber", "JobRole", "Risk", loss().alias("expected_loss")))


def flight_risk_stars(emp: DataFrame) -> DataFrame:
    return (emp.where((F.col("PerformanceRating") == 4) & (F.col("Risk") > HIGH))
               .select("EmployeeNumber", "Department", "JobRole", "MonthlyIncome", "JobSatisfaction", "Risk")
               .orderBy(F.col("Risk").desc(), "EmployeeNumber"))


def expected_loss_by_group(emp: DataFrame, key: str = "Department") -> DataFrame:
    return known_keys(emp, key).groupBy(key).agg(F.sum(loss()).alias("expected_loss"))


def expected_loss_rows(emp: DataFrame) -> DataFrame:
    return emp.select("EmployeeNumber", "Risk", "MonthlyIncome", loss().alias("expected_loss"))


def overtime_roi_rows(emp: DataFrame, cost: float = 2500.0) -> DataFrame:
    """Per employee: cancelling overtime costs ``cost`` (0 if none); ROI of avoiding the loss."""
    inv = F.when(F.col("OverTime") == "Yes", F.lit(cost)).otherwise(F.lit(0.0))
    return emp.select("EmployeeNumber", loss().alias("saving"), inv.alias("investment")) \
              .withColumn("roi_pct", roi("saving", "investment"))


def above_median_flag(emp: DataFrame, median_income: float | None = None) -> DataFrame:
    med = exact_median(emp, "MonthlyIncome") if median_income is None else median_income
    return emp.select("EmployeeNumber", "MonthlyIncome", F.lit(med).alias("median_income"),
                      (F.col("MonthlyIncome") >= F.lit(med)).alias("at_or_above_median"))


def label_lookup(emp: DataFrame) -> DataFrame:
    return emp.select("EmployeeNumber", "PerformanceRating", performance_level().alias("performance_level"),
                      "JobSatisfaction", satisfaction_name().alias("satisfaction_level"))
