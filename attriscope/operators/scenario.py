"""What-if grid, intervention packages and their waterfall.

The reference rescoring one employee per slider move becomes one pass over
(employee x scenario): the scenario list is a literal array exploded per row
(a bounded fan-out fixed by the report, no join), the overrides are
``coalesce(override, current)`` and the scorer is re-evaluated on the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attriscope.functions.finance import expected_loss, roi
from attriscope.functions.scorer import formula_risk

# Fixed default what-if grid: (name, MonthlyIncome, JobRole, OverTime, JobSatisfaction, DistanceFromHome);
# None keeps the employee's own value.
WHAT_IF_SCENARIOS = [
    ("baseline", None, None, None, None, None),
    ("no_overtime", None, None, "No", None, None),
    ("satisfaction_4", None, None, None, 4, None),
    ("income_10000", 10000.0, None, None, None, None),
    ("income_10000_no_overtime_sat_4", 10000.0, None, "No", 4, None),
    ("overtime_sat_1", None, None, "Yes", 1, None),
]

# Fixed default intervention packages: (name, yearly raise $, overtime off, training & mentoring).
PACKAGES = [
    ("none", 0.0, False, False),
    ("raise_6000", 6000.0, False, False),
    ("overtime_off", 0.0, True, False),
    ("mentoring", 0.0, False, True),
    ("full", 6000.0, True, True),
]
OVERTIME_OFF_COST = 2500.0
MENTORING_COST = 1500.0


def _array_of(rows, schema_names, types):
    structs = []
    for r in rows:
        fields = [F.lit(v).cast(t).alias(n) for v, n, t in zip(r, schema_names, types)]
        structs.append(F.struct(*fields))
    return F.array(*structs)


def gauge_zone(pct):
    """Zones of the 0-100 gauge: [0,30) low, [30,60) medium, [60,100] high."""
    return F.when(pct < 30, F.lit("low")).when(pct < 60, F.lit("medium")).otherwise(F.lit("high"))


def what_if_grid(emp: DataFrame, scenarios=WHAT_IF_SCENARIOS, score=formula_risk) -> DataFrame:
    names = ["scenario", "s_income", "s_role", "s_overtime", "s_satisfaction", "s_distance"]
    types = ["string", "double", "string", "string", "int", "int"]
    grid = emp.select("*", F.inline(_array_of(scenarios, names, types)))
    inc = F.coalesce(F.col("s_income"), F.col("MonthlyIncome"))
    ot = F.coalesce(F.col("s_overtime"), F.col("OverTime"))
    js = F.coalesce(F.col("s_satisfaction"), F.col("JobSatisfaction"))
    cur = score()
    sim = score(overtime=ot, income=inc, job_sat=js)
    out = grid.select(
        "EmployeeNumber", "scenario",
        cur.alias("current_prob"), sim.alias("sim_prob"),
        expected_loss(cur, F.col("MonthlyIncome")).alias("current_loss"),
        expected_loss(sim, inc).alias("sim_loss"),
        F.coalesce(F.col("s_role"), F.col("JobRole")).alias("JobRole"),
        F.coalesce(F.col("s_distance"), F.col("DistanceFromHome")).alias("DistanceFromHome"))
    return out.withColumns({
        "delta_pct": (F.col("sim_prob") - F.col("current_prob")) * F.lit(100.0),
        "delta_loss": F.col("sim_loss") - F.col("current_loss"),
        "zone": gauge_zone(F.col("sim_prob") * F.lit(100.0)),
    })


WHAT_IF_COLUMNS = ["MonthlyIncome", "JobRole", "OverTime", "JobSatisfaction", "DistanceFromHome"]


def model_what_if_grid(emp: DataFrame, scorer, scenarios=WHAT_IF_SCENARIOS) -> DataFrame:
    """:func:`what_if_grid` on any scorer; the scenario named ``baseline`` is the current state."""
    names = ["scenario"] + [f"s_{c}" for c in WHAT_IF_COLUMNS]
    types = ["string"] + [emp.schema[c].dataType.simpleString() for c in WHAT_IF_COLUMNS]
    grid = emp.select("*", F.inline(_array_of(scenarios, names, types)))
    cases = grid.withColumns({c: F.coalesce(F.col(f"s_{c}"), F.col(c)) for c in WHAT_IF_COLUMNS})
    sim = scorer(cases.select("scenario", *[c for c in emp.columns if c != "Risk"]))
    keep = ["EmployeeNumber", "scenario", *WHAT_IF_COLUMNS]
    sim = sim.select(*keep, F.col("Risk").alias("sim_prob"), expected_loss("Risk", "MonthlyIncome").alias("sim_loss"))
    # the scorer runs once: the baseline comes from the employee's own scenarios, not from a second scored grid
    own, baseline = Window.partitionBy("EmployeeNumber"), F.col("scenario") == "baseline"
    sim = sim.withColumns({f"current_{c}": F.max(F.when(baseline, F.col(f"sim_{c}"))).over(own) for c in ("prob", "loss")})
    return sim.withColumns({
        "delta_pct": (F.col("sim_prob") - F.col("current_prob")) * F.lit(100.0),
        "delta_loss": F.col("sim_loss") - F.col("current_loss"),
        "zone": gauge_zone(F.col("sim_prob") * F.lit(100.0)),
    })


def model_intervention_roi(emp: DataFrame, scorer, packages=PACKAGES) -> DataFrame:
    """:func:`intervention_roi` on any scorer: income, overtime, satisfaction and environment overrides reach it."""
    names = ["package", "raise_yearly", "overtime_off", "mentoring"]
    packages = [("_now", 0.0, False, False), *packages]
    grid = emp.select("*", F.inline(_array_of(packages, names, ["string", "double", "boolean", "boolean"])))

    def better(c):
        return F.when(F.col("mentoring"), F.least(F.lit(4), F.col(c) + F.lit(1))).otherwise(F.col(c)).cast(emp.schema[c].dataType)

    cases = grid.withColumns({
        "MonthlyIncome": F.col("MonthlyIncome") + F.col("raise_yearly") / F.lit(12),
        "OverTime": F.when(F.col("overtime_off"), F.lit("No")).otherwise(F.col("OverTime")),
        "JobSatisfaction": better("JobSatisfaction"),
        "EnvironmentSatisfaction": better("EnvironmentSatisfaction"),
    })
    after = scorer(cases.select(*names, *[c for c in emp.columns if c != "Risk"]))
    after = after.select("EmployeeNumber", *names, F.col("Risk").alias("prob_after"), expected_loss("Risk", "MonthlyIncome").alias("loss_after"))
    own, now = Window.partitionBy("EmployeeNumber"), F.col("package") == "_now"  # scored once, as above
    out = after.withColumns({f"{c}_before": F.max(F.when(now, F.col(f"{c}_after"))).over(own) for c in ("prob", "loss")}).where("package <> '_now'")
    cost = F.col("raise_yearly") + F.when(F.col("overtime_off"), OVERTIME_OFF_COST).otherwise(0.0) + F.when(F.col("mentoring"), MENTORING_COST).otherwise(0.0)
    out = out.withColumn("investment", cost).withColumn("saving", F.col("loss_before") - F.col("loss_after"))
    return out.select("EmployeeNumber", "package", "prob_before", "prob_after", "loss_before", "loss_after", "investment", "saving",
                      F.when(F.col("investment") > 0, roi("saving", "investment")).otherwise(F.lit(0.0)).alias("roi_pct"))


def intervention_roi(emp: DataFrame, packages=PACKAGES, score=formula_risk) -> DataFrame:
    """Per employee and package: probabilities, losses, costs, saving, ROI, saving per dollar, verdict."""
    names = ["package", "raise_yearly", "overtime_off", "mentoring"]
    grid = emp.select("*", F.inline(_array_of(packages, names, ["string", "double", "boolean", "boolean"])))
    new_inc = F.col("MonthlyIncome") + F.col("raise_yearly") / F.lit(12)
    new_ot = F.when(F.col("overtime_off"), F.lit("No")).otherwise(F.col("OverTime"))
    # saturating +1 (guarded: a null rating stays null)
    new_js = F.when(F.col("mentoring") & F.col("JobSatisfaction").isNotNull(),
                    F.least(F.lit(4), F.col("JobSatisfaction") + F.lit(1))).otherwise(F.col("JobSatisfaction"))
    new_es = F.when(F.col("mentoring") & F.col("EnvironmentSatisfaction").isNotNull(),
                    F.least(F.lit(4), F.col("EnvironmentSatisfaction") + F.lit(1))).otherwise(F.col("EnvironmentSatisfaction"))
    cur = score()
    after = score(overtime=new_ot, income=new_inc, job_sat=new_js)
    cost_ot = F.when(F.col("overtime_off"), F.lit(OVERTIME_OFF_COST)).otherwise(F.lit(0.0))
    cost_edu = F.when(F.col("mentoring"), F.lit(MENTORING_COST)).otherwise(F.lit(0.0))
    out = grid.select(
        "EmployeeNumber", "package",
        cur.alias("prob_before"), after.alias("prob_after"),
        expected_loss(cur, F.col("MonthlyIncome")).alias("loss_before"),
        expected_loss(after, new_inc).alias("loss_after"),
        new_inc.alias("income_after"), new_es.alias("environment_after"),
        F.col("raise_yearly").alias("cost_salary"), cost_ot.alias("cost_overtime"), cost_edu.alias("cost_training"))
    out = out.withColumn("investment", F.col("cost_salary") + F.col("cost_overtime") + F.col("cost_training"))
    out = out.withColumn("saving", F.col("loss_before") - F.col("loss_after"))
    out = out.withColumn("roi_pct", F.when(F.col("investment") > 0, roi("saving", "investment")).otherwise(F.lit(0.0)))
    return out.withColumns({
        "saving_per_dollar": F.when(F.col("investment") > 0, F.col("saving") / F.col("investment")),
        "verdict": F.when(F.col("investment") <= 0, F.lit("no investment"))
                    .when(F.col("roi_pct") > 0, F.lit("profitable")).otherwise(F.lit("not profitable")),
    })


def roi_waterfall(emp: DataFrame, package: str = "full", packages=PACKAGES) -> DataFrame:
    """Five waterfall steps per employee with the running level, from one package.

    The running level is column arithmetic on the fixed step list (no window);
    the end bar's plotted amount is ``-old + costs + new`` (as drawn), and the
    new loss is kept as its own column.
    """
    pk = [p for p in packages if p[0] == package]
    r = intervention_roi(emp, pk)
    lv1 = F.col("loss_before")
    lv2 = lv1 + F.col("cost_salary")
    lv3 = lv2 + F.col("cost_overtime")
    lv4 = lv3 + F.col("cost_training")
    end_amount = -F.col("loss_before") + F.col("investment") + F.col("loss_after")
    def step(i, label, measure, amount, level):
        return F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.lit(measure).alias("measure"),
                        amount.alias("amount"), level.alias("running_level"))

    steps = F.array(
        step(1, "current_loss", "absolute", F.col("loss_before"), lv1),
        step(2, "salary_cost", "relative", F.col("cost_salary"), lv2),
        step(3, "overtime_cost", "relative", F.col("cost_overtime"), lv3),
        step(4, "training_cost", "relative", F.col("cost_training"), lv4),
        step(5, "new_loss", "total", end_amount, lv4 + end_amount),
    )
    return r.select("EmployeeNumber", "package", F.col("loss_after").alias("new_loss"), F.inline(steps))
