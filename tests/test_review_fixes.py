"""Cases of the last review: large and negative ids, NaN, empty tables, search space, scenarios on a model, CSV order."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from attriscope.operators import ml as ML
from attriscope.operators import profile as P
from attriscope.operators import risk as R
from attriscope.operators import scenario as S
from attriscope.operators import strategy as ST
from attriscope.operators.compare import pair_compare
from attriscope.operators.features import fit_features, one_hot_long, seeded_sample
from attriscope.operators.resample import smote
from attriscope.operators.split import stratified_folds, stratified_split
from attriscope.session import work_path
from attriscope.sources.files import EMPLOYEE_SCHEMA, load_model_bundle, read_csv, write_csv


@pytest.mark.parametrize("base", [10**18, -200])
def test_any_64_bit_ids(spark, base):
    df = spark.range(200).select((F.col("id") + base).alias("id"), (F.col("id") % 4 == 0).cast("int").alias("y"),
                                 F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double")).alias("vec"))
    split = stratified_split(df, "y", "id")
    assert split.where("split = 'test'").count() == 40
    assert stratified_folds(df, "y", "id").groupBy("fold").count().count() == 5
    rows = smote(df, "y", 1, 3).collect()
    assert len(rows) == 100 and all(0 <= r.u < 1 for r in rows)


def test_sample_spans_the_ids(spark):
    ids = [r[0] for r in seeded_sample(spark.range(3_000_000).withColumnRenamed("id", "EmployeeNumber"), 100).collect()]
    assert len(set(ids)) == 100 and min(ids) < 200_000 and max(ids) > 2_800_000


def test_nan_is_missing_and_empty_tables_have_results(spark, emp):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "x double")
    r = P.numeric_summary(df).first()
    assert (r["count"], r["mean"], r["max"], r["q50"]) == (2, 1.5, 2.0, 1.5)
    assert P.zero_variance_columns(spark.createDataFrame([(1.0,), (float("nan"),)], "x double")).count() == 1
    none = emp.where("false")
    assert R.company_kpis(none).first()["critical_pct"] is None
    assert R.overtime_risk_compare(none).first()["overtime_share_pct"] is None
    assert all(x["null_pct"] is None for x in P.null_profile(none).collect())
    assert ST.strategy_report(none, 1.0).count() == 0


def test_csv_order_and_extra_columns(spark, emp):
    names = [f.name for f in EMPLOYEE_SCHEMA.fields]
    src = emp.select(F.lit("x").alias("New"), *sorted(names), F.lit(1).alias("Other"))
    got = read_csv(spark, write_csv(src, work_path(spark, "order")))
    assert got.columns == names and got.exceptAll(emp.select(*names)).count() == 0
    part = read_csv(spark, write_csv(src.drop("Age"), work_path(spark, "absent")))
    assert part.where("Age IS NOT NULL").count() == 0 and part.count() == emp.count()
    assert load_error(spark) is FileNotFoundError


def load_error(spark):
    try:
        load_model_bundle(spark, [work_path(spark, "none")])
    except Exception as e:  # noqa: BLE001 - the type is what is tested
        return type(e)


def test_one_hot_long_has_no_level_limit(spark):
    df = spark.range(1500).select(F.col("id").alias("EmployeeNumber"), F.format_string("v%04d", "id").alias("c"))
    assert one_hot_long(df, ["c"]).count() == 1499


def test_trial_draws_are_independent():
    trials = ML.draw_trials(ML.SEARCH_SPACE_V2, 200)
    for a, b in itertools.combinations(sorted(ML.SEARCH_SPACE_V2), 2):
        x, y = [t[a] for t in trials], [t[b] for t in trials]
        mx, my = sum(x) / 200, sum(y) / 200
        cov = sum((p - mx) * (q - my) for p, q in zip(x, y))
        assert abs(cov / math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y))) < 0.25


def test_gamma_is_scaled_and_folds_are_resampled_once(spark, emp, monkeypatch):
    ff = fit_features(emp, "v1")
    folds = stratified_folds(ff.transform(emp), "Attrition", "EmployeeNumber").checkpoint()
    calls = []
    monkeypatch.setattr(ML, "resample_fold", lambda tr, *a: calls.append(1) or tr)
    space = {"n_estimators": ("int", 2, 2), "max_depth": ("int", 2, 3), "gamma": ("float", 0.1, 1.0)}
    t = ML.random_search(folds, ff.feature_names, "EmployeeNumber", space, n_trials=2, k=2).collect()
    assert len(t) == 2 and len(calls) == 2
    model = ML.gbt_from_params(ff.feature_names, {"n_estimators": 2, "max_depth": 4, "gamma": 1.0}, n_rows=folds.count()).fit(folds)
    assert all(tree.numNodes > 1 for tree in model.stages[-1].trees)  # not a constant model
    with pytest.raises(ValueError):
        ML.gbt_from_params(ff.feature_names, {"gamma": 1.0})
    with pytest.raises(ValueError):
        ML.gbt_from_params(ff.feature_names, {"max_depth": 40})
    monkeypatch.undo()
    with pytest.raises(ValueError):
        ML.resample_fold(folds, ff.feature_names, "EmployeeNumber", "other")


def test_scenarios_on_a_trained_model(spark, emp):
    ff = fit_features(emp, "v1")
    model = ML.gbt_from_params(ff.feature_names, {"n_estimators": 5, "max_depth": 4}).fit(ff.transform(emp).where("Attrition IS NOT NULL"))

    def score(df):
        mat = ff.transform(df.withColumn("_emp", F.struct(*df.columns)), keep=("_emp",), with_label=False)
        return ML.positive_probability(model.transform(mat)).select("_emp.*", F.col("prob").alias("Risk"))

    batch = {r.EmployeeNumber: r.Risk for r in score(emp.drop("Risk")).collect()}
    grid = S.model_what_if_grid(emp, score, [("baseline", *[None] * 5), ("far", None, None, None, None, 29), ("poor", 1.0, None, "Yes", 1, None)]).collect()
    assert len(grid) == 3 * len(batch) and all(r.sim_prob == batch[r.EmployeeNumber] == r.current_prob for r in grid if r.scenario == "baseline")
    assert any(r.delta_pct for r in grid if r.scenario == "poor")
    roi = S.model_intervention_roi(emp, score).collect()
    assert all(r.prob_before == batch[r.EmployeeNumber] for r in roi)
    assert all(r.prob_after == r.prob_before and r.investment == 0 for r in roi if r.package == "none")


def test_chosen_pairs_lose_no_row(spark, emp):
    ids = [r[0] for r in emp.select("EmployeeNumber").limit(3).collect()]
    pairs = spark.createDataFrame([(1, ids[0], ids[2]), (2, ids[1], -5), (3, -5, ids[0])], "pair_id int, emp1 long, emp2 long")
    got = {r.pair_id: r for r in pair_compare(emp, pairs).collect()}
    assert len(got) == 3 and got[2].risk2_pct is None and got[3].cost1 is None and got[1].cost1 is not None
