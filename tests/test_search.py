"""Search: draws, out-of-fold frame, grouped metrics, a killed search that goes on."""

import pytest
from pyspark.sql import functions as F

from attriscope.operators import ml as ML
from attriscope.operators import search as S
from attriscope.operators.features import fit_features
from attriscope.operators.metrics import binary_metrics
from attriscope.operators.split import stratified_folds
from attriscope.session import work_path

SPACE = {"n_estimators": ("int", 2, 3), "max_depth": ("int", 2, 3), "learning_rate": ("log", 0.05, 0.3)}


@pytest.fixture(scope="module")
def folds(spark, emp):
    ff = fit_features(emp, "v1")
    f = stratified_folds(ff.transform(emp), "Attrition", "EmployeeNumber", k=2)
    return ff, f.select("EmployeeNumber", "Attrition", "fold", *[F.col(f"`{c}`") for c in ff.feature_names]).checkpoint()


def test_draws_equal_the_trial_list(spark):
    for space in (ML.SEARCH_SPACE_V1, ML.SEARCH_SPACE_V2):
        table, listed = S.trial_parameters(spark, space, 20), ML.draw_trials(space, 20)
        for a, b in zip(table, listed):
            assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a)
    assert S.draws(spark, SPACE, 0).count() == 0


def test_a_killed_search_goes_on_where_it_was(spark, folds):
    ff, rows = folds
    store, trained = S.TrialStore(spark, work_path(spark, "trials")), []

    def killed(t):
        if t == 1:
            raise KeyboardInterrupt
        trained.append(t)

    with pytest.raises(KeyboardInterrupt):
        S.search(rows, ff.feature_names, "EmployeeNumber", SPACE, 3, 2, "none", store=store, on_trial=killed)
    key = S.search_key(rows, ff.feature_names, SPACE, 2, "none")
    assert trained == [0] and [store.has(key, 42, t) for t in range(3)] == [True, False, False]
    found = S.search(rows, ff.feature_names, "EmployeeNumber", SPACE, 3, 2, "none", store=store, on_trial=trained.append, parallelism=2)
    assert trained[0] == 0 and sorted(trained[1:]) == [1, 2]
    again = S.search(rows, ff.feature_names, "EmployeeNumber", SPACE, 3, 2, "none", store=store, on_trial=trained.append)
    assert len(trained) == 3 and again.count() == found.count() == 3 * rows.count()
    assert S.search_key(rows.where("EmployeeNumber > 3"), ff.feature_names, SPACE, 2, "none") != key

    # every row is predicted once for each trial, in its own fold
    assert found.groupBy("trial", "EmployeeNumber").count().where("count <> 1").count() == 0
    assert found.join(rows.select("EmployeeNumber", F.col("fold").alias("own")), "EmployeeNumber").where("fold <> own").count() == 0
    # grouped metrics equal those of each group alone
    grouped = {(r["trial"], r["fold"]): r for r in S.grouped_metrics(found, ["trial", "fold"]).collect()}
    assert len(grouped) == 6
    for (t, f), r in grouped.items():
        one = binary_metrics(found.where((F.col("trial") == t) & (F.col("fold") == f)), "label", "prediction").first()
        assert all(r[c] == one[c] for c in ("tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1"))
    trials = S.trial_table(found).collect()
    best = [r for r in trials if r["best"]]
    assert len(trials) == 3 and len(best) == 1 and best[0]["mean_f1"] == max(r["mean_f1"] for r in trials)
    assert S.best_parameters(S.trial_table(found)) == S.trial_parameters(spark, SPACE, 3)[best[0]["trial"]]
