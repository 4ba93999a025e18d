"""Learned operators: properties (no oracle can reproduce trained scores)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attriscope.operators import ml as ML
from attriscope.operators.explain import linear_base_value, linear_shap
from attriscope.operators.features import fit_features
from attriscope.operators.split import stratified_folds, stratified_split
from attriscope.session import work_path
from attriscope.sources.files import load_model_bundle, save_model_bundle


@pytest.fixture(scope="module")
def parts(spark, emp):
    ff = fit_features(emp, "v1")
    s = stratified_split(ff.transform(emp), "Attrition", "EmployeeNumber").checkpoint(eager=True)
    return ff, s.where("split = 'train'"), s.where("split = 'test'")


def test_forest_scores_and_importances(spark, parts):
    ff, tr, te = parts
    pipe = ML.random_forest(ff.feature_names, num_trees=20, max_depth=5)
    scored, model = ML.fit_and_score(pipe, ML.with_class_weights(tr), te)
    probs = [r["prob"] for r in scored.select("prob").collect()]
    assert probs and all(0.0 <= p <= 1.0 for p in probs)
    imp = ML.feature_importances(model, ff.feature_names).collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0)
    assert [r["rank"] for r in imp] == list(range(1, len(imp) + 1))


def test_bundle_reload_gives_equal_scores(spark, parts):
    ff, tr, te = parts
    model = ML.gbt_from_params(ff.feature_names, {"n_estimators": 5, "max_depth": 3}).fit(tr)
    path = work_path(spark, "bundle")
    save_model_bundle(model, {"feature_names": ff.feature_names, "features": ff.to_json()}, path)
    m2, manifest, p = load_model_bundle(spark, [path + "-missing", path])
    assert p == path and manifest["feature_names"] == ff.feature_names
    a = ML.positive_probability(model.transform(te)).select("EmployeeNumber", "prob").orderBy("EmployeeNumber").collect()
    b = ML.positive_probability(m2.transform(te)).select("EmployeeNumber", "prob").orderBy("EmployeeNumber").collect()
    assert a == b


def test_cross_validation_resamples_in_fold_only(spark, emp):
    ff = fit_features(emp, "v1")
    folds = stratified_folds(ff.transform(emp), "Attrition", "EmployeeNumber").checkpoint(eager=True)
    real_ids = {r[0] for r in folds.select("EmployeeNumber").collect()}
    tr = ML.resample_fold(folds.where("fold != 0"), ff.feature_names, "EmployeeNumber", "smote")
    synth = {r[0] for r in tr.select("EmployeeNumber").collect()} - real_ids
    assert synth                                   # resampling added rows ...
    va_ids = {r[0] for r in folds.where("fold = 0").select("EmployeeNumber").collect()}
    assert not (synth & va_ids)                    # ... and none is in the validation fold
    counts = {r[0]: r[1] for r in tr.groupBy("Attrition").count().collect()}
    assert counts[0] == counts[1]
    f1 = ML.cross_val_f1(folds, ff.feature_names, {"n_estimators": 3, "max_depth": 2}, "EmployeeNumber", k=2)
    assert 0.0 <= f1 <= 1.0


def test_random_search_trials(spark, emp):
    ff = fit_features(emp, "v1")
    folds = stratified_folds(ff.transform(emp), "Attrition", "EmployeeNumber")
    space = {"n_estimators": ("int", 2, 4), "max_depth": ("int", 2, 3), "learning_rate": ("log", 0.05, 0.3)}
    t = ML.random_search(folds, ff.feature_names, "EmployeeNumber", space, n_trials=2, k=2, resample="none",
                         parallelism=2).collect()
    assert len(t) == 2 and all(0 <= r["mean_f1"] <= 1 for r in t)
    assert all(0.05 <= r["learning_rate"] <= 0.3 and 2 <= r["n_estimators"] <= 4 for r in t)
    assert ML.draw_trials(space, 3) == ML.draw_trials(space, 3)


def test_linear_shap_additivity(spark, emp):
    shap = linear_shap(emp)
    base = linear_base_value(emp)
    tot = shap.groupBy("EmployeeNumber").agg(F.sum("shap").alias("s"))
    j = tot.join(emp.select("EmployeeNumber", "RiskMargin"), "EmployeeNumber").collect()
    assert j and all(abs(r["s"] + base - r["RiskMargin"]) < 1e-9 for r in j)


def test_stream_equals_batch_and_rerun_adds_nothing(spark, emp):
    from attriscope.plans.q_sources import RAW_COLUMNS
    from attriscope.sources.files import write_csv
    from attriscope.streaming.roster import score_stream

    base = work_path(spark, "test-stream")
    write_csv(emp.select(*RAW_COLUMNS).repartition(3), f"{base}/in")
    n1 = score_stream(spark, f"{base}/in", f"{base}/out", f"{base}/chk", 1)
    out = spark.read.parquet(f"{base}/out")
    assert n1 >= 2 and out.count() == emp.count()
    want = emp.select("EmployeeNumber", F.bround(F.col("Risk") * 100, 2).alias("p"))
    diff = out.join(want, "EmployeeNumber").where(F.col("p") != F.col("AttritionRiskPct")).count()
    assert diff == 0
    assert score_stream(spark, f"{base}/in", f"{base}/out", f"{base}/chk", 1) == 0
    assert spark.read.parquet(f"{base}/out").count() == emp.count()


@pytest.mark.parametrize("kind", ["gbt", "rf"])
def test_tree_shap_additivity(spark, parts, kind):
    from attriscope.operators.treeshap import margin_of, tree_shap

    ff, tr, te = parts
    if kind == "gbt":
        model = ML.gbt_from_params(ff.feature_names, {"n_estimators": 8, "max_depth": 3}).fit(tr)
    else:
        model = ML.random_forest(ff.feature_names, num_trees=8, max_depth=4).fit(ML.with_class_weights(tr))
    shap, base = tree_shap(te, model.stages[-1], ff.feature_names, "EmployeeNumber", kind)
    tot = shap.groupBy("EmployeeNumber").agg(F.sum("shap").alias("s"))
    marg = model.transform(te).select("EmployeeNumber", margin_of(model.stages[-1], kind).alias("m"))
    rows = tot.join(marg, "EmployeeNumber").collect()
    assert len(rows) == te.count()
    assert all(abs(r["s"] + base - r["m"]) < 1e-9 for r in rows)
    from attriscope.operators.treeshap import _load_trees
    from recursive_shap import tree_shap_row

    trees, weights = _load_trees(spark, model.stages[-1], kind)
    got = {}
    for r in shap.collect():
        got.setdefault(r["EmployeeNumber"], {})[r["feature"]] = (r["feature_value"], r["shap"])
    for values in list(got.values())[:12]:
        phi = [0.0] * len(ff.feature_names)
        for tree, w in zip(trees, weights):
            tree_shap_row([values[f][0] for f in ff.feature_names], tuple(a.tolist() if hasattr(a, "tolist") else a for a in tree), phi, w)
        assert all(abs(values[f][1] - p) < 1e-10 for f, p in zip(ff.feature_names, phi))


def test_leaf_values_equal_every_order_of_players():
    """Shapley values by all orders of features, on random trees with repeated features and a missing value."""
    import itertools

    import numpy as np

    from attriscope.operators.treeshap import LeafTables

    rng = np.random.default_rng(12)

    def random_tree(depth):
        nodes = []

        def grow(d, cover):
            at = len(nodes)
            nodes.append(None)
            if d == 0 or cover < 2:
                nodes[at] = (-1, 0.0, -1, -1, float(rng.normal()), cover)
                return at
            part = float(rng.uniform(0.1, 0.9))
            nodes[at] = (int(rng.integers(3)), float(rng.normal()), grow(d - 1, cover * part), grow(d - 1, cover * (1 - part)), 0.0, cover)
            return at

        grow(depth, 100.0)
        columns = list(zip(*nodes))
        return tuple(np.array(c) for c in columns[:6]) + (0,)

    def expectation(tree, x, known, at=0):
        f, thr, left, right, value, cover, _ = tree
        if left[at] < 0:
            return value[at]
        if f[at] in known:
            return expectation(tree, x, known, left[at] if x[f[at]] <= thr[at] else right[at])
        return sum(cover[c] / cover[at] * expectation(tree, x, known, c) for c in (left[at], right[at]))

    for _ in range(10):
        tree = random_tree(4)
        x = rng.normal(size=(5, 3))
        x[0, 1] = np.nan
        got = LeafTables([tree], [0.7]).values(x)
        for row, phi in zip(x, got):
            want = np.zeros(3)
            for order in itertools.permutations(range(3)):
                for k, j in enumerate(order):
                    want[j] += 0.7 * (expectation(tree, row, order[: k + 1]) - expectation(tree, row, order[:k])) / 6
            assert np.allclose(phi, want, atol=1e-12)


def test_explanation_is_written_once_for_a_model_and_its_rows(spark, parts):
    from attriscope.operators import explain as X

    ff, tr, te = parts
    model = ML.gbt_from_params(ff.feature_names, {"n_estimators": 3, "max_depth": 2}).fit(tr).stages[-1]
    folder = work_path(spark, "explanations")

    def files():
        return X.stored_explanation(te, model, ff.feature_names, "EmployeeNumber", folder=folder).inputFiles()

    first = files()
    assert files() == first                                                          # read, not written again
    other = X.stored_explanation(te.where("EmployeeNumber > 50"), model, ff.feature_names, "EmployeeNumber", folder=folder)
    assert not set(other.inputFiles()) & set(first)                                  # other rows: another table
    table = X.stored_explanation(te, model, ff.feature_names, "EmployeeNumber", folder=folder)
    assert table.count() == te.count() * len(ff.feature_names)
    pdf = table.toPandas()
    want = pdf.assign(a=pdf["shap"].abs()).groupby("feature")["a"].mean().sort_values(ascending=False)
    got = X.shap_importance(table, 3).collect()
    assert [r["mean_abs_shap"] for r in got] == pytest.approx(want.head(3).tolist())


def test_shap_by_pattern_equals_the_integral(monkeypatch):
    """Values looked up for each pattern of conditions are those integrated for each row; deep leaves still integrate."""
    from attriscope.operators import treeshap as TS

    rng = np.random.default_rng(5)

    def tree(depth):
        out = [[], [], [], [], [], []]

        def add(d, cover):
            i = len(out[0])
            for column, v in zip(out, (-1, 0.0, -1, -1, float(rng.normal()), cover)):
                column.append(v)
            if d:
                share = cover * float(rng.uniform(0.1, 0.9))
                out[0][i], out[1][i] = int(rng.integers(12)), float(rng.normal())
                out[2][i], out[3][i] = add(d - 1, share), add(d - 1, cover - share)
            return i

        add(depth, 100.0)
        return (*map(np.array, out), 0)

    trees = [tree(4) for _ in range(5)] + [tree(9)]
    x = rng.normal(size=(70, 12))
    x[rng.random(x.shape) < 0.1] = np.nan
    tables = TS.LeafTables(trees, [0.5] * 6)
    assert all(t[-1] is not None for t in tables.tables if t[1].shape[1] <= 4)
    monkeypatch.setattr(TS, "CELLS", 300)
    plain = TS.LeafTables(trees, [0.5] * 6)
    assert any(t[-1] is None for t in plain.tables)
    assert np.allclose(tables.values(x), plain.values(x), rtol=0, atol=1e-12)


def test_training_rows_of_a_task_are_bounded(spark):
    """More rows make more tasks, not larger ones; a small table still has one partition for each core."""
    rows, cores = spark.range(0, 10_000, 1, 1), spark.sparkContext.defaultParallelism
    assert ML.training_frame(rows).rdd.getNumPartitions() == cores
    parts = ML.training_frame(rows, task_rows=100).rdd.glom().map(len).collect()
    assert len(parts) == max(cores, 100) and sum(parts) == 10_000 and max(parts) <= 150


def test_rows_to_score_are_dealt_to_all_cores(spark):
    """One large file or a joined table in few parts leaves no core idle, and no task unpacks the model twice on a core."""
    cores = spark.sparkContext.defaultParallelism
    for have in (1, 5 * cores):
        parts = ML.scoring_frame(spark.range(0, 10_000, 1, have)).rdd.glom().map(len).collect()
        assert len(parts) == cores and sum(parts) == 10_000 and max(parts) <= 2 * 10_000 / cores
