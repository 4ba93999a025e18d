"""Metrics, models and explanations."""

from pyspark.sql import functions as F

from attriscope.functions.scorer import LINEAR_TERMS
from attriscope.operators import explain as X
from attriscope.operators import metrics as M
from attriscope.operators import ml as ML
from attriscope.operators import search as S
from attriscope.operators.common import round_cols
from attriscope.operators.features import align_features, drop_for_scoring, seeded_sample
from attriscope.operators.scoring import score_roster
from attriscope.operators.treeshap import tree_shap
from attriscope.operators.split import stratified_folds, stratified_split
from attriscope.plans.base import fitted_features, query, with_v
from attriscope.session import scratch, work_path
from attriscope.sources import bundles as B
from attriscope.sources.tables import employees as E
from attriscope.sources.tables import load, stored_employees

_PRED = "CASE WHEN quality = 0 THEN 1 ELSE 0 END"


def _labels(spark, sf):
    return load(spark, sf, "labels").withColumn("pred", (F.col("quality") == 0).cast("int"))


_COUNTS = f"""c AS (SELECT CAST(SUM(CASE WHEN toxic = 1 AND {_PRED} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       CAST(SUM(CASE WHEN toxic = 0 AND {_PRED} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(SUM(CASE WHEN toxic = 1 AND {_PRED} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(SUM(CASE WHEN toxic = 0 AND {_PRED} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM labels)"""


def _div(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN 0E0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


@query("binary_metrics", f"""WITH {_COUNTS}
SELECT tp, fp, fn, tn, ROUND({_div('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy,
       ROUND({_div('tp', 'tp + fp')}, 6) AS precision, ROUND({_div('tp', 'tp + fn')}, 6) AS recall,
       ROUND({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM c""")
def q_binary_metrics(spark, sf):
    return round_cols(M.binary_metrics(_labels(spark, sf), "toxic", "pred"),
                      {"accuracy": 6, "precision": 6, "recall": 6, "f1": 6})


@query("confusion_matrix", f"""WITH {_COUNTS}
SELECT 0 AS actual, 0 AS predicted, tn AS n FROM c UNION ALL SELECT 0, 1, fp FROM c
UNION ALL SELECT 1, 0, fn FROM c UNION ALL SELECT 1, 1, tp FROM c""")
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(_labels(spark, sf), "toxic", "pred")


@query("classification_report", f"""WITH {_COUNTS},
s AS (SELECT {_div('tn', 'tn + fn')} AS p0, {_div('tn', 'tn + fp')} AS r0, {_div('2 * tn', '2 * tn + fn + fp')} AS f0,
             tn + fp AS s0, {_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1,
             {_div('2 * tp', '2 * tp + fp + fn')} AS f1, tp + fn AS s1, tp + fp + fn + tn AS n,
             {_div('tp + tn', 'tp + fp + fn + tn')} AS acc FROM c)
SELECT class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, support FROM (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM s
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM s
  UNION ALL SELECT 'accuracy', NULL, NULL, acc, n FROM s
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM s
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM s)""")
def q_classification_report(spark, sf):
    return round_cols(M.classification_report(_labels(spark, sf), "toxic", "pred"),
                      {"precision": 6, "recall": 6, "f1": 6})


@query("model_comparison", f"""WITH {_COUNTS},
m AS (SELECT {_div('tp', 'tp + fn')} AS recall, {_div('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c)
SELECT 'recall' AS metric, {M.BASELINE_RECALL!r}E0 AS baseline, ROUND(recall, 6) AS new, ROUND(recall - {M.BASELINE_RECALL!r}E0, 6) AS change FROM m
UNION ALL SELECT 'f1', {M.BASELINE_F1!r}E0, ROUND(f1, 6), ROUND(f1 - {M.BASELINE_F1!r}E0, 6) FROM m""")
def q_model_comparison(spark, sf):
    return round_cols(M.model_comparison(_labels(spark, sf), "toxic", "pred"), {"new": 6, "change": 6})


_CACHE: dict = {}


def _train_test(spark, sf, version="v1"):
    """Fitted features + stratified split, once per session and scale factor (checkpointed)."""
    key = (spark.sparkContext.applicationId, sf, "split", version)
    if key not in _CACHE:
        emp = stored_employees(spark, sf)
        ff = fitted_features(spark, sf, version)
        sp = stratified_split(ff.transform(emp), "Attrition", "EmployeeNumber").checkpoint(eager=True)
        _CACHE[key] = (ff, sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test"))
    return _CACHE[key]


def _forest(spark, sf):
    """The class-weighted forest, trained once per session (score once, many reports)."""
    key = (spark.sparkContext.applicationId, sf, "forest")
    if key not in _CACHE:
        ff, tr, te = _train_test(spark, sf)
        model = ML.random_forest(ff.feature_names).fit(ML.training_frame(ML.with_class_weights(tr)))
        _CACHE[key] = model
    return _CACHE[key]


# The boosted-tree library's documented defaults (used when no search has run).
DEFAULT_GBT = {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3, "subsample": 1.0,
               "colsample_bytree": 1.0, "min_child_weight": 1, "gamma": 0.0}


def _gbt(spark, sf):
    """Boosted trees on SMOTE-Tomek-resampled v2 training rows, trained once per session."""
    key = (spark.sparkContext.applicationId, sf, "gbt")
    if key not in _CACHE:
        ff, tr, te = _train_test(spark, sf, "v2")
        with scratch(spark):  # the k-NN tables are many times the rows that are kept
            rs = ML.resample_fold(tr, ff.feature_names, "EmployeeNumber", "smote_tomek").checkpoint(eager=True)
        _CACHE[key] = ML.gbt_from_params(ff.feature_names, DEFAULT_GBT).fit(ML.training_frame(rs))
    return _CACHE[key]


@query("forest_scores")
def q_forest_scores(spark, sf):
    """Class-weighted random forest on the v1 matrix: hold-out probabilities."""
    ff, tr, te = _train_test(spark, sf)
    scored = ML.positive_probability(_forest(spark, sf).transform(ML.scoring_frame(te)))
    return scored.select("EmployeeNumber", "Attrition", "prob", F.col("prediction").cast("int").alias("prediction"))


@query("forest_importance")
def q_forest_importance(spark, sf):
    ff, tr, _ = _train_test(spark, sf)
    return ML.feature_importances(_forest(spark, sf), ff.feature_names)


@query("gbt_importance")
def q_gbt_importance(spark, sf):
    """Ranked importances of the boosted trees."""
    ff, _, _ = _train_test(spark, sf, "v2")
    return ML.feature_importances(_gbt(spark, sf), ff.feature_names)


@query("scoring_columns", with_v("SELECT * EXCLUDE (EmployeeCount, Over18, StandardHours, Attrition, RiskMargin, Risk) FROM v"))
def q_scoring_columns(spark, sf):
    """The roster as it is scored: the fixed non-feature columns dropped, absent ones ignored."""
    return drop_for_scoring(E(spark, sf).drop("RiskMargin", "Risk", "Over18"))


@query("gbt_scores")
def q_gbt_scores(spark, sf):
    """Boosted trees on the SMOTE-Tomek-resampled v2 training rows: hold-out probabilities."""
    ff, tr, te = _train_test(spark, sf, "v2")
    scored = ML.positive_probability(_gbt(spark, sf).transform(te))
    return scored.select("EmployeeNumber", "Attrition", "prob", F.col("prediction").cast("int").alias("prediction"))


@query("model_metrics")
def q_model_metrics(spark, sf):
    """Hold-out accuracy / precision / recall / F1 of the class-weighted forest."""
    ff, tr, te = _train_test(spark, sf)
    scored = _forest(spark, sf).transform(ML.scoring_frame(te))
    return M.binary_metrics(scored.withColumn("pred", F.col("prediction").cast("int")), "Attrition", "pred")


@query("model_scores")
def q_model_scores(spark, sf):
    """Batch scoring of every employee with the trained forest (fitted features, aligned, probability)."""
    ff, _, _ = _train_test(spark, sf)
    emp = ML.scoring_frame(drop_for_scoring(E(spark, sf)))   # raw roster columns that are never features
    mat = align_features(ff.transform(emp, with_label=False), ff.feature_names, keep=("EmployeeNumber",))
    scored = ML.positive_probability(_forest(spark, sf).transform(mat))
    return scored.select("EmployeeNumber", F.bround(F.col("prob") * F.lit(100.0), 2).alias("AttritionRiskPct"))


def _published(spark, sf):
    """The trained forest published as a bundle version (once for each session and tables); scoring reads it back."""
    key = (spark.sparkContext.applicationId, sf, "bundle")
    if key not in _CACHE:
        ff, _, _ = _train_test(spark, sf)
        root = work_path(spark, "bundles")
        B.publish(spark, root, _forest(spark, sf), {"features": ff.to_json(), "feature_names": ff.feature_names})
        _CACHE[key] = root
    return _CACHE[key]


@query("bundle_scores")
def q_bundle_scores(spark, sf):
    """Every employee scored by the newest whole version of the published model."""
    display, _ = score_roster(ML.scoring_frame(E(spark, sf).drop("Risk", "RiskMargin")), B.bundle_scorer(B.newest(spark, _published(spark, sf))))
    return display


@query("bundle_versions")
def q_bundle_versions(spark, sf):
    """Files of the newest version with their lengths, and whether their digests are those of the published list."""
    bundle = B.newest(spark, _published(spark, sf))
    kept = spark.read.parquet(f"{bundle.path}/files")
    found = B.file_list(spark, f"{bundle.path}/model").withColumnRenamed("sha256", "now")
    return kept.join(found, ["path", "length"], "left").select("path", "length", F.col("now").eqNullSafe(F.col("sha256")).alias("whole"))


@query("model_department_profile")
def q_model_department_profile(spark, sf):
    """The flagship report on learned scores: every employee scored by the forest, then profiled."""
    from attriscope.operators.risk import department_profile

    ff, _, _ = _train_test(spark, sf)
    emp = ML.scoring_frame(E(spark, sf).drop("Risk"))
    # the employee row travels through the model in a struct: no join of the table with its own scores
    mat = ff.transform(emp.withColumn("_emp", F.struct(*emp.columns)), keep=("_emp",))
    scored = ML.positive_probability(_forest(spark, sf).transform(mat))
    return department_profile(scored.select("_emp.*", F.col("prob").alias("Risk")))


def _forest_scorer(spark, sf):
    """The trained forest as a scorer: rows with inputs in, the same rows with Risk out (no join)."""
    ff, _, _ = _train_test(spark, sf)
    model = _forest(spark, sf)

    def score(df):
        mat = ff.transform(df.withColumn("_emp", F.struct(*df.columns)), keep=("_emp",), with_label=False)
        return ML.positive_probability(model.transform(mat)).select("_emp.*", F.col("prob").alias("Risk"))

    return score


# Fixed scenarios that use all five overrides.
MODEL_SCENARIOS = [
    ("baseline", None, None, None, None, None),
    ("other_role", None, "Manager", None, None, None),
    ("far_away", None, None, None, None, 29),
    ("all", 10000.0, "Manager", "No", 4, 1),
]


@query("model_what_if_grid")
def q_model_what_if_grid(spark, sf):
    """What-if scenarios rescored by the trained forest."""
    from attriscope.operators.scenario import model_what_if_grid

    return model_what_if_grid(ML.scoring_frame(E(spark, sf)), _forest_scorer(spark, sf), MODEL_SCENARIOS)


@query("model_intervention_roi")
def q_model_intervention_roi(spark, sf):
    """Intervention packages rescored by the trained forest."""
    from attriscope.operators.scenario import model_intervention_roi

    return model_intervention_roi(ML.scoring_frame(E(spark, sf)), _forest_scorer(spark, sf))


_FIXED = ("0.3E0 + 0.2E0 * (CASE WHEN OverTime = 'Yes' THEN 1E0 ELSE 0E0 END) + 0.1E0 * (CASE WHEN JobRole = 'Manager' THEN 1E0 ELSE 0E0 END) "
          "+ 0.01E0 * DistanceFromHome - 0.05E0 * JobSatisfaction - 0.00001E0 * MonthlyIncome")


@query("what_if_all_overrides", with_v(f"""
SELECT EmployeeNumber, scenario, {_FIXED} AS sim_prob
FROM (SELECT v.EmployeeNumber, s.scenario, COALESCE(s_i, MonthlyIncome) AS MonthlyIncome, COALESCE(s_r, JobRole) AS JobRole,
             COALESCE(s_o, OverTime) AS OverTime, COALESCE(s_s, JobSatisfaction) AS JobSatisfaction, COALESCE(s_d, DistanceFromHome) AS DistanceFromHome
      FROM v, (VALUES ('baseline', NULL::DOUBLE, NULL::VARCHAR, NULL::VARCHAR, NULL::INT, NULL::INT), ('other_role', NULL, 'Manager', NULL, NULL, NULL),
               ('far_away', NULL, NULL, NULL, NULL, 29), ('all', 10000.0, 'Manager', 'No', 4, 1)) s(scenario, s_i, s_r, s_o, s_s, s_d))"""))
def q_what_if_all_overrides(spark, sf):
    """All five overrides reach a scorer with fixed coefficients."""
    from attriscope.operators.scenario import model_what_if_grid

    out = model_what_if_grid(E(spark, sf), lambda df: df.withColumn("Risk", F.expr(_FIXED)), MODEL_SCENARIOS)
    return out.select("EmployeeNumber", "scenario", "sim_prob")  # unrounded: the doubles are equal


@query("tree_shap")
def q_tree_shap(spark, sf):
    """TreeSHAP of the boosted trees (margin space) over a seeded 100-row sample of the whole matrix."""
    ff, tr, te = _train_test(spark, sf, "v2")
    sample = seeded_sample(tr.unionByName(te), 100).repartition(8, "EmployeeNumber")
    shap, base = tree_shap(sample, _gbt(spark, sf).stages[-1], ff.feature_names, "EmployeeNumber", "gbt")
    return shap.withColumn("base_value", F.lit(base))


# A small space and few folds keep the registered search a report, not a training job; the library's spaces are larger.
REPORT_SPACE = {"n_estimators": ("int", 3, 8), "max_depth": ("int", 2, 4), "learning_rate": ("log", 0.05, 0.3)}
REPORT_TRIALS, REPORT_FOLDS = 2, 3


def _trials(spark, sf):
    """Out-of-fold predictions of the report's search (in the trial store; trained once for the same rows)."""
    key = (spark.sparkContext.applicationId, sf, "trials")
    if key not in _CACHE:
        ff = fitted_features(spark, sf, "v2")
        folds = stratified_folds(ff.transform(E(spark, sf)), "Attrition", "EmployeeNumber", k=REPORT_FOLDS)
        folds = folds.select("EmployeeNumber", "Attrition", "fold", *[F.col(f"`{c}`") for c in ff.feature_names])
        _CACHE[key] = S.search(folds, ff.feature_names, "EmployeeNumber", REPORT_SPACE, REPORT_TRIALS, REPORT_FOLDS, "smote", parallelism=2)
    return _CACHE[key]


def _draw_sql(space, trials):
    rows = ", ".join(f"('{p}', '{k}', CAST({lo!r} AS DOUBLE), CAST({hi!r} AS DOUBLE))" for p, (k, lo, hi) in sorted(space.items()))
    return f"""WITH p(param, kind, lo, hi) AS (VALUES {rows}),
d AS (SELECT CAST(t AS INT) AS trial, param, kind, lo, hi, md5('42:' || t || ':' || param) AS h FROM p, range({trials}) r(t)),
x AS (SELECT *, list_sum(list_transform(range(8), lambda i: CAST(strpos('0123456789abcdef', substr(h, CAST(i + 1 AS INT), 1)) - 1 AS DOUBLE) * power(16, 7 - i))) / 4294967296E0 AS u FROM d)
SELECT trial, param, kind, ROUND(u, 6) AS u, ROUND(CASE kind WHEN 'int' THEN floor(lo + u * (hi - lo + 1)) WHEN 'log' THEN exp(ln(lo) + u * (ln(hi) - ln(lo))) ELSE lo + u * (hi - lo) END, 6) AS value FROM x"""


@query("search_draws", _draw_sql(ML.SEARCH_SPACE_V2, 20))
def q_search_draws(spark, sf):
    """The parameter table of the 20-trial search (the same draws in any engine)."""
    return round_cols(S.draws(spark, ML.SEARCH_SPACE_V2, 20), {"u": 6, "value": 6})


@query("search_trials")
def q_search_trials(spark, sf):
    """Mean F1 of each trial from its stored out-of-fold predictions, the best one marked."""
    return S.trial_table(_trials(spark, sf))


@query("cv_folds_metrics")
def q_cv_folds_metrics(spark, sf):
    """Counts and metrics of every trial and fold, one grouped aggregate over the stored out-of-fold predictions."""
    return S.grouped_metrics(_trials(spark, sf), ["trial", "fold"])


@query("trained_model_comparison")
def q_trained_model_comparison(spark, sf):
    """The earlier model's published recall and F1 beside those of the trained boosted trees on the hold-out."""
    _, _, te = _train_test(spark, sf, "v2")
    scored = _gbt(spark, sf).transform(te).withColumn("pred", F.col("prediction").cast("int"))
    return M.model_comparison(scored, "Attrition", "pred")


def _explained(spark, sf):
    """SHAP of the boosted trees for every employee, written once and shared by the reports below."""
    key = (spark.sparkContext.applicationId, sf, "explained")
    if key not in _CACHE:
        ff, tr, te = _train_test(spark, sf, "v2")
        _CACHE[key] = X.stored_explanation(tr.unionByName(te), _gbt(spark, sf).stages[-1], ff.feature_names, "EmployeeNumber", "gbt")
    return _CACHE[key]


@query("tree_shap_importance")
def q_tree_shap_importance(spark, sf):
    """Mean |SHAP| of the trained boosted trees over all employees, the ten largest."""
    return X.shap_importance(_explained(spark, sf), 10)


@query("tree_shap_summary")
def q_tree_shap_summary(spark, sf):
    """Every employee's point for the fifteen most important features of the trained model."""
    return X.shap_summary(_explained(spark, sf), 15)


@query("tree_glossary")
def q_tree_glossary(spark, sf):
    """The trained model's ranking with plain words for each feature."""
    return X.feature_glossary(X.shap_importance(_explained(spark, sf), 10))


_X = ("x AS (SELECT EmployeeNumber, CASE WHEN OverTime = 'Yes' THEN 1E0 ELSE 0E0 END AS OverTime_Yes, "
      "CAST(MonthlyIncome AS DOUBLE) AS MonthlyIncome, CAST(JobSatisfaction AS DOUBLE) AS JobSatisfaction, "
      "CAST(WorkLifeBalance AS DOUBLE) AS WorkLifeBalance, CAST(Age AS DOUBLE) AS Age FROM v)")
_M = "m AS (SELECT " + ", ".join(f"AVG({f}) AS m_{f}" for f in LINEAR_TERMS) + " FROM x)"
_SHAP = "s AS (" + "\nUNION ALL ".join(
    f"SELECT EmployeeNumber, '{f}' AS feature, {f} AS feature_value, CAST('{w!r}' AS DOUBLE) * ({f} - m_{f}) AS shap FROM x, m"
    for f, w in LINEAR_TERMS.items()) + ")"


def _shap(spark, sf):
    return X.linear_shap(E(spark, sf))


@query("linear_shap", with_v("SELECT EmployeeNumber, feature, feature_value, ROUND(shap, 6) AS shap FROM s", _X, _M, _SHAP))
def q_linear_shap(spark, sf):
    return round_cols(_shap(spark, sf), {"shap": 6})


@query("shap_importance", with_v("""
SELECT feature, ROUND(AVG(ABS(shap)), 6) AS mean_abs_shap FROM s GROUP BY feature
ORDER BY AVG(ABS(shap)) DESC, feature LIMIT 10""", _X, _M, _SHAP))
def q_shap_importance(spark, sf):
    return round_cols(X.shap_importance(_shap(spark, sf), 10), {"mean_abs_shap": 6})


@query("shap_summary", with_v("""
SELECT s.EmployeeNumber, s.feature, s.feature_value, ROUND(s.shap, 6) AS shap,
       ROUND(CASE WHEN r.hi > r.lo THEN (s.feature_value - r.lo) / (r.hi - r.lo) ELSE 0.5E0 END, 6) AS value_scaled
FROM s JOIN (SELECT feature, MIN(feature_value) AS lo, MAX(feature_value) AS hi FROM s GROUP BY feature) r
  ON s.feature = r.feature
WHERE s.feature IN (SELECT feature FROM s GROUP BY feature ORDER BY AVG(ABS(shap)) DESC, feature LIMIT 15)""",
    _X, _M, _SHAP))
def q_shap_summary(spark, sf):
    return round_cols(X.shap_summary(_shap(spark, sf), 15), {"shap": 6, "value_scaled": 6})


def _q(s):
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


_GLOSSARY_VALUES = ", ".join(f"({_q(k)}, {_q(a)}, {_q(b)}, {_q(c)})" for k, (a, b, c) in X.GLOSSARY.items())


@query("feature_glossary", with_v(f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY i.m DESC, i.feature) AS INT) AS rank, i.feature, ROUND(i.m, 6) AS mean_abs_shap,
       COALESCE(g.label, i.feature) AS label, COALESCE(g.description, {_q(X.DEFAULT_DESCRIPTION)}) AS description, g.action,
       CASE WHEN g.label IS NULL THEN NULL WHEN i.m > 0.05E0 THEN 'strong' WHEN i.m > 0.02E0 THEN 'medium' ELSE 'light' END AS effect
FROM (SELECT feature, AVG(ABS(shap)) AS m FROM s GROUP BY feature ORDER BY m DESC, feature LIMIT 10) i
LEFT JOIN (VALUES {_GLOSSARY_VALUES}) g(feature, label, description, action) ON g.feature = i.feature""",
    _X, _M, _SHAP))
def q_feature_glossary(spark, sf):
    imp = X.shap_importance(_shap(spark, sf), 10)
    return round_cols(X.feature_glossary(imp), {"mean_abs_shap": 6})
