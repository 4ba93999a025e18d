"""Models on pyspark.ml: class-weighted forest, boosted trees, in-fold resampled CV, random search.

* Random forest: 200 trees, depth 15, leaf >= 2, class weights ``n / (2 n_c)``
  through ``weightCol`` (Spark has no separate minimum-split parameter).
* Boosted trees: ``GBTClassifier`` with the mapped parameters of the search
  space (n_estimators -> maxIter, max_depth -> maxDepth, learning_rate ->
  stepSize, subsample -> subsamplingRate, colsample_bytree ~
  featureSubsetStrategy (per node), min_child_weight ~ minInstancesPerNode,
  gamma ~ minInfoGain times the number of training rows: a loss sum there, a gain a row here).  Scores therefore differ from the reference's library;
  tests check properties.
* Cross-validation resamples inside each training fold only (SMOTE / SMOTE-Tomek
  on the fold's training rows), which a Pipeline stage cannot do because stages
  also run at prediction time.
* The search draws a seeded random trial table (uniform, integer and
  log-uniform parameters) and keeps the best mean F1; the sequential (TPE)
  sampler of the reference is not rebuilt.  Trials can run concurrently from a
  thread pool (each trial's jobs are distributed).
"""

from __future__ import annotations

import hashlib
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attriscope.operators.metrics import binary_metrics

LABEL = "Attrition"

# Search spaces (fixed values): name -> (kind, low, high)
SEARCH_SPACE_V1 = {
    "n_estimators": ("int", 100, 1000), "max_depth": ("int", 3, 10), "learning_rate": ("log", 0.01, 0.3),
    "subsample": ("float", 0.5, 1.0), "colsample_bytree": ("float", 0.5, 1.0),
    "min_child_weight": ("int", 1, 10), "gamma": ("float", 0.0, 5.0),
}
SEARCH_SPACE_V2 = {
    "n_estimators": ("int", 200, 1200), "max_depth": ("int", 3, 12), "learning_rate": ("log", 0.005, 0.2),
    "subsample": ("float", 0.5, 1.0), "colsample_bytree": ("float", 0.5, 1.0),
    "min_child_weight": ("int", 1, 15), "gamma": ("float", 0.0, 10.0),
}


def with_class_weights(df: DataFrame, label: str = LABEL, weight_col: str = "weight") -> DataFrame:
    """Balanced weights n / (2 * n_class) (a one-row-per-class table joined back)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_nc"))
    n = df.count()
    w = counts.withColumn(weight_col, F.lit(float(n)) / (F.lit(2.0) * F.col("_nc"))).drop("_nc")
    return df.join(F.broadcast(w), label)


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def random_forest(features: list[str], label: str = LABEL, seed: int = 42, num_trees: int = 200,
                  max_depth: int = 15, min_leaf: int = 2) -> Pipeline:
    return Pipeline(stages=[assembler(features), vector_forest(label, seed, num_trees, max_depth, min_leaf)])


def vector_forest(label: str = LABEL, seed: int = 42, num_trees: int = 200, max_depth: int = 15, min_leaf: int = 2) -> RandomForestClassifier:
    """The forest on a ``features`` vector column, dense or sparse."""
    # node-id caching and a larger per-iteration node budget cut the passes a deep forest needs
    return RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", numTrees=num_trees,
                                  maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=seed,
                                  cacheNodeIds=True, maxMemoryInMB=1024)


def gbt_from_params(features: list[str], params: dict, label: str = LABEL, seed: int = 42, n_rows: int | None = None) -> Pipeline:
    """``n_rows``, the number of training rows, scales gamma and is needed when gamma is not 0."""
    frac, gamma, depth = params.get("colsample_bytree", 1.0), float(params.get("gamma", 0.0)), int(params.get("max_depth", 6))
    if gamma and not n_rows:
        raise ValueError("gamma needs n_rows")
    if depth > 30:
        raise ValueError("max_depth is at most 30")
    gbt = GBTClassifier(
        featuresCol="features", labelCol=label, seed=seed,
        maxIter=int(params.get("n_estimators", 100)), maxDepth=depth,
        stepSize=float(params.get("learning_rate", 0.1)), subsamplingRate=float(params.get("subsample", 1.0)),
        featureSubsetStrategy="all" if frac >= 1.0 else f"{frac:.6f}",
        minInstancesPerNode=int(params.get("min_child_weight", 1)), minInfoGain=gamma / n_rows if gamma else 0.0,
        maxMemoryInMB=1024)
    return Pipeline(stages=[assembler(features), gbt])


def positive_probability(scored: DataFrame, col: str = "prob") -> DataFrame:
    return scored.withColumn(col, vector_to_array(F.col("probability"))[1])


TASK_ROWS = 150_000  # training rows of a partition: a forest keeps a draw count and a node for each tree beside each row


def training_frame(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Spread a training set over the cluster's cores, and over more tasks where one would read more than ``task_rows`` rows."""
    want = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / task_rows))
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def scoring_frame(df: DataFrame) -> DataFrame:
    """Deal rows to one task for each core before trees score them: that costs far more than reading, whose bytes set the parts of ``df``.

    Not more tasks: each unpacks the whole model.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def fit_and_score(pipeline: Pipeline, train: DataFrame, test: DataFrame) -> DataFrame:
    model = pipeline.fit(training_frame(train))
    return positive_probability(model.transform(test)), model


def draw_trials(space: dict, n_trials: int, seed: int = 42) -> list[dict]:
    """Seeded trial table: integer, uniform and log-uniform draws, each from its own hash of (seed, trial, name)."""
    trials = []
    for t in range(n_trials):
        p = {}
        for name, (kind, lo, hi) in sorted(space.items()):
            u = int(hashlib.md5(f"{seed}:{t}:{name}".encode()).hexdigest()[:8], 16) / 4294967296.0
            if kind == "int":
                p[name] = int(lo + math.floor(u * (hi - lo + 1)))
            elif kind == "log":
                p[name] = math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo)))
            else:
                p[name] = lo + u * (hi - lo)
        trials.append(p)
    return trials


def _vector_points(df: DataFrame, features: list[str], id_col: str) -> DataFrame:
    return df.select(id_col, LABEL, F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("vec"))


def resample_fold(train: DataFrame, features: list[str], id_col: str, method: str = "smote") -> DataFrame:
    """In-fold resampling of the training rows (SMOTE or SMOTE-Tomek on the feature vectors)."""
    from attriscope.operators.resample import smote_resample, smote_tomek

    pts = _vector_points(train, features, id_col)
    if method == "smote":
        res = smote_resample(pts, LABEL, 1, 5, id_col=id_col, vec_col="vec")
    elif method == "smote_tomek":
        res = smote_tomek(pts, LABEL, 1, 5, id_col=id_col, vec_col="vec")
    elif method == "none":
        return train
    else:
        raise ValueError(f"unknown resampling method {method}")
    cols = [F.col("vec")[i].alias(c) for i, c in enumerate(features)]
    return res.select(id_col, F.col(LABEL).cast("int").alias(LABEL), *cols)


def cross_val_f1(folds: DataFrame, features: list[str], params: dict, id_col: str, k: int = 5,
                 resample: str = "smote", seed: int = 42) -> float:
    """Mean F1 over k folds; resampling sees only each fold's training rows."""
    return _mean_f1(fold_sets(folds, features, id_col, k, resample), features, params, seed)


def fold_sets(folds: DataFrame, features: list[str], id_col: str, k: int = 5, resample: str = "smote") -> list[tuple]:
    """(resampled training rows, their number, validation rows) of each fold, checkpointed: made once, used by all trials."""
    out = []
    for f in range(k):
        tr = resample_fold(folds.where(F.col("fold") != f), features, id_col, resample).checkpoint(eager=True)
        out.append((tr, tr.count(), folds.where(F.col("fold") == f)))
    return out


def cv_fold_metrics(sets: list[tuple], features: list[str], params: dict, seed: int = 42) -> list:
    """The binary metrics of each fold's model on its validation rows."""
    rows = []
    for tr, n, va in sets:
        scored, _ = fit_and_score(gbt_from_params(features, params, seed=seed, n_rows=n), tr, va)
        rows.append(binary_metrics(scored, LABEL, "prediction").first())
    return rows


def _mean_f1(sets: list[tuple], features: list[str], params: dict, seed: int) -> float:
    scores = [m["f1"] for m in cv_fold_metrics(sets, features, params, seed)]
    return sum(scores) / len(scores)


def random_search(folds: DataFrame, features: list[str], id_col: str, space: dict = SEARCH_SPACE_V2,
                  n_trials: int = 20, k: int = 5, resample: str = "smote_tomek", seed: int = 42,
                  parallelism: int = 1) -> DataFrame:
    """Trial table with mean CV F1 per trial; the best trial is the row with the highest F1."""
    trials = draw_trials(space, n_trials, seed)
    sets = fold_sets(folds.checkpoint(eager=True), features, id_col, k, resample)

    def run(t):
        return _mean_f1(sets, features, trials[t], seed)

    if parallelism > 1:
        with ThreadPoolExecutor(parallelism) as ex:
            f1s = list(ex.map(run, range(n_trials)))
    else:
        f1s = [run(t) for t in range(n_trials)]
    spark = folds.sparkSession
    names = sorted(space)
    rows = [(t, f1s[t], *[float(trials[t][n]) for n in names]) for t in range(n_trials)]
    schema = "trial int, mean_f1 double, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema)


def feature_importances(model, features: list[str]) -> DataFrame:
    """Impurity importances of the fitted tree stage joined to the manifest names, ranked."""
    from pyspark.sql import SparkSession

    tree = model.stages[-1]
    imp = tree.featureImportances.toArray()
    spark = SparkSession.getActiveSession()
    rows = sorted(((features[i], float(imp[i])) for i in range(len(features))), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(i + 1, f, v) for i, (f, v) in enumerate(rows)], "rank int, feature string, importance double")
