"""Resumable hyper-parameter search and out-of-fold prediction tables.

* **Draws** are a table: one row for each (trial, parameter), from an MD5 of (seed, trial, parameter), so the same
  numbers come out of any engine and of a restarted driver.
* **Out-of-fold frame.**  The k models of a trial each predict their own validation fold; all predictions are
  one long table (fold, id, label, prob, prediction).  Metrics of every fold are one grouped aggregate over it.
* **Trial store.**  A finished trial is a folder of the store, keyed by a digest of the search (space, folds, rows,
  features, resampling) and by seed and trial: its out-of-fold predictions and its parameters.  The folder counts
  only with Spark's commit marker, so a killed driver leaves nothing half-true; the next run trains only the trials that
  are not there.
* **Concurrency.**  Trials run from threads, each in a scheduler pool of its own; with ``spark.scheduler.mode=FAIR`` the
  pools share the cluster, with FIFO they still fill each other's gaps.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attriscope.operators import ml as ML
from attriscope.session import ensure_checkpoint_dir, materialize


def draws(spark: SparkSession, space: dict, n_trials: int, seed: int = 42) -> DataFrame:
    """(trial, param, kind, u, value): u from the first 32 bits of MD5(seed:trial:param), scaled to the parameter's range."""
    params = spark.createDataFrame([(p, k, float(lo), float(hi)) for p, (k, lo, hi) in sorted(space.items())], "param string, kind string, lo double, hi double")
    trials = params.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1)))) if n_trials else params.withColumn("trial", F.lit(0)).where("false")
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("trial").cast("string"), "param"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    lo, hi = F.col("lo"), F.col("hi")
    value = (F.when(F.col("kind") == "int", F.floor(lo + F.col("u") * (hi - lo + 1)).cast("double"))
             .when(F.col("kind") == "log", F.exp(F.log(lo) + F.col("u") * (F.log(hi) - F.log(lo)))).otherwise(lo + F.col("u") * (hi - lo)))
    return trials.withColumn("u", u).select("trial", "param", "kind", "u", value.alias("value"))


def trial_parameters(spark: SparkSession, space: dict, n_trials: int, seed: int = 42) -> list[dict]:
    """The parameters of each trial (the search's own small table)."""
    out: list[dict] = [{} for _ in range(n_trials)]
    for r in draws(spark, space, n_trials, seed).collect():
        out[r["trial"]][r["param"]] = int(r["value"]) if r["kind"] == "int" else r["value"]
    return out


def out_of_fold(sets: list[tuple], features: list[str], params: dict, id_col: str, label: str = ML.LABEL, seed: int = 42) -> DataFrame:
    """(fold, id, label, prob, prediction) of each fold's validation rows by the model that has not seen them."""
    parts = None
    for fold, (train, n, valid) in enumerate(sets):
        scored, _ = ML.fit_and_score(ML.gbt_from_params(features, params, label=label, seed=seed, n_rows=n), train, valid)
        part = scored.select(F.lit(fold).alias("fold"), id_col, F.col(label).cast("int").alias("label"), "prob", F.col("prediction").cast("int").alias("prediction"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def grouped_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall and F1 of each group in one aggregate (a zero denominator gives 0)."""
    t, p = F.col("label"), F.col("prediction")
    c = predictions.groupBy(*by).agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 0) & (p == 0)).alias("tn"))

    def share(a: str, b: str):
        return F.coalesce(F.try_divide(F.expr(a).cast("double"), F.expr(b).cast("double")), F.lit(0.0))

    return c.select(*by, "tp", "fp", "fn", "tn", share("tp + tn", "tp + fp + fn + tn").alias("accuracy"), share("tp", "tp + fp").alias("precision"),
                    share("tp", "tp + fn").alias("recall"), share("2 * tp", "2 * tp + fp + fn").alias("f1"))


def search_key(folds: DataFrame, features: list[str], space: dict, k: int, resample: str) -> str:
    """Digest of all that a trial's result depends on besides its seed and number."""
    rows = folds.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(folds.columns)]).cast("decimal(38,0)")).alias("h")).first()
    text = json.dumps([sorted(space.items()), k, resample, features, rows["n"], str(rows["h"])])
    return hashlib.sha256(text.encode()).hexdigest()[:24]


class TrialStore:
    """Finished trials under one folder; every trial has a folder of its own, so trials never write to the same place."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/attriscope/trials"

    def path(self, key: str, seed: int, trial: int) -> str:
        return f"{self.folder}/search={key}/seed={seed}/trial={trial}"

    def has(self, key: str, seed: int, trial: int) -> bool:
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path(key, seed, trial)}/_SUCCESS")
        return mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)

    def write(self, predictions: DataFrame, params: dict, key: str, seed: int, trial: int) -> None:
        predictions.withColumn("params", F.lit(json.dumps(params, sort_keys=True))).write.mode("overwrite").parquet(self.path(key, seed, trial))

    def predictions(self, key: str, seed: int, trials: list[int]) -> DataFrame:
        """(search, seed, trial, params, fold, id, label, prob, prediction) of the given trials."""
        paths = [self.path(key, seed, t) for t in trials]
        return self.spark.read.option("basePath", self.folder).parquet(*paths)


def search(
    folds: DataFrame, features: list[str], id_col: str, space: dict, n_trials: int, k: int = 5, resample: str = "smote_tomek", seed: int = 42,
    parallelism: int = 1, store: TrialStore | None = None, on_trial: Callable[[int], None] | None = None,
) -> DataFrame:
    """Out-of-fold predictions of all trials, from the store; those not there yet are trained and added first.

    ``on_trial`` is called before a trial is trained (for logs and tests).
    """
    spark = folds.sparkSession
    store = store or TrialStore(spark)
    key = search_key(folds, features, space, k, resample)
    params = trial_parameters(spark, space, n_trials, seed)
    todo = [t for t in range(n_trials) if not store.has(key, seed, t)]
    if todo:
        sets = ML.fold_sets(materialize(folds, "folds"), features, id_col, k, resample)

        def run(t: int) -> None:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{t}")
            if on_trial:
                on_trial(t)
            store.write(out_of_fold(sets, features, params[t], id_col, seed=seed), params[t], key, seed, t)

        if parallelism > 1:
            with ThreadPoolExecutor(parallelism) as pool:
                list(pool.map(inheritable_thread_target(spark)(run), todo))
        else:
            for t in todo:
                run(t)
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
    return store.predictions(key, seed, list(range(n_trials)))


def trial_table(predictions: DataFrame) -> DataFrame:
    """(trial, params, mean_f1, best): the mean F1 over the folds of each trial; ties go to the earlier trial."""
    folds = grouped_metrics(predictions, ["trial", "params", "fold"])
    means = folds.groupBy("trial", "params").agg(F.avg("f1").alias("mean_f1"))
    best = means.agg(F.min_by("trial", F.struct(-F.col("mean_f1"), F.col("trial"))).alias("t"))  # one row
    return means.join(F.broadcast(best), F.lit(True), "left").select("trial", "params", "mean_f1", (F.col("trial") == F.col("t")).alias("best"))


def best_parameters(trials: DataFrame) -> dict:
    return json.loads(trials.where("best").first()["params"])
