"""Classification metrics as aggregates: one pass of conditional counts.

A zero denominator gives 0 (as the reference's metric library does by default).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def confusion_counts(df: DataFrame, truth: str, pred: str):
    t, p = F.col(truth), F.col(pred)
    return df.agg(F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"),
                  F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 0) & (p == 0)).alias("tn"))


def binary_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 (plus the four counts)."""
    c = confusion_counts(df, truth, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec = _safe_div(tp, tp + fp)
    rec = _safe_div(tp, tp + fn)
    return c.select("tp", "fp", "fn", "tn",
                    _safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion_matrix(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """All four (actual, predicted) cells, empty cells as 0."""
    c = confusion_counts(df, truth, pred)
    return c.select(F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (actual, predicted, n)"))


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per-class precision / recall / F1 / support, then accuracy, macro and weighted averages."""
    c = confusion_counts(df, truth, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    # class 1 counts are (tp, fp, fn); class 0 sees the matrix mirrored: (tn, fn, fp)
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1 = _safe_div(2 * tp, 2 * tp + fp + fn)
    f0 = _safe_div(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    acc = _safe_div(tp + tn, n)
    rows = c.select(
        p0.alias("p0"), r0.alias("r0"), f0.alias("f0"), s0.alias("s0"),
        p1.alias("p1"), r1.alias("r1"), f1.alias("f1"), s1.alias("s1"), acc.alias("acc"), n.alias("n"))
    return rows.select(F.expr(
        "stack(5, "
        "'0', p0, r0, f0, s0, "
        "'1', p1, r1, f1, s1, "
        "'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), acc, n, "
        "'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n, "
        "'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n"
        ") as (class, precision, recall, f1, support)"))


# Published numbers of the earlier model (fixed values of the comparison).
BASELINE_RECALL = 0.1277
BASELINE_F1 = 0.1905


def model_comparison(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Baseline (published) vs new recall / F1, one row per metric with the change."""
    m = binary_metrics(df, truth, pred)
    base = m.sparkSession.createDataFrame([("recall", BASELINE_RECALL), ("f1", BASELINE_F1)],
                                          "metric string, baseline double")
    new = m.select(F.expr("stack(2, 'recall', recall, 'f1', f1) as (metric, new)"))
    return base.join(new, "metric").withColumn("change", F.col("new") - F.col("baseline"))
