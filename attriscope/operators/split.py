"""Exact stratified hold-out split and stratified k folds, seeded.

Within each class rows are ordered by an arithmetic hash of the key
``(pmod(key, 10007) * 7919 + seed) % 10007`` (then the key), so any engine reproduces the
order.  The rank inside the class comes from :func:`global_rank` (a
distributed sort; a hot class is spread over many partitions), never from a
``row_number`` window partitioned by class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attriscope.operators.common import join_small
from attriscope.operators.ranking import global_rank


def hash_order(key: str, seed: int = 42):
    return F.pmod(F.pmod(F.col(key), F.lit(10007)) * F.lit(7919) + F.lit(seed), F.lit(10007))  # reduced first: no overflow


def stratified_split(df: DataFrame, label: str, key: str, test_fraction=(1, 5), seed: int = 42) -> DataFrame:
    """Adds ``rank_in_class`` and ``split`` ('test' for the first round(frac * n_class) rows)."""
    num, den = test_fraction
    src = df.where(F.col(label).isNotNull()).withColumn("_h", hash_order(key, seed))
    ranked = global_rank(src, ["_h", key], rank_col="_grank", group=label, group_rank_col="rank_in_class")
    counts = src.groupBy(label).agg(F.count("*").alias("_n"))   # one row per class
    n_test = F.floor((F.col("_n") * F.lit(2 * num) + F.lit(den)) / F.lit(2 * den))  # round half up, integer
    out = join_small(ranked, counts, label).withColumn("_ntest", n_test)
    return (out.withColumn("split", F.when(F.col("rank_in_class") <= F.col("_ntest"), F.lit("test"))
                                    .otherwise(F.lit("train")))
               .drop("_h", "_grank", "_n"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, test_fraction=(1, 5), seed: int = 42) -> DataFrame:
    """Training rows of :func:`stratified_split` with ``fold = (rank among train in class - 1) % k``."""
    s = stratified_split(df, label, key, test_fraction, seed)
    tr = s.where(F.col("split") == "train")
    return tr.withColumn("fold", ((F.col("rank_in_class") - F.col("_ntest") - F.lit(1)) % F.lit(k)).cast("int")) \
             .drop("_ntest", "split")
