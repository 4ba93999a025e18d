from pyspark.sql import functions as F

from attriscope.operators.ranking import global_rank
from attriscope.operators.split import stratified_folds, stratified_split


def test_global_rank_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1009).alias("k"), F.col("id")).repartition(7)
    r = global_rank(df, ["k", "id"]).orderBy("rank").collect()
    assert [x["rank"] for x in r] == list(range(1, 1001))
    keys = [(x["k"], x["id"]) for x in r]
    assert keys == sorted(keys)


def test_group_rank_with_hot_group(spark):
    # one class holds most rows: ranks inside each class stay dense
    df = spark.range(0, 600).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("g"))
    r = global_rank(df, ["id"], group="g", group_rank_col="rk")
    for g, n in (("rare", 60), ("hot", 540)):
        got = sorted(x["rk"] for x in r.where(F.col("g") == g).collect())
        assert got == list(range(1, n + 1))


def test_stratified_split_sizes(spark, emp):
    lab = emp.select("EmployeeNumber", F.when(F.col("Attrition") == "Yes", 1).otherwise(0).alias("y"))
    s = stratified_split(lab, "y", "EmployeeNumber")
    counts = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    for y in (0, 1):
        n = counts[(y, "test")] + counts[(y, "train")]
        assert counts[(y, "test")] == (n * 2 + 5) // 10


def test_folds_disjoint_and_balanced(spark, emp):
    lab = emp.select("EmployeeNumber", F.when(F.col("Attrition") == "Yes", 1).otherwise(0).alias("y"))
    f = stratified_folds(lab, "y", "EmployeeNumber").collect()
    ids = [r["EmployeeNumber"] for r in f]
    assert len(ids) == len(set(ids))
    test_ids = {r["EmployeeNumber"] for r in stratified_split(lab, "y", "EmployeeNumber").where("split = 'test'").collect()}
    assert not (set(ids) & test_ids)           # no leakage from the hold-out
    for y in (0, 1):
        sizes = [sum(1 for r in f if r["y"] == y and r["fold"] == k) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
