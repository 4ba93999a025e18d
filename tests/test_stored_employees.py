"""The employee view is written once for the plans that read it several times (own rows)."""

from datetime import datetime

import pytest

from attriscope.plans import base, q_ml
from attriscope.session import work_path
from attriscope.sources import tables as T


@pytest.fixture(scope="module")
def own(spark):
    sf = work_path(spark, "own")
    spark.createDataFrame([(0, "A"), (1, "B")], "n_nationkey int, n_name string").coalesce(1).write.parquet(f"{sf}/nation.parquet")
    people = [(i, i % 2, 10.0 * i, "XYZ"[i % 3]) for i in range(40)]
    spark.createDataFrame(people, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{sf}/customer.parquet")
    orders = [(j, j % 33, "FOP"[j % 3], "1-URGENT" if j % 4 else "5-LOW", datetime(1993 + j % 8, 12, 1 + j % 28)) for j in range(200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp") \
        .coalesce(1).write.parquet(f"{sf}/orders.parquet")
    return sf


def test_stored_rows_are_those_of_the_view(spark, own):
    view, stored = T.employees(spark, own), T.stored_employees(spark, own)
    assert stored.columns == view.columns and stored.count() == 40
    assert stored.exceptAll(view).count() == 0 and view.exceptAll(stored).count() == 0
    assert stored is T.stored_employees(spark, own)
    assert not any("orders.parquet" in f for f in stored.inputFiles())


def test_fitting_and_split_read_the_view_once(spark, own, monkeypatch):
    T.forget_employees(spark, own)
    made, view = [], T.employees
    for module, name in ((T, "employees"), (q_ml, "E"), (base, "employees")):
        monkeypatch.setattr(module, name, lambda s, sf: made.append(sf) or view(s, sf), raising=False)
    for version in ("v1", "v2"):
        _, train, test = q_ml._train_test(spark, own, version)
        assert train.count() + test.count() == 40
    assert made == [own]


def test_tables_of_resampling_are_gone_after_it(spark):
    """The k-NN tables are deleted once the resampled rows are checkpointed; those rows and tables written outside stay."""
    import os

    from attriscope.operators import ml as ML
    from attriscope.session import ensure_checkpoint_dir, materialize, scratch

    folder = ensure_checkpoint_dir(spark) + "/attriscope"
    rows = spark.range(300).selectExpr("id", "CAST(id % 5 = 0 AS INT) AS Attrition", "double(id * 37 % 101) AS a", "double(id * 53 % 97) AS b")
    kept = materialize(rows, "kept")
    want = sorted(map(tuple, ML.resample_fold(kept, ["a", "b"], "id", "smote_tomek").collect()))
    before = set(os.listdir(folder))
    with scratch(spark):
        res = ML.resample_fold(kept, ["a", "b"], "id", "smote_tomek").checkpoint(eager=True)
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before
    assert sorted(map(tuple, res.collect())) == want and kept.count() == 300
    materialize(rows, "after")
    assert len(set(os.listdir(folder)) - before) == 1
