import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attriscope.operators.quantiles import exact_quantiles


def _np_q(vals, q):
    return float(np.quantile(np.array(vals, dtype=float), q, method="linear"))


@pytest.mark.parametrize("buckets", [4096, 30])
def test_matches_numpy(spark, buckets):
    rng = np.random.default_rng(1)
    vals = list(rng.normal(size=500)) + [0.5] * 40 + [float("nan")]
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    got = exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0], buckets=buckets)[()]
    clean = [v for v in vals if not np.isnan(v)]
    for q, v in got.items():
        assert v == pytest.approx(_np_q(clean, q), abs=1e-12)


def test_grouped(spark):
    rows = [("a", float(i)) for i in range(1, 5)] + [("b", 10.0), ("b", 10.0), ("b", 20.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = exact_quantiles(df, "x", [0.25, 0.5], by=["g"], buckets=2)
    assert got[("a",)][0.25] == pytest.approx(1.75)   # exact, not the approximate summary's 1
    assert got[("a",)][0.5] == pytest.approx(2.5)
    assert got[("b",)][0.5] == pytest.approx(10.0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.sampled_from([0.1, 0.5, 0.9]))
def test_property_integers(spark, xs, q):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = exact_quantiles(df, "x", [q], buckets=16)[()][q]
    assert got == pytest.approx(_np_q(xs, q), abs=1e-9)


def test_infinities_null_groups_and_equal_values(spark):
    inf = float("inf")
    rows = [(None, -inf), (None, inf), (None, 1.0), ("a", 5e-324), ("a", 1.7e308), ("a", -1.7e308), ("a", 0.0), ("a", inf)]
    got = exact_quantiles(spark.createDataFrame(rows, "g string, x double"), "x", [0.0, 0.5, 1.0], by=["g"])
    assert got[(None,)] == {0.0: -inf, 0.5: 1.0, 1.0: inf}
    assert got[("a",)] == {0.0: -1.7e308, 0.5: 5e-324, 1.0: inf}
    same = spark.range(1_000_000).selectExpr("CAST(7 AS DOUBLE) AS x")
    assert exact_quantiles(same, "x", [0.25, 0.5])[()] == {0.25: 7.0, 0.5: 7.0}


def test_table_form_equals_driver_form(spark):
    """Ties, infinities, NaN and null values, a null group, a hot group, tiny and huge ranges."""
    import random

    from attriscope.operators.quantiles import exact_quantiles, quantile_table

    random.seed(3)
    rows = [(None if i % 9 == 0 else f"g{i % 40}", random.choice([random.gauss(0, 1), 5.0, 5.0, 1e300 * random.random(), -1e-300 * random.random()])) for i in range(2000)]
    rows += [("hot", float(random.randrange(50))) for _ in range(1500)] + [("one", 7.0), ("none", None), ("nan", float("nan")), ("inf", float("inf")), ("inf", -float("inf")), ("inf", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = exact_quantiles(df, "v", qs, ["g"])
    got = {(r["g"],): r for r in quantile_table(df, "v", qs, ["g"]).collect()}
    assert got.keys() == want.keys() and got[("hot",)]["n"] == 1500
    for g, r in got.items():
        for q, name in zip(qs, ["q0", "q25", "q50", "q90", "q100"]):
            assert r[name] == want[g][q] or (r[name] != r[name] and want[g][q] != want[g][q]), (g, q)


def test_many_groups_use_the_table_form(spark, monkeypatch):
    from attriscope.operators import quantiles as Q

    df = spark.range(3000).selectExpr("id % 1000 AS g", "CAST(id AS DOUBLE) AS v")
    a = sorted(map(tuple, Q.exact_quantile_frame(df, "v", [0.5], ["g"]).collect()))
    monkeypatch.setattr(Q, "DRIVER_GROUPS", 10)
    monkeypatch.setattr(Q, "exact_quantiles", None)  # not used
    assert sorted(map(tuple, Q.exact_quantile_frame(df, "v", [0.5], ["g"]).collect())) == a
