from pyspark.sql import functions as F

from attriscope.operators.features import FittedFeatures, align_features, fit_features, seeded_sample


def test_single_row_equals_batch(spark, emp):
    """Fitted vocabulary: one employee scored alone is encoded exactly as in the batch."""
    ff = fit_features(emp, "v2")
    batch = ff.transform(emp).where("EmployeeNumber = 5").first().asDict()
    one = ff.transform(emp.where("EmployeeNumber = 5")).first().asDict()
    assert batch == one
    assert sum(v for k, v in one.items() if k.startswith("JobRole_")) <= 1


def test_manifest_roundtrip_and_drops(spark, emp):
    ff = fit_features(emp, "v1")
    assert set(ff.dropped) == {"EmployeeCount", "Over18", "StandardHours"}
    assert "EmployeeNumber" not in ff.feature_names and "Risk" not in ff.feature_names
    assert FittedFeatures.from_json(ff.to_json()) == ff
    assert all(not n.endswith("_NATION_0") and n != "Department_AUTOMOBILE" for n in ff.feature_names)


def test_unseen_category_is_all_zero(spark, emp):
    ff = fit_features(emp, "v1")
    row = emp.limit(1).withColumn("JobRole", F.lit("NEVER_SEEN"))
    out = ff.transform(row).first().asDict()
    assert all(out[k] == 0 for k in out if k.startswith("JobRole_"))


def test_align_adds_missing_drops_extra(spark, emp):
    df = emp.select("EmployeeNumber", "Age", "OverTime")
    out = align_features(df, ["Age", "Missing1"])
    assert out.columns == ["EmployeeNumber", "Age", "Missing1"]
    assert out.agg(F.max("Missing1")).first()[0] == 0


def test_seeded_sample_more_than_rows(spark, emp):
    assert seeded_sample(emp, 10 ** 6).count() == emp.count()
    a = [r[0] for r in seeded_sample(emp, 20).select("EmployeeNumber").collect()]
    b = [r[0] for r in seeded_sample(emp, 20).select("EmployeeNumber").collect()]
    assert sorted(a) == sorted(b) and len(set(a)) == 20


def test_join_small_both_paths(spark, emp):
    from attriscope.operators.common import join_small

    g = emp.groupBy("Department").count()
    a = join_small(emp.select("EmployeeNumber", "Department"), g, "Department").orderBy("EmployeeNumber").collect()
    b = join_small(emp.select("EmployeeNumber", "Department"), g, "Department", max_bytes=0).orderBy("EmployeeNumber").collect()
    assert a == b and len(a) == emp.count()


def test_drop_for_scoring_ignores_missing(spark, emp):
    from attriscope.operators.features import drop_for_scoring

    out = drop_for_scoring(emp.drop("Over18"))
    assert not {"EmployeeCount", "Over18", "StandardHours", "Attrition"} & set(out.columns)
