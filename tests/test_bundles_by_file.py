"""Published bundles (half-written and damaged versions are passed over) and the stream that reads each file by its header."""

import pytest
from pyspark.sql import functions as F

from attriscope.operators import ml as ML
from attriscope.operators.features import fit_features
from attriscope.plans.q_sources import RAW_COLUMNS
from attriscope.session import work_path
from attriscope.sources import bundles as B
from attriscope.streaming.by_file import score_files


@pytest.fixture(scope="module")
def trained(spark, emp):
    ff = fit_features(emp, "v2")
    rows = ff.transform(emp).where("Attrition IS NOT NULL")
    return ff, [ML.gbt_from_params(ff.feature_names, {"n_estimators": n, "max_depth": 2}).fit(rows) for n in (2, 3)]


def text(spark, path, body):
    """A file as it is uploaded: written through Spark's file system."""
    fs, p = B._fs(spark, path)
    out = fs.create(p)
    out.write(bytearray(body.encode()))
    out.close()


def test_only_whole_committed_versions_are_read(spark, emp, trained):
    ff, (old, new) = trained
    root, manifest = work_path(spark, "models"), {"features": ff.to_json(), "feature_names": ff.feature_names}
    with pytest.raises(FileNotFoundError):
        B.newest(spark, root)
    first = B.publish(spark, root, old, manifest)
    # a publisher that died before its commit: everything but the last step
    new.write().save(f"{root}/v000002-00000000/model")
    B.file_list(spark, f"{root}/v000002-00000000/model").coalesce(1).write.parquet(f"{root}/v000002-00000000/files")
    assert B.newest(spark, root).version == first
    second = B.publish(spark, root, new, manifest)
    assert second.startswith("v000003-") and B.newest(spark, root).version == second
    assert B.versions(spark, root) == [second, first] and len(B.versions(spark, root, committed=False)) == 3
    # the scores are those of the model that was published, and the manifest carries the features
    bundle = B.newest(spark, root)
    got = B.bundle_scorer(bundle)(emp.drop("Risk", "RiskMargin")).select("EmployeeNumber", "Risk")
    want = ML.positive_probability(new.transform(ff.transform(emp, with_label=False))).select("EmployeeNumber", "prob")
    assert dict(map(tuple, got.collect())) == dict(map(tuple, want.collect()))
    assert set(got.columns) == {"EmployeeNumber", "Risk"}
    # a damaged file: the version before it is read
    some = spark.read.parquet(f"{root}/{second}/files").where("path LIKE '%metadata/part%'").first()["path"]
    text(spark, f"{root}/{second}/model/{some}", "damaged")
    assert B.newest(spark, root).version == first


def test_the_model_is_read_only_when_it_is_used(spark, trained, monkeypatch):
    ff, (model, _) = trained
    root = work_path(spark, "models")
    B.publish(spark, root, model, {"feature_names": ff.feature_names})
    read, load = [], B.PipelineModel.load
    monkeypatch.setattr(B.PipelineModel, "load", lambda path: read.append(path) or load(path))
    bundle = B.newest(spark, root)
    assert not read
    assert bundle.model.stages[-1].totalNumNodes == model.stages[-1].totalNumNodes
    assert bundle.model is bundle.model and read == [f"{bundle.path}/model"]


def test_files_with_their_own_headers_and_bad_files(spark, emp):
    base = work_path(spark, "by-file")
    rows = emp.select(*RAW_COLUMNS).where("EmployeeNumber <= 60")
    for i, names in enumerate([RAW_COLUMNS, ["More", *RAW_COLUMNS[::-1]], [c for c in RAW_COLUMNS if c != "StandardHours"]]):
        part = rows.where(F.col("EmployeeNumber") % 3 == i).withColumn("More", F.lit("a,\"b\"")).select(*names)
        part.coalesce(1).write.mode("append").option("header", True).csv(f"{base}/in")
    text(spark, f"{base}/in/empty.csv", "\n\n")
    text(spark, f"{base}/in/nothing.csv", "")  # no byte: no row, and no reason either
    text(spark, f"{base}/in/nokey.csv", "Age,OverTime\n30,Yes\n")
    text(spark, f"{base}/in/twice.csv", "EmployeeNumber,Age,age\n1,2,3\n")
    text(spark, f"{base}/in/ragged.csv", "EmployeeNumber,Age\n900,30\n901,30,surplus\n")
    text(spark, f"{base}/in/odd.csv", "Age,EmployeeNumber\nold,902\n41,903\n")

    def run():
        return score_files(spark, f"{base}/in", f"{base}/out", f"{base}/aside", f"{base}/checkpoint", 3)

    assert run() >= 3
    out = spark.read.parquet(f"{base}/out")
    want = {r["EmployeeNumber"]: r["p"] for r in rows.join(emp.select("EmployeeNumber", "Risk"), "EmployeeNumber").select("EmployeeNumber", F.bround(F.col("Risk") * 100, 2).alias("p")).collect()}
    got = {r["EmployeeNumber"]: r["AttritionRiskPct"] for r in out.collect()}
    assert {k: v for k, v in got.items() if k < 900} == want and out.count() == len(got)
    assert set(got) - set(want) == {902, 903}  # a value that is no number is null, its row stays
    aside = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in spark.read.parquet(f"{base}/aside").collect()}
    assert set(aside) == {"empty.csv", "nokey.csv", "twice.csv", "ragged.csv"}
    assert aside["empty.csv"] == "empty file" and "EmployeeNumber" in aside["nokey.csv"] and "1 lines" in aside["ragged.csv"]
    assert run() == 0 and spark.read.parquet(f"{base}/out").count() == len(got)
    text(spark, f"{base}/in/later.csv", "OverTime,EmployeeNumber\nYes,950\n")
    assert run() == 1 and spark.read.parquet(f"{base}/out").where("EmployeeNumber = 950").count() == 1


def test_bundle_scores_equal_model_scores(spark):
    import __spark_entry__ as E

    a, b = (E.queries()[q](spark, "/root/testdata/sf0.001").select("EmployeeNumber", "AttritionRiskPct") for q in ("bundle_scores", "model_scores"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
