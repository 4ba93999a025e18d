"""Sources and sinks: CSV round trip with a declared schema, report sink, key lookup."""

from pyspark.sql import functions as F

from attriscope.operators.quantiles import exact_median
from attriscope.plans.q_sources import RAW_COLUMNS
from attriscope.session import work_path
from attriscope.sources.files import entity_report, lookup_entity, read_csv, write_csv, write_report


def test_csv_roundtrip_exact(spark, emp):
    raw = emp.select(*RAW_COLUMNS)
    back = read_csv(spark, write_csv(raw, work_path(spark, "t-csv")))
    assert back.schema == read_csv(spark, write_csv(raw.limit(1), work_path(spark, "t-csv1"))).schema
    assert back.exceptAll(raw).count() == 0 and raw.exceptAll(back).count() == 0


def test_report_sink_partitioned(spark, emp):
    rep = entity_report(emp, exact_median(emp, "MonthlyIncome"))
    path = write_report(rep, work_path(spark, "t-report"))
    back = spark.read.json(path)
    assert back.count() == emp.count()
    assert set(r[0] for r in back.select("Department").distinct().collect()) == \
        set(r[0] for r in emp.select("Department").distinct().collect())
    with_recs = rep.where(F.col("n_recommendations") > 0).first()
    assert with_recs is None or with_recs["recommendations"].startswith("- ")


def test_lookup_binds_key(spark, emp):
    one = lookup_entity(spark, emp, "3")
    assert [r["EmployeeNumber"] for r in one.collect()] == [3]
    assert lookup_entity(spark, emp, 10 ** 9).count() == 0
