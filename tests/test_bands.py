from pyspark.sql import functions as F

from attriscope.functions.bands import band_index, band_label, complete_bands


def test_right_closed_edges(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 0.1, 0.3, 0.30001, 0.6, 1.0, 1.2, None]], "r double")
    got = [r["b"] for r in df.select(band_label("r", "risk3").alias("b")).collect()]
    # 0 is the lowest edge: unbanded; 0.3 belongs to the lower band; above 1: null
    assert got == [None, "Low", "Low", "Medium", "Medium", "High", None, None]


def test_tenure_lowest_edge_inclusive_of_zero(spark):
    df = spark.createDataFrame([(x,) for x in [-1, 0, 1, 2, 10, 11, 40, 41]], "y int")
    got = [r["b"] for r in df.select(band_index("y", "tenure").alias("b")).collect()]
    assert got == [None, 0, 0, 1, 3, 4, 4, None]


def test_empty_bands_kept(spark):
    agg = spark.createDataFrame([(0, 5), (2, 1)], "band_ix int, n bigint")
    out = complete_bands(agg, "risk3", fill={"n": 0}).orderBy("band_ix").collect()
    assert [(r["band"], r["n"]) for r in out] == [("Low", 5), ("Medium", 0), ("High", 1)]


def test_band_label_null_keeps_null(spark):
    df = spark.createDataFrame([(None,)], "a int")
    assert df.select(band_label(F.col("a"), "age").alias("b")).first()["b"] is None
