"""Score roster CSV files as they arrive (extension of the batch roster scoring).

File source with a declared schema -> the same scoring transform as the batch
path -> parquet sink.  The checkpoint records which files were consumed, so a
rerun (or a restarted driver) only scores new files; ``availableNow`` drains
what is there in bounded micro-batches and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attriscope.operators.scoring import RISK_PCT, score_formula
from attriscope.sources.files import by_name, header_schema


def scored_stream(spark: SparkSession, in_dir: str, files_per_trigger: int, scorer=score_formula) -> DataFrame:
    """Columns are found by the header of the files that are there; a later file with another order fails its batch."""
    src = (spark.readStream.schema(header_schema(spark, in_dir)).option("header", True).option("enforceSchema", False)
           .option("maxFilesPerTrigger", files_per_trigger).csv(in_dir))
    scored = scorer(by_name(src)).withColumn(RISK_PCT, F.bround(F.col("Risk") * F.lit(100.0), 2))
    return scored.select("EmployeeNumber", "JobRole", "Department", RISK_PCT)


def score_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, files_per_trigger: int,
                 scorer=score_formula) -> int:
    """Run one available-now pass; returns the number of micro-batches it committed (counted in the checkpoint)."""
    before = _committed(spark, checkpoint)
    q = (scored_stream(spark, in_dir, files_per_trigger, scorer).writeStream
         .format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return _committed(spark, checkpoint) - before


def _committed(spark: SparkSession, checkpoint: str) -> int:
    """Batches in the checkpoint's commit log."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(f.getPath().getName().isdigit() for f in fs.listStatus(path)) if fs.exists(path) else 0
