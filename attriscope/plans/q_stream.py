"""Streaming extension query (K1)."""

from pyspark.sql import functions as F

from attriscope.operators.scoring import RISK_PCT
from attriscope.plans.base import query, with_v
from attriscope.plans.q_sources import RAW_COLUMNS
from attriscope.session import work_path
from attriscope.sources.files import write_csv
from attriscope.sources.tables import employees as E
from attriscope.streaming.by_file import score_files
from attriscope.streaming.roster import score_stream


@query("roster_stream", with_v(f"""
SELECT EmployeeNumber, JobRole, Department, ROUND_EVEN(Risk * 100E0, 2) AS {RISK_PCT} FROM v"""))
def q_roster_stream(spark, sf):
    """The employee roster dropped as 4 CSV files, scored by an available-now file stream."""
    base = work_path(spark, "roster-stream")
    write_csv(E(spark, sf).select(*RAW_COLUMNS).repartition(4, "EmployeeNumber"), f"{base}/in")
    score_stream(spark, f"{base}/in", f"{base}/out", f"{base}/chk", files_per_trigger=2)
    return spark.read.parquet(f"{base}/out")


@query("roster_files_stream", with_v(f"""
SELECT EmployeeNumber, JobRole, Department, ROUND_EVEN(Risk * 100E0, 2) AS {RISK_PCT} FROM v WHERE EmployeeNumber % 5 <> 4"""))
def q_roster_files_stream(spark, sf):
    """Roster files of four column orders and one without its key in one folder: the four are scored, the fifth set aside."""
    base = work_path(spark, "roster-files")
    emp = E(spark, sf).select(*RAW_COLUMNS)
    orders = [RAW_COLUMNS, RAW_COLUMNS[::-1], sorted(RAW_COLUMNS), ["Extra", *RAW_COLUMNS[5:], *RAW_COLUMNS[:5]], [c for c in RAW_COLUMNS if c != "EmployeeNumber"]]
    for i, names in enumerate(orders):
        part = emp.where(F.col("EmployeeNumber") % 5 == i).withColumn("Extra", F.lit("x")).select(*names)
        part.repartition(2).write.mode("append").option("header", True).csv(f"{base}/in")
    score_files(spark, f"{base}/in", f"{base}/out", f"{base}/aside", f"{base}/checkpoint", 4)
    return spark.read.parquet(f"{base}/out").drop("batch")
