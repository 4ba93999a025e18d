"""Score roster files as they arrive, each by its own header; files that cannot be read are set aside with a reason.

The stream lists files only (path and length; no content is read for that).  A micro-batch reads the header of each of its
files, groups the files with the same header into one scan, finds columns by name, and scores all of them together.  So
files of one folder may have different column orders and extra columns.  A file that cannot be bound - blank, without
the key, with a repeated column name, unreadable, or with lines that are longer or shorter than its header - goes to the
quarantine table and the batch goes on; a file without a byte holds nothing and is passed over.

Both outputs are folders ``batch=<id>`` that a repeated batch overwrites, so a driver that dies between the write and the
stream's commit writes the same rows again instead of twice.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attriscope.operators.scoring import RISK_PCT, score_formula
from attriscope.session import materialize
from attriscope.sources.files import EMPLOYEE_SCHEMA

REQUIRED = ("EmployeeNumber",)


def header_of(spark: SparkSession, path: str, required=REQUIRED) -> tuple[tuple[str, ...] | None, str | None]:
    """(column names, None) of a file, or (None, why it cannot be bound)."""
    try:
        first = spark.read.option("header", False).csv(path).limit(1).collect()  # blank lines are passed over
        if not first:
            return None, "empty file"
        names = first[0]
    except PySparkException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None, "empty file"
        return None, f"unreadable: {e.getCondition() or type(e).__name__}"
    names = tuple("" if n is None else n.strip() for n in names)
    if len({n.lower() for n in names}) < len(names):
        return None, "repeated column name"
    missing = [c for c in required if c not in names]
    return (None, f"no column {missing[0]}") if missing else (names, None)


def read_group(spark: SparkSession, names: tuple[str, ...], paths: list[str], schema: T.StructType = EMPLOYEE_SCHEMA) -> DataFrame:
    """Rows of files with one header, by name, with their file and whether the line fits the header."""
    types = {f.name: f.dataType for f in schema.fields}
    text = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(text).option("header", True).option("columnNameOfCorruptRecord", "_bad").option("columnPruning", False).csv(paths)
    typed = [F.trim(F.col(f"`{n}`")).try_cast(types[n]).alias(n) if n in types and not isinstance(types[n], T.StringType) else F.col(f"`{n}`") for n in names]
    rows = rows.select(*typed, F.col("_metadata.file_path").alias("_file"), F.col("_bad").isNotNull().alias("_misfit"))
    return rows.select(*[F.col(f"`{f.name}`") if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], "_file", "_misfit")


def read_batch(spark: SparkSession, paths: list[str], schema: T.StructType = EMPLOYEE_SCHEMA, required=REQUIRED) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(rows of the files that can be bound, [(path, reason)] of the others)."""
    groups: dict[tuple[str, ...], list[str]] = {}
    bad = []
    for path in sorted(paths):  # the files of one micro-batch
        names, why = header_of(spark, path, required)
        if names is None:
            bad.append((path, why))
        else:
            groups.setdefault(names, []).append(path)
    rows = None
    for names, some in groups.items():
        part = read_group(spark, names, some, schema)
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return None, bad
    rows = materialize(rows, "stream-batch")  # parsed once, for the misfits and for the scores
    misfits = rows.where("_misfit").groupBy("_file").agg(F.count("*").alias("n")).collect()  # at most one row for each file
    bad += [(r["_file"], f"{r['n']} lines do not fit the header") for r in misfits]
    if misfits:
        rows = rows.where(~F.col("_file").isin([r["_file"] for r in misfits]))
    return rows.drop("_misfit"), bad


def score_files(
    spark: SparkSession, in_dir: str, out_dir: str, quarantine_dir: str, checkpoint: str, files_per_trigger: int, scorer=score_formula,
) -> int:
    """One available-now pass over the files that are new; returns the number of micro-batches."""
    from attriscope.streaming.roster import _committed

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        paths = [r["path"] for r in batch.select("path").distinct().collect()]  # files_per_trigger at most
        rows, bad = read_batch(session, paths)
        if rows is not None:
            scored = scorer(rows).withColumn(RISK_PCT, F.bround(F.col("Risk") * F.lit(100.0), 2))
            scored.select("EmployeeNumber", "JobRole", "Department", RISK_PCT).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
        if bad:
            session.createDataFrame(bad, "path string, reason string").coalesce(1).write.mode("overwrite").parquet(f"{quarantine_dir}/batch={batch_id}")

    before = _committed(spark, checkpoint)
    files = (spark.readStream.format("binaryFile").schema(spark.read.format("binaryFile").load(in_dir).schema)
             .option("maxFilesPerTrigger", files_per_trigger).load(in_dir).select("path", "length"))
    query = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return _committed(spark, checkpoint) - before
