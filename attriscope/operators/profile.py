"""Table profile: nulls, numeric / string summaries, schema, preview, constant columns.

All per-column statistics are computed in one wide aggregate (one scan, partial
aggregation) and unpivoted afterwards; exact quartiles come from the
distributed selection in :mod:`attriscope.operators.quantiles` over a long
(column, value) projection, so every column shares the same passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attriscope.operators.quantiles import exact_quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _missing(df: DataFrame, c: str):
    col = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: missing count, percent (2 dp, half-even) and whether any is missing."""
    cols = df.columns
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', {i}, `m{i}`" for i, c in enumerate(cols))
    long = row.select("_n", F.expr(f"stack({len(cols)}, {stack}) as (column_name, ordinal, null_count)"))
    # grand total over the per-column rows (one row per column, not per data row)
    return long.select(
        "column_name", "ordinal", "null_count",
        F.bround(F.try_divide(F.col("null_count") * F.lit(100.0), F.col("_n")), 2).alias("null_pct"),
        (F.col("null_count") > 0).alias("has_missing"),
        F.sum("null_count").over(Window.partitionBy()).alias("total_nulls"))


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``describe()``: count, mean, sample std, min, exact quartiles, max per numeric column."""
    cols = columns or numeric_columns(df)
    spark = df.sparkSession
    stats = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        x = F.when(~F.isnan(x), x)  # NaN is missing
        stats += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                  F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    r = df.agg(*stats).collect()[0]
    # long projection (column, value) so one set of selection passes serves every column
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.select(F.expr(f"stack({len(cols)}, {stack}) as (column_name, value)"))
    qs = exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=["column_name"])
    rows = []
    for i, c in enumerate(cols):
        q = qs.get((c,), {})
        rows.append((c, r[f"n{i}"], r[f"a{i}"], r[f"s{i}"], r[f"lo{i}"], q.get(0.25), q.get(0.5), q.get(0.75), r[f"hi{i}"]))
    return spark.createDataFrame(
        rows, "column_name string, count bigint, mean double, std double, min double, "
              "q25 double, q50 double, q75 double, max double")


def categorical_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per string column: non-null count, distinct count, most frequent value (ties: smallest) and its count."""
    cols = columns or string_columns(df)
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = df.select(F.expr(f"stack({len(cols)}, {stack}) as (column_name, value)")).where(F.col("value").isNotNull())
    vc = long.groupBy("column_name", "value").agg(F.count("*").alias("c"))
    order = F.struct(-F.col("c"), F.col("value"))
    return vc.groupBy("column_name").agg(
        F.sum("c").alias("count"), F.count("*").alias("unique"),
        F.min_by("value", order).alias("top"), F.max("c").alias("freq"))


def schema_profile(df: DataFrame) -> DataFrame:
    """Column list with Spark type, position and exact distinct count.

    The cells go as (column, value) rows through one distinct (values are first reduced in each task), where one
    count of distinct values for each column in one aggregate would copy every row once for each column.
    """
    spark, fields = df.sparkSession, df.schema.fields
    types = spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)],
                                  "ordinal int, column_name string, data_type string")

    def value(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0)  # -0.0 is 0.0
        return (F.hex(c) if isinstance(f.dataType, T.BinaryType) else c.cast("string")).alias("value")

    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), value(f)) for i, f in enumerate(fields)])))
    counts = cells.where(F.col("value").isNotNull()).distinct().groupBy("ordinal").agg(F.count("*").alias("n_distinct"))
    return types.join(F.broadcast(counts), "ordinal", "left").fillna(0, ["n_distinct"])  # one row for each column


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def dtype_counts(df: DataFrame) -> DataFrame:
    """Per type: its columns and their non-null values, from one aggregate over the table."""
    fields = df.schema.fields
    row = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"n{i}") for i, f in enumerate(fields)])
    cells = F.array(*[F.struct(F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"n{i}").alias("n")) for i, f in enumerate(fields)])
    return row.select(F.inline(cells)).groupBy("data_type").agg(F.count("*").alias("n_columns"), F.sum("n").alias("n_values"))


def preview(df: DataFrame, key: str, n_rows: int = 5, n_cols: int = 10) -> DataFrame:
    return df.orderBy(key).limit(n_rows).select(*df.columns[:n_cols])


def zero_variance_columns(df: DataFrame) -> DataFrame:
    """Columns with exactly one distinct non-null value, and that value (as text).

    ``min = max`` over non-null values is equivalent to ``nunique() == 1`` and
    needs only a partial aggregate, where ``count(distinct)`` needs a shuffle of
    every distinct value.  An all-null column is kept, as ``nunique() == 0``.
    """
    cols = df.columns
    aggs = []
    for i, c in enumerate(cols):
        x = F.when(~_missing(df, c), F.col(f"`{c}`"))
        aggs += [F.min(x).cast("string").alias(f"lo{i}"), F.max(x).cast("string").alias(f"hi{i}")]
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', {i}, `lo{i}`, `hi{i}`" for i, c in enumerate(cols))
    long = row.select(F.expr(f"stack({len(cols)}, {stack}) as (column_name, ordinal, lo, hi)"))
    return long.where(F.col("lo").isNotNull() & (F.col("lo") == F.col("hi"))) \
               .select("column_name", "ordinal", F.col("lo").alias("constant"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct()
