"""Dense global row numbers without a single-task window.

``row_number().over(Window.orderBy(...))`` without ``partitionBy`` moves every
row into one task, and ``partitionBy(class)`` does the same for a hot class.
Here the rows are range-partitioned by a distributed sort instead (a hot key
is split across partitions because the order key is unique), every row takes
its partition-local position from ``monotonically_increasing_id`` (upper bits
= partition, lower 33 bits = position), and a table with one row per partition
turns local positions into global ones.  The sorted data is checkpointed first
so the two uses of it see the same rows, and an executor loss re-reads the
checkpoint instead of re-sorting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attriscope.operators.common import join_small
from attriscope.session import ensure_checkpoint_dir

_LOW = (1 << 33) - 1


def global_rank(df: DataFrame, order: list, rank_col: str = "rank", group: str | None = None,
                group_rank_col: str | None = None) -> DataFrame:
    """Add a 1-based ``rank_col`` in ``order`` (which must make rows unique).

    With ``group`` the order is (group, *order) and ``group_rank_col`` also
    gets the 1-based rank inside the group (the rank minus the rows of the
    groups before it, from a per-group count table).
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = ([F.col(group)] if group else []) + [F.col(c) if isinstance(c, str) else c for c in order]
    sorted_df = (df.orderBy(*keys)
                   .withColumn("_m", F.monotonically_increasing_id())
                   .checkpoint(eager=True))
    part = (F.col("_m").bitwiseAND(F.lit(_LOW)))
    pid = F.shiftright(F.col("_m"), 33)
    counts = sorted_df.groupBy(pid.alias("_pid")).agg(F.count("*").alias("_c"))
    # one row per partition: bounded by the partition count, not the data
    offsets = counts.select(
        "_pid",
        (F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    out = (sorted_df.withColumn("_pid", pid)
                    .join(F.broadcast(offsets), "_pid")
                    .withColumn(rank_col, F.coalesce(F.col("_off"), F.lit(0)) + part + F.lit(1)))
    if group:
        gc = group_rank_col or f"{rank_col}_in_group"
        # rows before each group = global rank of its first row - 1 (one row per group)
        firsts = out.groupBy(group).agg(F.min(rank_col).alias("_first"))
        out = (join_small(out, firsts, group)
                  .withColumn(gc, F.col(rank_col) - F.col("_first") + F.lit(1))
                  .drop("_first"))
    return out.drop("_m", "_pid", "_off")
