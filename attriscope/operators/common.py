"""Small shared helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def scalar_row(df: DataFrame, *aggs) -> Row:
    """One global aggregate row (partial aggregation, one result row to the driver)."""
    return df.agg(*aggs).collect()[0]


def round_cols(df: DataFrame, spec: dict[str, int], even: bool = False) -> DataFrame:
    """Round the named double columns (half-up, or half-even with ``even``)."""
    fn = F.bround if even else F.round
    return df.withColumns({c: fn(F.col(c), d) for c, d in spec.items()})


def known_keys(df: DataFrame, *keys: str) -> DataFrame:
    """pandas group-bys drop null keys; Spark keeps them, so filter first."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond)


BROADCAST_MAX_BYTES = 256 << 20


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row, from its types and the first row's texts and arrays (with room for longer ones)."""
    first = df.limit(1).collect()
    variable = sum(4 * 8 * len(v) for v in (first[0] if first else []) if isinstance(v, (str, bytes, list)))
    return 16 * len(df.columns) + variable


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Join a per-group result back onto rows.

    ``small`` is counted first (an aggregate, one row per group); under
    ``max_bytes`` (rows times :func:`row_bytes`) it is broadcast, so a hot group never meets a shuffle.  Above
    the bound the join is left to a shuffle join, where AQE's skew handling
    splits hot partitions.
    """
    side = F.broadcast(small) if small.count() * row_bytes(small) <= max_bytes else small
    return big.join(side, on, how)


HOT_ROWS = 10_000


def split_hot_join(big: DataFrame, small: DataFrame, keys: list[str], hot, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Inner join where a few keys of ``big`` are hot.

    ``hot`` flags the ``small`` rows whose key is hot (e.g. a group count
    above a threshold).  Those rows are few: they are broadcast, so the hot
    keys' rows of ``big`` are never shuffled by key; the remaining keys use a
    shuffle join.  (If the flagged rows exceed ``max_bytes``, AQE's skew
    splitting is left to handle them.)
    """
    hot_small = small.where(hot)
    cold_small = small.where(~hot)
    if hot_small.count() * row_bytes(small) > max_bytes:
        return big.join(small, keys)
    hot_keys = hot_small.select(*keys).distinct()
    part_hot = big.join(F.broadcast(hot_small), keys)
    part_cold = big.join(F.broadcast(hot_keys), keys, "left_anti").join(cold_small, keys)
    return part_hot.unionByName(part_cold)
