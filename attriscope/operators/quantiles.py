"""Exact quantiles without gathering a group in one task.

Spark's exact ``percentile`` keeps a value->count map per group in one task,
which does not survive a high-cardinality column at scale; ``percentile_approx``
is not exact.  This operator finds exact order statistics by distributed
selection:

1. one aggregate gives ``n``, ``min`` and ``max`` per group;
2. while a target's candidate range holds more than one distinct value, one
   aggregate pass counts the values of the range in ``buckets`` equal-width
   buckets (with each bucket's min / max; infinities have buckets of their
   own); the bucket that holds the wanted rank becomes the new range.

Each pass is a partial (map-side) aggregation with a bounded result
(targets x buckets rows).  Quantiles interpolate linearly between the order
statistics at ``floor`` and ``ceil`` of ``q * (n - 1)``, as ``percentile`` /
``quantile_cont`` / pandas do.  NaN is treated as null.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attriscope.operators.common import join_small
from attriscope.session import materialize

BUCKETS = 4096


def _clean(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    v = F.col(value).cast("double")
    return (df.select(*[F.col(b) for b in by], v.alias("_v"))
              .where(F.col("_v").isNotNull() & ~F.isnan("_v")))


def order_statistics(df: DataFrame, value: str, ranks_fn, by: list[str] | None = None,
                     buckets: int = BUCKETS) -> dict:
    """Exact order statistics per group.

    ``ranks_fn(n) -> iterable of 0-based ranks`` gives the ranks wanted for a
    group of ``n`` values.  Returns ``{group_tuple: {"n": n, "values": {rank: v}}}``.
    """
    grouped = bool(by)
    by = list(by) if grouped else ["_g"]
    if not grouped:
        df = df.withColumn("_g", F.lit(0))
    data = _clean(df, value, by)
    stats = data.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()

    # target state: group, rank -> [lo, hi, below] ; answer in [lo, hi], `below` values < lo
    state = {}
    result = {}
    for r in stats:
        g = tuple(r[b] for b in by)
        n = r["n"]
        result[g] = {"n": n, "values": {}}
        for k in sorted(set(int(x) for x in ranks_fn(n))):
            state[(g, k)] = [r["lo"], r["hi"], 0, n]  # lo, hi, below, count in [lo,hi]

    spark = df.sparkSession
    key_schema = ", ".join(f"_k{i} {data.schema[b].dataType.simpleString()}" for i, b in enumerate(by))

    def _targets_df(items):
        rows = [tuple(g) + (tid, lo, hi) for tid, (g, lo, hi) in items]
        schema = key_schema + ", _tid int, _lo double, _hi double"
        return spark.createDataFrame(rows, schema)

    same = None  # null is a group of its own
    for i in range(len(by)):
        eq = F.col(by[i]).eqNullSafe(F.col(f"_k{i}"))
        same = eq if same is None else same & eq

    while True:
        open_targets = {t: s for t, s in state.items() if s[0] != s[1]}
        if not open_targets:
            break
        # distinct ranges still to split (targets of one group often share one)
        ranges = {}
        for (g, k), (lo, hi, below, cnt) in open_targets.items():
            ranges.setdefault((g, lo, hi), []).append(k)
        items = list(enumerate((g, lo, hi) for (g, lo, hi) in ranges))
        tdf = _targets_df(items)  # bounded: one row per open range
        # halves, so that the width of a finite range cannot overflow; infinite ends count as the largest double
        big = F.lit(1.7976931348623157e308)
        lo, hi = F.greatest("_lo", -big), F.least("_hi", big)
        share = (F.col("_v") / 2 - lo / 2) / (hi / 2 - lo / 2)
        inner = F.least(F.floor(share * F.lit(float(buckets))).cast("int"), F.lit(buckets - 1))
        # a range too narrow to divide: its lowest value against the rest
        inner = F.when(hi / 2 - lo / 2 > 0, inner).otherwise(F.lit(0))
        b = (F.when(F.col("_v") == F.lit(float("-inf")), F.lit(-2)).when(F.col("_v") == F.lit(float("inf")), F.lit(buckets))
              .when(F.col("_v") == F.col("_lo"), F.lit(-1)).otherwise(inner))
        joined = data.join(F.broadcast(tdf), on=same, how="inner")
        hist = (joined.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
                      .groupBy("_tid", b.alias("_b"))
                      .agg(F.count("*").alias("c"), F.min("_v").alias("mn"), F.max("_v").alias("mx"))
                      .collect())
        per = {}
        for r in hist:
            per.setdefault(r["_tid"], []).append((r["_b"], r["c"], r["mn"], r["mx"]))
        for tid, (g, lo, hi) in items:
            bins = sorted(per.get(tid, []))
            for k in ranges[(g, lo, hi)]:
                s = state[(g, k)]
                off = k - s[2]
                acc = 0
                for _b, c, mn, mx in bins:
                    if off < acc + c:
                        state[(g, k)] = [mn, mx, s[2] + acc, c]
                        break
                    acc += c

    for (g, k), (lo, hi, below, cnt) in state.items():
        result[g]["values"][k] = lo
    if not grouped:
        result = {(): v for v in result.values()}
    return result


def exact_quantiles(df: DataFrame, value: str, qs, by: list[str] | None = None, **kw) -> dict:
    """``{group_tuple: {q: value}}`` with linear interpolation (``percentile`` semantics)."""
    qs = list(qs)

    def ranks(n):
        out = []
        for q in qs:
            pos = q * (n - 1)
            out += [math.floor(pos), math.ceil(pos)]
        return out

    stats = order_statistics(df, value, ranks, by, **kw)
    res = {}
    for g, st in stats.items():
        n, vals = st["n"], st["values"]
        res[g] = {}
        for q in qs:
            pos = q * (n - 1)
            lo, hi = math.floor(pos), math.ceil(pos)
            a, b = vals[lo], vals[hi]
            res[g][q] = a if lo == hi else (hi - pos) * a + (pos - lo) * b
    return res


def exact_quantile_frame(df: DataFrame, value: str, qs, by: list[str] | None = None,
                         names: list[str] | None = None, **kw) -> DataFrame:
    """Same as :func:`exact_quantiles` as a DataFrame (one row per group).

    Up to ``DRIVER_GROUPS`` groups the ranges are held by the driver; above that they are a table, see
    :func:`quantile_table`.  Both are exact.
    """
    by = list(by or [])
    qs = list(qs)
    names = names or [f"q{int(round(q * 100))}" for q in qs]
    if by and _clean(df, value, by).select(*by).distinct().limit(DRIVER_GROUPS + 1).count() > DRIVER_GROUPS:
        return quantile_table(df, value, qs, by, names).drop("n")
    res = exact_quantiles(df, value, qs, by, **kw)
    spark = df.sparkSession
    schema_by = [f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by]
    schema = ", ".join(schema_by + [f"`{n}` double" for n in names])
    rows = [tuple(g) + tuple(res[g][q] for q in qs) for g in res]
    return spark.createDataFrame(rows, schema)


DRIVER_GROUPS = 10_000
TABLE_BUCKETS = 64


def quantile_table(df: DataFrame, value: str, qs: list[float], by: list[str], names: list[str] | None = None) -> DataFrame:
    """(by, n, one column for each quantile) for any number of groups, exact, with the selection's state as a table.

    A row of the state is a wanted rank of a group and the range [lo, hi] that holds it.  A pass joins the open ranges to
    the values, counts them in ``TABLE_BUCKETS`` buckets of each range (a partial aggregate, so a hot group is never
    gathered), and a running sum over a range's buckets finds the one with the rank.  It ends when every range is one
    value.  The driver sees one count a pass.
    """
    names = names or [f"q{int(round(q * 100))}" for q in qs]
    keys = [f"_k{i}" for i in range(len(by))]
    data = _clean(df, value, by).select(*[F.col(b).alias(k) for b, k in zip(by, keys)], "_v")
    stats = materialize(data.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "groups")
    places = [F.lit(q) * (F.col("n") - 1) for q in qs]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))
    state = stats.select(*keys, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"))
    done, state = state.where("lo = hi").select(*keys, "rank", "lo"), materialize(state.where("lo <> hi"), "ranges")

    def same(other: str, columns: list[str]):  # null is a group of its own
        cond = F.lit(True)
        for c in columns:
            cond = cond & F.col(c).eqNullSafe(F.col(f"{other}{c}"))
        return cond

    # halves, as in order_statistics: the width of a finite range cannot overflow
    big = F.lit(1.7976931348623157e308)
    lo, hi = F.greatest("lo", -big), F.least("hi", big)
    wide = hi / 2 - lo / 2
    inner = F.when(wide > 0, F.least(F.floor((F.col("_v") / 2 - lo / 2) / wide * F.lit(float(TABLE_BUCKETS))).cast("int"), F.lit(TABLE_BUCKETS - 1)))
    bucket = (F.when(F.col("_v") == F.lit(float("-inf")), F.lit(-2)).when(F.col("_v") == F.lit(float("inf")), F.lit(TABLE_BUCKETS))
              .when(F.col("_v") == F.col("lo"), F.lit(-1)).otherwise(F.coalesce(inner, F.lit(0))))
    while state.limit(1).count():
        ranges = state.select(*[F.col(k).alias(f"_r{k}") for k in keys], "lo", "hi").distinct()
        here = same("_r", keys) & (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
        hist = join_small(data, ranges, here).groupBy(*keys, "lo", "hi", bucket.alias("b")).agg(
            F.count("*").alias("c"), F.min("_v").alias("mn"), F.max("_v").alias("mx"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("b"))  # TABLE_BUCKETS + 3 rows at most
        hist = hist.select(*[F.col(c).alias(f"_h{c}") for c in (*keys, "lo", "hi")], "mn", "mx", (upto - F.col("c")).alias("before"), upto.alias("upto"))
        offset = F.col("rank") - F.col("below")
        found = state.join(hist, same("_h", [*keys, "lo", "hi"]) & (offset >= F.col("before")) & (offset < F.col("upto")))
        state = materialize(found.select(*keys, "rank", F.col("mn").alias("lo"), F.col("mx").alias("hi"), (F.col("below") + F.col("before")).alias("below")), "ranges")
        done = done.unionByName(state.where("lo = hi").select(*keys, "rank", "lo"))
        state = state.where("lo <> hi")
    at = F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at")  # two entries for each quantile
    values = done.groupBy(*keys).agg(at).select(*[F.col(k).alias(f"_w{k}") for k in keys], "at")
    out = stats.join(values, same("_w", keys)).select(*[F.col(k).alias(b) for k, b in zip(keys, by)], "n", "at")

    def quantile(place):
        low, high = F.floor(place), F.ceil(place)
        a, b = F.col("at")[low.cast("long")], F.col("at")[high.cast("long")]
        return F.when(low == high, a).otherwise((high - place) * a + (place - low) * b)

    return out.select(*by, "n", *[quantile(p).alias(c) for p, c in zip(places, names)])


def exact_median(df: DataFrame, value: str) -> float | None:
    res = exact_quantiles(df, value, [0.5])
    return res[()][0.5] if () in res else None
