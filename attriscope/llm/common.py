"""Helpers shared by the operators: table access, row annotation, components, exact top-k threshold."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attriscope.session import ensure_checkpoint_dir, materialize

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def annotate(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[..., Iterable[pa.Array]]],
    keep: list[str],
    chunk_bytes: int = 8 << 20,
    holds: bool = False,
) -> DataFrame:
    """Columns ``keep`` plus ``fields`` computed from the ``inputs`` columns, row by row, in Arrow batches.

    ``make()`` is called once in a task (to load a model) and returns a function
    of the input arrays that gives one array for each field.  Batches are cut
    to about ``chunk_bytes`` of input, so a task's memory does not depend on
    how long the texts are (one text is the least unit).  A name in ``fields`` replaces a kept column of that name.
    ``holds`` says that ``make`` gets its model from :func:`held`.
    """
    names = {f.name for f in fields}
    kept = [c for c in keep if c not in names]
    tmp = {c: f"__in{i}" for i, c in enumerate(inputs)}
    src = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(a) for c, a in tmp.items()])
    schema = T.StructType([src.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            let_go()
        fn = make()
        for batch in batches:
            rows = max(1, batch.num_rows)
            step = max(1, min(rows, int(rows * chunk_bytes / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n = len(kept)
                arrays = [part.column(i) for i in range(n)]
                made = list(fn(*[part.column(n + i) for i in range(len(inputs))]))
                yield pa.RecordBatch.from_arrays(arrays + made, names=[f.name for f in schema.fields])
            pa.default_memory_pool().release_unused()  # a worker lives on between tasks

    small_batches(df.sparkSession)
    return src.mapInArrow(run, schema)


_HELD: dict = {}


def held(key, make: Callable):
    """``make()``, made once in a worker and kept for its next tasks with this key; what other tasks kept goes first."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Free what tasks of another kind left in this worker: it lives on, and its memory would count in every later stage."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` rows where the session has more: rows here are whole texts, not numbers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def parts_of(texts: list[str], chars: int = 1 << 19) -> Iterator[slice]:
    """Slices of about ``chars`` characters each (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def texts_of(array: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [t or "" for t in array.to_pylist()]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the graph ``edges(a, b)``: the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then
    jumps to that label's own label, so the number of rounds grows with the
    logarithm of a component's diameter.  Neighbour minima are partial
    aggregates, so a hub's edges are never gathered.  Every round is a
    checkpoint in the shared folder.  Nodes without an edge are not returned.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.where("a <> b").distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = labels.checkpoint()
    for _ in range(max_rounds):
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("n"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, labels["node"] == near["n"]).select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("next"))
        new = step.join(jump, "to").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved"))
        new = new.checkpoint()
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def kth_largest(values: DataFrame, k: int, column: str = "score", fan: int = 4096) -> float:
    """The exact k-th largest finite double of ``column`` (1 <= k <= rows).

    The value range is halved ``fan``-fold a pass: each pass is one partial
    aggregate over the table with at most ``fan`` rows of result, and stops
    when one value is left.  Nothing is gathered.
    """
    c = F.col(column)
    lo, hi = values.agg(F.min(c), F.max(c)).first()
    left = k
    while lo < hi:
        width = (hi - lo) / fan
        if not width > 0 or lo + width == lo:
            width = max(math.ulp(lo), math.ulp(hi))
        cell = F.least(F.floor((c - F.lit(lo)) / F.lit(width)), F.lit(fan - 1))
        rows = (
            values.where((c >= lo) & (c <= hi))
            .groupBy(cell.alias("cell"))
            .agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"))
            .collect()
        )
        for r in sorted(rows, key=lambda r: -r["cell"]):
            if r["n"] >= left:
                lo, hi = r["lo"], r["hi"]
                break
            left -= r["n"]
    return lo


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back (lineage cut, survives lost executors)."""
    return materialize(df, name)
