"""Embedding near-duplicates by a dual traversal of a cover tree, exact at a cosine threshold.

On unit vectors, cosine >= c means a distance of at most r = sqrt(2 - 2c).

* Equal vectors are one point with a multiplicity, so copies form no pairs.
* The tree's upper levels are nested centre sets of halving radius: a
  farthest-first order of a bounded sample, whose prefixes are the levels.
  Every vector goes to its nearest centre of the last level; covering radii are the largest
  distances over all vectors, so bounds hold whatever the sample was.
* The traversal starts with the root against itself and goes down level by
  level; a pair of nodes is kept while distance - both covering radii <= r.
* Leaves are cut into blocks of about ``BLOCK`` vectors.  Each pair of blocks
  that is left is one task group: products in single precision with a margin,
  then the exact cosine in double precision for what is near or over the threshold.
* A group returns link counts and one edge from each linked vector to the
  smallest of its component inside the group, never all pairs.

What is left is what the covering bounds leave.  On vectors without structure,
where all distances are alike, they leave nearly all pairs of blocks.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite
component have no link and are their own component; vectors of different
length do not link; a repeated vec_id is counted as a row of its own; a null
vec_id has component null unless it links; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attriscope.llm.common import annotate, components, stored, table

THRESHOLD = 0.95
SAMPLE = 8192
MAX_LEAVES = 1024
BLOCK = 4096
MARGIN = 1e-4


def points(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim, node): vec holds the components as little-endian doubles, null if the vector cannot link."""

    def make():
        def run(array: pa.Array):
            out = []
            for v in array.to_pylist():
                a = np.array([np.nan if x is None else x for x in v], np.float64) if v else np.zeros(0)
                out.append(a.tobytes() if len(a) and np.isfinite(a).all() and a.any() else None)
            yield pa.array(out, pa.binary())
            yield pa.array([None if b is None else len(b) // 8 for b in out], pa.int32())

        return run

    src = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    fields = [T.StructField("vec", T.BinaryType()), T.StructField("dim", T.IntegerType())]
    return annotate(src, ["v"], fields, make, ["id"]).withColumn("node", F.md5("vec"))


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows of length 1.  A power of two takes the largest component near 1 first, so no square over- or underflows."""
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def centres(sample: np.ndarray, most: int, least_radius: float) -> tuple[np.ndarray, list[int]]:
    """(centres in farthest-first order, sizes of the nested levels with radius 2, 1, 1/2, ...)."""
    picked, levels, radius = [0], [], 2.0
    far = np.sqrt(np.maximum(0, 2 - 2 * sample @ sample[0]))
    while True:
        at = int(far.argmax())
        while radius >= least_radius and far[at] <= radius:
            levels.append(len(picked))
            radius /= 2
        if len(picked) >= most or far[at] <= least_radius or radius < least_radius:
            break
        picked.append(at)
        far = np.minimum(far, np.sqrt(np.maximum(0, 2 - 2 * sample @ sample[at])))
    if not levels or levels[-1] < len(picked):
        levels.append(len(picked))
    return sample[picked], levels


def traverse(c: np.ndarray, levels: list[int], parent: list[np.ndarray], cover: list[np.ndarray], r: float) -> list[tuple[int, int]]:
    """Pairs of leaves (a <= b) that the covering radii do not rule out, from the root pair downwards."""
    pairs = np.array([(a, b) for a in range(levels[0]) for b in range(a, levels[0])])
    for k in range(1, len(levels)):
        kids = [np.flatnonzero(parent[k] == a) for a in range(levels[k - 1])]
        grown = []
        for a, b in pairs:
            x, y = np.meshgrid(kids[a], kids[b], indexing="ij")
            grown.append(np.stack([np.minimum(x, y).ravel(), np.maximum(x, y).ravel()], axis=1))
        cand = np.unique(np.concatenate(grown), axis=0)
        gap = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", c[cand[:, 0]], c[cand[:, 1]])))
        pairs = cand[(gap - cover[k][cand[:, 0]] - cover[k][cand[:, 1]] <= r + 1e-9) | (cand[:, 0] == cand[:, 1])]
    return [tuple(p) for p in pairs.tolist()]


def block_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool):
    """(i, j) with cosine >= threshold in double precision, in row chunks; ``same``: i < j only."""
    a4, b4 = a.astype(np.float32), b.astype(np.float32)
    for at in range(0, len(a), 512):
        i, j = np.nonzero(a4[at : at + 512] @ b4.T >= np.float32(threshold - MARGIN))
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            hit = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            yield x[hit], y[hit]


def near_pairs(classes: DataFrame, dim: int, count: int, threshold: float) -> DataFrame:
    """(a, b, w): edges between nodes with w null, and link counts (a, null, w) to be summed.

    ``classes(node, vec, n)`` are distinct vectors of one length, ``count`` of them.
    """
    spark = classes.sparkSession
    r = float(np.sqrt(2 - 2 * threshold))
    leaves = max(1, min(MAX_LEAVES, count // BLOCK))
    some = [bytes(x["vec"]) for x in classes.orderBy("node").limit(SAMPLE).select("vec").collect()]
    c, levels = centres(unit(some), leaves, r / 2)
    shared = spark.sparkContext.broadcast(c)  # at most MAX_LEAVES vectors

    def make():
        def place(vec: pa.Array):
            x = unit(vec.to_pylist()) if len(vec) else np.zeros((0, dim))
            leaf, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
            for at in range(0, len(x), 1024):
                dot = x[at : at + 1024] @ shared.value.T
                leaf[at : at + 1024] = dot.argmax(axis=1)
                dist[at : at + 1024] = np.sqrt(np.maximum(0, 2 - 2 * dot.max(axis=1)))
            yield pa.array(leaf, pa.int64())
            yield pa.array(dist, pa.float64())

        return place

    fields = [T.StructField("leaf", T.LongType()), T.StructField("dist", T.DoubleType())]
    placed = stored(annotate(classes, ["vec"], fields, make, ["node", "vec", "n"]), "leaves")
    stats = {x["leaf"]: (x["r"], x["n"]) for x in placed.groupBy("leaf").agg(F.max("dist").alias("r"), F.count("*").alias("n")).collect()}
    radius = [stats.get(i, (0.0, 0))[0] for i in range(len(c))]
    parent, cover = _tree(c, levels, np.array(radius))
    pairs = [(a, b) for a, b in traverse(c, levels, parent, cover, r) if a in stats and b in stats]

    chunks = {i: -(-n // BLOCK) for i, (_, n) in stats.items()}
    partners: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in pairs:
        partners.setdefault(a, []).append((a, b, 0))
        if a != b:
            partners.setdefault(b, []).append((a, b, 1))
    rows = [(i, chunks[i], [(a, b, s, chunks[b if s == 0 else a]) for a, b, s in v]) for i, v in partners.items()]
    plan = spark.createDataFrame(rows, "leaf long, chunks int, to array<struct<a:long,b:long,side:int,others:int>>")
    own = F.pmod(F.xxhash64("node"), "chunks").cast("int")
    # a block pair is (a, chunk of a, b, chunk of b); inside one leaf, a row goes to chunk pairs (x <= y)
    sent = (
        placed.join(F.broadcast(plan), "leaf")
        .select("node", "vec", "n", own.alias("own"), F.explode("to").alias("t"))
        .select("node", "vec", "n", "own", "t.*")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        .withColumn("x", F.when(F.col("a") == F.col("b"), F.least("own", "other")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")))
        .withColumn("y", F.when(F.col("a") == F.col("b"), F.greatest("own", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")))
        .withColumn("side", F.when(F.col("a") == F.col("b"), (F.col("own") != F.col("x")).cast("int")).otherwise(F.col("side")))
    )

    def match(group: pa.Table) -> pa.Table:
        side, n = group.column("side").to_numpy(), group.column("n").to_numpy()
        vec, node = unit(group.column("vec").to_pylist()), np.array(group.column("node").to_pylist())
        ia, ib = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(ib) and group.column("a")[0] == group.column("b")[0] and group.column("x")[0] == group.column("y")[0]
        if same:
            ib = ia
        weight, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for i, j in block_links(vec[ia], vec[ib], threshold, same):
            i, j = ia[i], ib[j]
            np.add.at(weight, i, n[j])
            np.add.at(weight, j, n[i])
            while len(i):  # labels of the pairs' components inside this group
                low = np.minimum(label[i], label[j])
                before = label.copy()
                np.minimum.at(label, label[i], low)
                np.minimum.at(label, label[j], low)
                label = label[label]
                if (before == label).all():
                    break
        while (label[label] != label).any():
            label = label[label]
        hit = np.flatnonzero(weight)
        edge = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({
            "a": pa.array([*node[hit], *node[edge]], pa.string()),
            "b": pa.array([*[None] * len(hit), *node[label[edge]]], pa.string()),
            "w": pa.array([*weight[hit].tolist(), *[None] * len(edge)], pa.int64()),
        })

    return sent.select("node", "vec", "n", "a", "b", "x", "y", "side").groupBy("a", "x", "b", "y").applyInArrow(match, "a string, b string, w long")


def _tree(c: np.ndarray, levels: list[int], radius: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(parents, covering radii) by level.  A node covers its children's covers; the first child is the node itself."""
    parent = [np.zeros(levels[0], np.int64)]
    for k in range(1, len(levels)):
        up = (c[: levels[k]] @ c[: levels[k - 1]].T).argmax(axis=1)
        up[: levels[k - 1]] = np.arange(levels[k - 1])
        parent.append(up)
    cover = [np.zeros(0)] * len(levels)
    cover[-1] = radius
    for k in range(len(levels) - 1, 0, -1):
        gap = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", c[: levels[k]], c[parent[k]])))
        cover[k - 1] = np.zeros(levels[k - 1])
        np.maximum.at(cover[k - 1], parent[k], gap + cover[k][: levels[k]])
    return parent, cover


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``vectors``: id, n_links, component_id, kept."""
    rows = stored(points(vectors, id_col, vec_col), "vectors")
    live = rows.where("vec IS NOT NULL")
    classes = stored(live.groupBy("node", "vec", "dim").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    found = None
    for x in classes.groupBy("dim").count().orderBy("dim").collect():  # one row for each vector length
        part = near_pairs(classes.where(F.col("dim") == x["dim"]).select("node", "vec", "n"), x["dim"], x["count"], threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "a string, b string, w long")
    found = stored(found, "links")
    comp = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w"))
    named = (
        classes.select("node", "least", "n")
        .join(comp.withColumnRenamed("component", "c"), "node", "left")
        .withColumn("c", F.coalesce("c", "node"))
        .join(links, "node", "left")
    )
    smallest = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "c").select("node", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "node").join(named, "node", "left")
    comp_id = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        comp_id.alias("component_id"),
        F.col("id").eqNullSafe(comp_id).alias("kept"),
    )


def op2_cover_tree(spark, sf_dir: str) -> DataFrame:
    """All embeddings, cosine 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
