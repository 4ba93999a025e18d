"""Centroid clustering (Lloyd rounds on integers) whose nearest centroids are found by Orchard's search.

* Components become integers ``floor(scale * x)``; all distances, sums and means are exact.
* Every centroid has a list of the other centroids by distance (ties: smaller number).  A vector starts at
  a guess and walks that centroid's list.  A closer centroid, or an equally near one of smaller number, is
  jumped to at once and its list is walked from the front; centroids seen before are marked and not
  measured again.  The walk stops at the first entry strictly beyond twice the current distance: by the
  triangle inequality that entry and all after it are farther than the current centroid.  An entry at
  exactly twice the distance may tie, so it is still looked at.
* The guess is the nearest centroid by the ``GUESS`` components in which the centroids differ most.
* A round is one pass: a task adds up its vectors by cluster and sends the sums as 24-bit digits
  (cluster, component, digit, sum), so that Spark adds them exactly in longs however large they get.
  The driver sees k centroids, no vectors.

Edge cases: vectors that are null, of another length, or hold a null or non-finite component are left out;
rows that share an id are rows of their own; a null id hashes as the text ``null``; equal hashes are
ordered by vector; fewer vectors than k give as many centroids; an empty table gives no row; a distance
or inertia that a long cannot hold is null (the assignment is still exact); other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attriscope.llm.common import stored, table
from attriscope.llm.vectors import Vectors

K, ROUNDS, SCALE, DIM, SEED = 16, 3, 64, 64, 1
GUESS = 8
DIGIT = 24


def integers(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(floor(scale * x), rows small enough for 64-bit arithmetic); the other rows hold zeros."""
    y = np.floor(x * scale) if x.size else x
    limit = 2.0 ** ((60 - math.ceil(math.log2(max(2, x.shape[1])))) // 2 - 1)
    small = (np.abs(y) < limit).all(axis=1)
    return np.where(small[:, None], y, 0).astype(np.int64), small


def big_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers, for any finite x."""
    out = np.empty(x.shape, object)
    for at, v in np.ndenumerate(x):
        v = float(v)
        out[at] = math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale
    return out


class Orchard:
    """Nearest of the centroids ``c`` (integers), by Orchard's lists."""

    def __init__(self, c: list[list[int]]):
        self.c = np.array(c, object).reshape(len(c), -1)
        self.k = len(c)
        gap = [[sum((p - q) ** 2 for p, q in zip(a, b)) for b in c] for a in c]
        near = [sorted((b for b in range(self.k) if b != a), key=lambda b, a=a: (gap[a][b], b)) for a in range(self.k)]
        self.near = np.array(near, np.int64).reshape(self.k, self.k - 1)
        self.gap = np.array(gap, object).reshape(self.k, self.k)
        span = [max(col) - min(col) for col in self.c.T]
        self.parts = np.array(sorted(range(len(span)), key=lambda i: -span[i])[:GUESS], np.int64)
        limit = 2 ** ((60 - math.ceil(math.log2(max(2, self.c.shape[1])))) // 2 - 1)
        self.small = all(abs(v) < limit for row in c for v in row)
        if self.small:
            self.c, self.gap = self.c.astype(np.int64), self.gap.astype(np.int64)

    def guess(self, x: np.ndarray) -> np.ndarray:
        if x.dtype == object:  # may be past any double: all start at the first centroid
            return np.zeros(len(x), np.int64)
        a, b = x[:, self.parts].astype(float), self.c[:, self.parts].astype(float)
        return ((a[:, None, :] - b[None]) ** 2).sum(axis=2).argmin(axis=1)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, squared distance, distances measured) of each row of ``x`` (64-bit only if ``small`` holds, else objects)."""
        c, gap = (self.c, self.gap) if x.dtype != object else (self.c.astype(object), self.gap.astype(object))
        n = len(x)
        best = self.guess(x) if n else np.zeros(0, np.int64)
        dist = ((x - c[best]) ** 2).sum(axis=1)
        seen = np.zeros((n, self.k), bool)
        seen[np.arange(n), best] = True
        at, live = np.zeros(n, np.int64), np.arange(n if self.k > 1 else 0)
        while len(live):
            following = self.near[best[live], at[live]]
            on = np.asarray(gap[best[live], following] <= 4 * dist[live], bool)
            live, following = live[on], following[on]
            at[live] += 1
            fresh = ~seen[live, following]
            row, cand = live[fresh], following[fresh]
            d = ((x[row] - c[cand]) ** 2).sum(axis=1)
            seen[row, cand] = True
            closer = np.asarray((d < dist[row]) | ((d == dist[row]) & (cand < best[row])), bool)
            row, cand = row[closer], cand[closer]
            best[row], dist[row], at[row] = cand, d[closer], 0
            live = live[at[live] < self.k - 1]
        return best, dist, seen.sum(axis=1)


def assign(x: np.ndarray, lists: Orchard, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, integers, centroid, squared distance, distances measured), 64-bit rows first, then the others."""
    y, small = integers(x, scale)
    small &= lists.small
    rows = np.flatnonzero(small)
    if len(rows):
        yield rows, y[rows], *lists.search(y[rows])
    rows = np.flatnonzero(~small)
    if len(rows):
        big = big_integers(x[rows], scale)
        yield rows, big, *lists.search(big)


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec): vectors with exactly ``dim`` components, none null or non-finite, as doubles."""
    v = F.col("vec")
    src = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return src.where((F.size(v) == dim) & ~bad)


def first_centroids(rows: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest hashes, in the order of their hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    top = rows.select(key.alias("key"), "vec").orderBy("key", "vec").limit(k).collect()
    return big_integers(np.array([r["vec"] for r in top], float), scale).tolist()


def moved_centroids(rows: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """One round: floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    k, dim = len(centroids), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, total, count = Orchard(centroids), np.zeros((k, dim), object), [0] * k
        for batch in batches:
            v = Vectors(batch.column(0))
            for _, y, best, _, _ in assign(v.matrix(np.arange(batch.num_rows)), lists, scale):
                for c in np.unique(best).tolist():
                    total[c] += y[best == c].sum(axis=0).astype(object)
                    count[c] += int((best == c).sum())
        out = [(c, -1, 0, count[c]) for c in range(k) if count[c]]
        for (c, i), s in np.ndenumerate(total):
            sign, left, digit = (-1 if s < 0 else 1), abs(int(s)), 0
            while left:
                out.append((c, i, digit, sign * (left & ((1 << DIGIT) - 1))))
                left, digit = left >> DIGIT, digit + 1
        columns = list(zip(*out)) if out else [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["cluster", "part", "digit", "s"])

    sent = rows.select("vec").mapInArrow(sums, "cluster int, part int, digit int, s long")
    total, count = [[0] * dim for _ in range(k)], [0] * k
    for c, part, digit, s in sent.groupBy("cluster", "part", "digit").agg(F.sum("s")).collect():  # k x dim x digits rows at most
        if part < 0:
            count[c] = s
        else:
            total[c][part] += s << (DIGIT * digit)
    return [[t // count[c] for t in total[c]] if count[c] else centroids[c] for c in range(k)]


def clusters(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS,
    scale: int = SCALE, dim: int = DIM, seed: int = SEED,
) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance, n_measured) for each usable vector, final centroids).

    ``n_measured``: centroids whose distance the last search computed (k without pruning).
    """
    rows = stored(usable(vectors, id_col, vec_col, dim), "vectors")
    centroids = first_centroids(rows, k, seed, scale)
    if not centroids:
        fields = "cluster int, distance long, n_measured int"
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (f.split() for f in fields.split(", "))]
        return rows.where("false").select("id", *none), []
    for _ in range(rounds):
        centroids = moved_centroids(rows, centroids, scale)
    added = [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("n_measured", T.IntegerType())]
    final = centroids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Orchard(final)
        for batch in batches:
            n = batch.num_rows
            cluster, steps, dist = np.zeros(n, np.int32), np.zeros(n, np.int32), [None] * n
            for at, _, best, d, measured in assign(Vectors(batch.column(1)).matrix(np.arange(n)), lists, scale):
                cluster[at], steps[at] = best, measured
                for i, v in zip(at.tolist(), d.tolist()):
                    dist[i] = v if v < 1 << 63 else None
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster), pa.array(dist, pa.int64()), pa.array(steps)], names=["id", "cluster", "distance", "n_measured"])

    return rows.select("id", "vec").mapInArrow(place, T.StructType([rows.schema["id"], *added])), centroids


def op12_orchard_clusters(spark, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components, 16 centroids, 3 rounds."""
    placed, centroids = clusters(table(spark, sf_dir, "embeddings"))
    placed = stored(placed, "placed")
    exact = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r[0]: r[1] for r in placed.groupBy("cluster").agg(exact).collect()}  # one row for each centroid
    whole = None if None in sums.values() else sum(map(int, sums.values()))
    fit = lambda v: int(v) if v is not None and v < 1 << 63 else None
    rows = [
        (c, fit(sums.get(c)), fit(whole), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest())
        for c, v in enumerate(centroids)
    ]
    notes = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = placed.join(F.broadcast(notes), "cluster")  # one row for each centroid
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    near = """SELECT vec_id, v, CAST(m % 1000 AS INT) AS cluster, CAST(m // 1000 AS BIGINT) AS distance FROM (
  SELECT vec_id, ANY_VALUE(v) AS v, MIN(1000 * CAST(list_sum(list_transform(list_zip(v, cv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) + cluster) AS m
  FROM (SELECT k.rn, k.vec_id, k.v, c.cluster, c.v AS cv FROM kept k, {c} c) GROUP BY rn, vec_id)"""
    ctes = [f"""kept AS MATERIALIZED (
SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})""",
            f"""c0 AS MATERIALIZED (
SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS INT) AS cluster, v FROM kept
QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) <= {K})"""]
    for r in range(1, ROUNDS + 1):
        ctes.append(f"a{r} AS MATERIALIZED ({near.format(c=f'c{r - 1}')})")
        ctes.append(f"""c{r} AS MATERIALIZED (
SELECT cluster, list(q ORDER BY i) AS v FROM (
  SELECT cluster, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS q
  FROM (SELECT cluster, i, CAST(SUM(v[i]) AS HUGEINT) AS s, COUNT(*) AS n FROM a{r}, range(1, {DIM + 1}) t(i) GROUP BY cluster, i)) GROUP BY cluster
UNION ALL SELECT cluster, v FROM c{r - 1} WHERE cluster NOT IN (SELECT cluster FROM a{r}))""")
    ctes.append(f"f AS MATERIALIZED ({near.format(c=f'c{ROUNDS}')})")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT f.vec_id, f.cluster, f.distance,
  CAST(SUM(f.distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia, CAST(SUM(f.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM f JOIN c{ROUNDS} c ON f.cluster = c.cluster"""


OP12_SQL = _sql()
