"""Nearest neighbours by inner product over an inverted multi-index, exact.

* **Index.**  Vectors are cut into two halves; each half has its own codebook, fitted on a bounded sample (at
  most ``SAMPLE`` vectors and ``SAMPLE_BYTES``), and every row is indexed: its cell is the pair of its halves'
  nearest codes.  The codebooks grow with the square root of the rows, to ``MAX_CODES`` at most.  A code's
  radius is the largest distance of any row's half from it.
* **Traversal.**  For a query half q and code u with radius r, no half x of the code has a product above
  q.u + |q| r.  A query takes code pairs by the largest sum of the two halves' bounds, with a heap over the
  two sorted lists (a pair's followers enter when it leaves).
* **Two passes.**  First every query takes cells until they hold ``PROBE`` vectors; reranking those gives a
  20th best score.  Then it goes on from there down to the last cell whose bound reaches that score.  The
  rest cannot hold a better vector, so the result is exact (recall 1) whatever the sample was.
* **Reranking.**  Cells are laid out in blocks of about ``BLOCK`` vectors (a larger cell is split).  A block and up to
  about ``QUERIES`` of the queries that want it are one task group: products of a cell with its queries are
  a matrix product, those that may enter are computed again on the vectors, row by row in one order, so
  copies have equal scores.
* Equal vectors are one entry with the 21 smallest of their ids: no more can enter a result.

What the bounds leave is what the data's structure leaves; unrelated vectors of equal length have all bounds alike, and
then a query meets nearly all blocks.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part; vectors
of different length are not compared; rows that share an id are rows of their own, and each finds the others;
a null id is no query and, as a candidate, comes after equal scores; a product that is no number in double
precision comes last; an empty table gives no row; other columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attriscope.llm.common import stored, table
from attriscope.llm.vectors import Vectors, unpack
from attriscope.operators.common import join_small

TOP, EVERY = 20, 20
SAMPLE, SAMPLE_BYTES, MAX_CODES, PER_CELL = 16384, 32 << 20, 256, 256
PROBE, BLOCK, QUERIES = 2048, 32768, 1024
TILE = 1024


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(rid, id, vec, dim, node): vec as little-endian doubles, node its digest, rid a number of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = Vectors(batch.column(2))
            rows, vecs = [], []
            for i in np.flatnonzero(v.finite).tolist():
                x = v.values[v.start[i] : v.start[i] + v.length[i]]
                if x.any():
                    rows.append(i)
                    vecs.append((x + 0.0).tobytes())
            at = pa.array(rows, pa.int64())
            dims = pa.array([len(x) // 8 for x in vecs], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(vecs, pa.binary()), dims], names=["rid", "id", "vec", "dim"])

    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    src = src.select(F.monotonically_increasing_id().alias("rid"), "id", "v")
    return src.mapInArrow(run, "rid long, id long, vec binary, dim int").withColumn("node", F.md5("vec"))


def distinct_vectors(rows: DataFrame, top: int) -> DataFrame:
    """(node, vec, dim, ids): ids are the first top + 1 (id, rid) of the equal rows."""
    order = Window.partitionBy("node").orderBy(F.col("id").asc_nulls_last(), "rid")
    first = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("k", "id", "rid"))), lambda x: F.struct(x["id"].alias("id"), x["rid"].alias("rid")))
    return first.groupBy("node").agg(F.first("vec").alias("vec"), F.first("dim").alias("dim"), ids.alias("ids"))


def codebook(x: np.ndarray, codes: int, rounds: int = 10) -> np.ndarray:
    """Lloyd rounds from the first distinct rows of the sample."""
    with np.errstate(all="ignore"):
        c = np.unique(x, axis=0)
        c = c[:: max(1, len(c) // codes)][:codes].copy()
        for _ in range(rounds):
            near = nearest(x, c)
            for k in range(len(c)):
                if (near == k).any():
                    c[k] = x[near == k].mean(axis=0)
        return np.where(np.isfinite(c), c, 0.0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        gap = (c * c).sum(axis=1) - 2 * (x @ c.T)
        return np.where(np.isnan(gap), np.inf, gap).argmin(axis=1)


def lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt((x * x).sum(axis=1))


class Index:
    """Codebooks, radii and cell sizes of the vectors of one length."""

    def __init__(self, dim: int, books: tuple[np.ndarray, np.ndarray]):
        self.dim, self.half, self.books = dim, dim // 2, books
        self.radii = [np.full(len(b), -np.inf) for b in books]
        self.count = np.zeros(len(books[0]) * len(books[1]), np.int64)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance of each half from its code)."""
        a, b = x[:, : self.half], x[:, self.half :]
        i, j = nearest(a, self.books[0]), nearest(b, self.books[1])
        with np.errstate(all="ignore"):
            return i * len(self.books[1]) + j, lengths(a - self.books[0][i]), lengths(b - self.books[1][j])

    def lay_out(self) -> None:
        """Blocks of cells that follow each other; a cell above BLOCK vectors has blocks of its own."""
        self.first, self.chunks = np.zeros(len(self.count), np.int64), np.ones(len(self.count), np.int64)
        block, filled = 0, 0
        for c in np.flatnonzero(self.count).tolist():
            n = int(self.count[c])
            if filled and filled + n > BLOCK:
                block, filled = block + 1, 0
            self.first[c], self.chunks[c] = block, -(-n // BLOCK)
            block, filled = (block + int(self.chunks[c]), 0) if n > BLOCK else (block, filled + n)

    def cells(self, q: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) of the cells that hold vectors, by falling bound."""
        bound = []
        with np.errstate(all="ignore"):
            for part, book, radius in ((q[: self.half], self.books[0], self.radii[0]), (q[self.half :], self.books[1], self.radii[1])):
                size = np.sqrt(part @ part) if len(part) else 0.0
                dot = book @ part
                b = dot + size * radius + 1e-12 * size * (lengths(book) + np.where(radius > 0, radius, 0))
                bound.append(np.where(np.isnan(b), np.inf, b))
        used = [np.flatnonzero(r >= 0) for r in self.radii]  # codes that hold a vector
        o1, o2 = (u[np.argsort(-b[u], kind="stable")] for u, b in zip(used, bound))
        one, two, wide = bound[0][o1].tolist(), bound[1][o2].tolist(), len(bound[1])
        o1, o2 = o1.tolist(), o2.tolist()
        heap = [(-(one[0] + two[0]), 0, 0)]
        while heap:
            low, a, b = heapq.heappop(heap)
            cell = o1[a] * wide + o2[b]
            if self.count[cell]:
                yield -low, cell
            if b + 1 < len(two):
                heapq.heappush(heap, (-(one[a] + two[b + 1]), a, b + 1))
            if b == 0 and a + 1 < len(one):  # each pair enters once
                heapq.heappush(heap, (-(one[a + 1] + two[0]), a + 1, 0))


def build(entries: DataFrame) -> dict[int, Index]:
    """An index for each vector length: codebooks from a sample, radii and cell sizes from all entries."""
    spark = entries.sparkSession
    out = {}
    for r in entries.groupBy("dim").count().collect():  # one row for each vector length
        dim, n = r["dim"], r["count"]
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        of = entries.where(F.col("dim") == dim)
        if n > 2 * most:  # a share by hash, so that few rows reach the sort
            of = of.where(F.pmod(F.xxhash64("node"), F.lit(n)) < 2 * most)
        x = unpack(pa.array([bytes(v["vec"]) for v in of.orderBy("node").limit(most).select("vec").collect()], pa.binary()), dim)
        codes = int(min(MAX_CODES, max(1, np.ceil(np.sqrt(n / PER_CELL)))))
        out[dim] = Index(dim, (codebook(x[:, : dim // 2], codes), codebook(x[:, dim // 2 :], codes)))
    if not out:
        return out
    sent = spark.sparkContext.broadcast({d: (i.books, i.half) for d, i in out.items()})

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {d: Index(d, books) for d, (books, _) in sent.value.items()}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                index = own[d]
                cell, r1, r2 = index.place(unpack(batch.column(1).take(pa.array(np.flatnonzero(dims == d))), d))
                np.add.at(index.count, cell, 1)
                for radius, r, at in ((index.radii[0], r1, cell // len(index.books[1])), (index.radii[1], r2, cell % len(index.books[1]))):
                    np.maximum.at(radius, at, np.where(np.isnan(r), np.inf, r))
        for d, index in own.items():
            for kind, values in enumerate((*index.radii, index.count)):
                at = np.flatnonzero(values > 0 if kind == 2 else values >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * len(at), pa.int32()), pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(values[at].astype(float))], names=["dim", "kind", "at", "v"])

    found = entries.select("dim", "vec").mapInArrow(survey, "dim int, kind int, at long, v double")
    value = F.when(F.col("kind") == 2, F.sum("v")).otherwise(F.max("v"))
    for r in found.groupBy("dim", "kind", "at").agg(value.alias("v")).collect():  # codes and cells: MAX_CODES^2 and a few for each length
        index = out[r["dim"]]
        (index.count if r["kind"] == 2 else index.radii[r["kind"]])[r["at"]] = r["v"]
    for index in out.values():
        index.radii = [r * (1 + 1e-9) for r in index.radii]
        index.lay_out()
    return out


def placed(entries: DataFrame, sent) -> DataFrame:
    """(dim, block, cell, node, vec, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, block, cells = batch.column(0).to_numpy(), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            spread = batch.column(3).to_numpy()
            for d in np.unique(dims).tolist():
                index, at = sent.value[d], np.flatnonzero(dims == d)
                cell = index.place(unpack(batch.column(1).take(pa.array(at)), d))[0]
                cells[at], block[at] = cell, index.first[cell] + spread[at] % index.chunks[cell]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(block), pa.array(cells), batch.column(1), batch.column(2)], names=["dim", "block", "cell", "vec", "ids"])

    src = entries.select("dim", "vec", "ids", F.pmod(F.xxhash64("node"), F.lit(1 << 40)).alias("spread"))
    kind = entries.schema["ids"].dataType.simpleString()
    return src.mapInArrow(run, f"dim int, block long, cell long, vec binary, ids {kind}")


VISIT = "qid long, rid long, dim int, vec binary, tau double, block long, cells array<long>"


def visits(queries: DataFrame, sent, further: bool) -> DataFrame:
    """Blocks and cells of each query (qid, rid, dim, vec, tau): the first PROBE vectors, or ``further`` all after them that may reach tau."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, blocks, lists = [], [], []
            taus = batch.column(4).to_numpy()
            for k, (d, raw) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                index, held, at = sent.value[d], 0, {}
                for bound, cell in index.cells(np.frombuffer(raw, "<f8")):
                    probe = held < PROBE
                    held += int(index.count[cell])
                    if probe == further:
                        if further:
                            continue
                        break
                    if further and bound < taus[k]:
                        break
                    first = int(index.first[cell])
                    for b in range(first, first + int(index.chunks[cell])):
                        at.setdefault(b, []).append(cell)
                rows += [k] * len(at)
                blocks += at.keys()
                lists += at.values()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(take) for i in range(5)), pa.array(blocks, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                names=["qid", "rid", "dim", "vec", "tau", "block", "cells"])

    return queries.select("qid", "rid", "dim", "vec", "tau").mapInArrow(run, VISIT)


def _best(q: np.ndarray, s: np.ndarray, tie: np.ndarray, most: int) -> np.ndarray:
    """Positions of each query's ``most`` best by score (no number last), then tie."""
    order = np.lexsort((tie, -np.where(np.isnan(s), -np.inf, s), np.isnan(s), q))
    first = np.searchsorted(q[order], q[order])
    return order[np.arange(len(order)) - first < most]


def rerank(group: pa.Table, top: int) -> pa.Table:
    """Best candidates of each query of the group within the block's cells it wants."""
    is_query = group.column("cells").is_valid().to_numpy()
    dim = group.column("dim")[0].as_py()
    asks, holds = group.filter(pa.array(is_query)), group.filter(pa.array(~is_query))
    q, e = unpack(asks.column("vec"), dim), unpack(holds.column("vec"), dim)
    lists = asks.column("cells").combine_chunks()
    wanted = np.asarray(lists.flatten())
    who = np.repeat(np.arange(len(q)), np.asarray(lists.value_lengths()))
    cell = holds.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    copies = holds.column("ids").to_pylist()
    big = np.iinfo(np.int64).max
    tie = np.array([c[0]["id"] if c[0]["id"] is not None else big for c in copies], np.int64)
    tau = asks.column("tau").to_numpy().copy()
    sizes, lens = lengths(e), lengths(q)
    pool = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    by_cell = np.argsort(wanted, kind="stable")
    wanted, who = wanted[by_cell], who[by_cell]
    edges = np.flatnonzero(np.diff(wanted, prepend=-1))
    with np.errstate(all="ignore"):
        for c, first, past in zip(wanted[edges], edges, [*edges[1:], len(wanted)]):
            rows, x = order[np.searchsorted(cell, c) : np.searchsorted(cell, c, "right")], who[first:past]
            for s in range(0, len(rows), TILE):
                some = rows[s : s + TILE]
                dots = q[x] @ e[some].T
                slack = 1e-15 * (dim + 8) * lens[x][:, None] * sizes[some][None, :]
                high = np.where(np.isnan(dots), -np.inf, dots) + slack
                high = np.where(np.isnan(high), np.inf, high)
                least = tau[x]
                if len(some) > top + 1:
                    low = np.where(np.isnan(dots), -np.inf, dots) - slack
                    low = np.where(np.isnan(low), -np.inf, low)
                    least = np.maximum(least, np.partition(low, -top - 1, axis=1)[:, -top - 1])
                i, j = np.nonzero(high >= least[:, None])
                i, j = x[i], some[j]
                got = np.concatenate([(q[i[k : k + 65536]] * e[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)] or [np.zeros(0)])
                pool = tuple(np.concatenate([a, b]) for a, b in zip(pool, (i, j, got)))
                if len(pool[0]) > (1 << 18):
                    pool, tau = _settle(pool, tie, tau, top)
        pool, tau = _settle(pool, tie, tau, top)
    out, qid, rid = [], asks.column("qid").to_pylist(), asks.column("rid").to_pylist()
    at = {}
    for k, j, s in zip(*(p.tolist() for p in pool)):
        for one in copies[j]:
            if one["rid"] != rid[k]:
                at.setdefault(k, []).append((s != s, -s if s == s else 0.0, one["id"] is None, one["id"] or 0, one["rid"], s))
    for k, found in at.items():
        found.sort()
        out += [(qid[k], rid[k], None if no_id else i, r, s) for _, _, no_id, i, r, s in found[:top]]
    columns = list(zip(*out)) if out else [()] * 5
    kinds = [pa.int64()] * 4 + [pa.float64()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["qid", "rid", "id", "other", "score"])


def _settle(pool, tie, tau, top):
    """The pool cut to top + 1 vectors a query (one may be its own), and the score that a later one must reach."""
    kept = _best(pool[0], pool[2], tie[pool[1]], top + 1)
    pool = tuple(p[kept] for p in pool)
    n = np.bincount(pool[0], minlength=len(tau))
    worst = np.full(len(tau), np.inf)
    np.minimum.at(worst, pool[0], np.where(np.isnan(pool[2]), -np.inf, pool[2]))
    return pool, np.where(n > top, np.maximum(tau, worst), tau)


def search(
    vectors: DataFrame, every: int = EVERY, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_col, vec_col), "vectors")
    entries = stored(distinct_vectors(rows, top), "entries")
    indexes = build(entries)
    if not indexes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = spark.sparkContext.broadcast(indexes)  # codebooks, radii and cell sizes: bounded by MAX_CODES
    laid = stored(placed(entries, sent), "blocks")
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("qid"), "rid", "dim", "vec")

    def look(asked: DataFrame, further: bool) -> DataFrame:
        want = stored(visits(asked, sent, further), "visits")
        groups = want.groupBy("dim", "block").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("groups"))
        spread = F.pmod(F.xxhash64("rid"), F.col("groups")).cast("int")
        a = join_small(want, groups, ["dim", "block"]).withColumn("part", spread)
        b = join_small(laid, groups, ["dim", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        both = a.drop("groups").unionByName(b.drop("groups"), allowMissingColumns=True)
        cut = top
        found = both.groupBy("dim", "block", "part").applyInArrow(lambda g: rerank(g, cut), "qid long, rid long, id long, other long, score double")
        return stored(found, "found")

    order = [F.isnan("score"), F.col("score").desc(), F.col("id").asc_nulls_last(), "other"]
    place = F.row_number().over(Window.partitionBy("rid").orderBy(*order))
    near = look(queries.withColumn("tau", F.lit(float("-inf"))), False)
    last = near.withColumn("rank", place).where(F.col("rank") == top).select("rid", F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score")).alias("tau"))
    far = look(queries.join(last, "rid", "left").fillna(float("-inf"), ["tau"]), True)
    best = near.unionByName(far).withColumn("rank", place).where(F.col("rank") <= top)
    return best.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op11_inverted_multi_index(spark, sf_dir: str) -> DataFrame:
    """All embeddings; queries are the ids divisible by 20, 20 nearest by inner product."""
    return search(table(spark, sf_dir, "embeddings"))


OP11_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.rid AS other, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, other) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
