"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Texts get a 64-bit fingerprint from XXH64 hashes of word shingles.  Two
fingerprints at ``radius`` = 3 bits or less share a variant: each lies within
half of the radius of it, rounded down on one side and up on the other.

* every fingerprint emits itself and its 64 one-bit variants;
* the rounded-up shell (two bits) matters only for pairs at distance 3, which
  have different parity, so only odd fingerprints emit it; and as two of any
  three bits lie in the same half of the word, only two-bit variants within a
  half are needed (992 of 2,016).

Variants are shuffled by their XOR-fold to ``p`` bits.  A fold is linear, so
the bucket of ``f ^ mask`` is ``fold(f) ^ fold(mask)``: a fingerprint's
variants go to few buckets, travel there as one (bucket, fingerprint) row,
and are written out and sorted by the bucket's task.  The number of buckets follows the
number of variants, so a task has about ``VARIANTS_A_TASK`` of them.

All fingerprints within one bit of a variant are within two bits of each
other, and each one at two bits is within three of them.  So one link from
each member to the smallest one-bit member keeps every connection: links grow
with the members of a variant, not with its pairs.  Each link is verified by
its bit distance.  Copies share a fingerprint and enter once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attriscope.llm.common import annotate, components, stored, table, texts_of

SEED, SHINGLE, RADIUS = 42, 3, 3
VARIANTS_A_TASK = 1 << 21
MIN_BITS = 8


def fingerprint_of(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is 1 if set in over half of the shingles' hashes (shingles repeat; no word: 0)."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass")
    words = words.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    starts = [0, *ends[:-1].tolist()][:n]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def with_fingerprint(docs: DataFrame, text_col: str, keep: list[str], name: str = "fp", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Columns ``keep`` and, as column ``name``, the unsigned fingerprint stored as a signed long."""

    def make():
        def run(array: pa.Array):
            out = np.fromiter((fingerprint_of(t, shingle, seed) for t in texts_of(array)), np.uint64, len(array))
            yield pa.array(out.view(np.int64), pa.int64())

        return run

    return annotate(docs, [text_col], [T.StructField(name, T.LongType())], make, keep)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp) for each row."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return with_fingerprint(src, "text", ["id"], shingle=shingle, seed=seed)


def _masks(bits: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Masks of the one-bit ball and of the two-bit shell by their fold to ``bits`` bits."""
    ball = [0, *(1 << i for i in range(64))]
    shell = [(1 << i) | (1 << j) for h in (0, 32) for i in range(h, h + 32) for j in range(h, i)]

    def by_fold(masks):
        out: dict[int, list[int]] = {}
        for m in masks:
            f, rest = 0, m
            while rest:
                f, rest = f ^ (rest & ((1 << bits) - 1)), rest >> bits
            out.setdefault(f, []).append(m)
        return {f: np.array(v, np.uint64) for f, v in out.items()}

    return by_fold(ball), by_fold(shell)


def _fold(fp, bits: int):
    """XOR of the ``bits``-wide digits of a long column."""
    low, out = F.lit((1 << bits) - 1), None
    for at in range(0, 64, bits):
        part = F.shiftrightunsigned(fp, at).bitwiseAND(low)
        out = part if out is None else out.bitwiseXOR(part)
    return out


def links(fps: DataFrame, count: int) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fps(fp)`` that join all pairs at 3 bits or less.

    ``count`` is their number; it sets only the number of buckets.
    """
    per = (65 + 65 + 992) / 2
    bits = max(MIN_BITS, math.ceil(math.log2(max(1.0, count * per / VARIANTS_A_TASK))))
    ball, shell = _masks(bits)
    near = F.array(*[F.lit(int(f)).cast("long") for f in sorted(ball)])
    far = F.array(*[F.lit(int(f)).cast("long") for f in sorted(set(ball) | set(shell))])
    odd = F.bit_count("fp") % 2 == 1
    sent = fps.select("fp", _fold(F.col("fp"), bits).alias("home"), F.explode(F.when(odd, far).otherwise(near)).alias("by"))
    sent = sent.select("fp", F.col("home").bitwiseXOR(F.col("by")).alias("bucket"), "by")

    def variants(fp: np.ndarray, by: np.ndarray):
        """All variants of this bucket: (variant, fingerprint, 0 if within one bit else 1)."""
        odd = np.bitwise_count(fp) % 2 == 1
        for kind, masks, use in ((0, ball, np.ones(len(fp), bool)), (1, shell, odd)):
            for f, m in masks.items():
                own = fp[use & (by == f)]
                if len(own):
                    yield (own[:, None] ^ m[None, :]).ravel(), np.repeat(own, len(m)), kind

    def match(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        by = group.column("by").to_numpy()
        parts = list(variants(fp, by))
        v = np.concatenate([p[0] for p in parts])
        who = np.concatenate([p[1] for p in parts])
        kind = np.concatenate([np.full(len(p[0]), p[2], np.uint8) for p in parts])
        order = np.argsort(v, kind="stable")
        same = np.zeros(len(v) + 1, bool)
        same[1:-1] = v[order][1:] == v[order][:-1]
        order = order[same[1:] | same[:-1]]  # only variants that two or more share
        if not len(order):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        order = order[np.lexsort((who[order], kind[order], v[order]))]
        v, who, kind = v[order], who[order], kind[order]
        at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        size = np.diff(np.append(at, len(v)))
        hub = np.repeat(who[at], size)  # the smallest one-bit member, if there is one
        ok = (np.repeat(kind[at], size) == 0) & (hub != who) & (np.bitwise_count(hub ^ who) <= RADIUS)
        pair = np.unique(np.stack([hub[ok], who[ok]], axis=1), axis=0) if ok.any() else np.zeros((0, 2), np.uint64)
        return pa.table({"a": pair[:, 0].copy().view(np.int64), "b": pair[:, 1].copy().view(np.int64)})

    return sent.groupBy("bucket").applyInArrow(match, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null, empty and blank texts have fingerprint zero and link like any other;
    texts of fewer words than a shingle hash whole; a null id takes part but
    is never a component_id unless all ids of its component are null; an empty table gives no row.
    """
    fps, groups = grouped(docs, id_col, text_col, shingle)
    smallest = groups.groupBy("c").agg(F.min("first").alias("component_id"))
    named = groups.join(smallest, "c").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of each row, and (fp, first, c) of each fingerprint: its smallest id and its component."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")).checkpoint()
    found = components(links(classes.select("fp"), classes.count()))
    return fps, classes.join(found, classes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: a row with its smallest id, and of those with the smallest fingerprint.

    Rows go by id and fingerprint, so a repeated id with other texts is a member of each text's component.
    A component without an id keeps one row too.
    """
    _, groups = grouped(docs, id_col, text_col, shingle)
    first = F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), F.col("fp").alias("fp"))
    stay = groups.groupBy("c").agg(F.min(first).alias("s")).select(F.col("s.id").alias("__id"), F.col("s.fp").alias("__stays"))
    rows = with_fingerprint(docs, text_col, docs.columns, "__fp", shingle)
    kept = rows.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__stays")), "left_semi")
    return kept.dropDuplicates([id_col, "__fp"]).drop("__fp")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents: 3-word shingles, links at 3 bits or less."""
    return near_duplicates(table(spark, sf_dir, "documents"))
