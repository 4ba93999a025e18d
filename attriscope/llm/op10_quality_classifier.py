"""Quality classifier by importance resampling.

Hashed word and word-pair features give two bag-of-features models: the raw
one from all documents, the target one from labelled good documents.  A
document's log importance weight is the sum of its features' log ratios.  Each
document's weight gets Gumbel noise from a hash of its id, and the ``k``
largest are kept, which draws without replacement in proportion to the weights.

k is ``keep_share`` of the rows that have a word.  By default k comes from the scores of all labelled
good documents: it is the least number of rows that holds ``GOOD_KEPT`` of them, so bad documents go as far as
the weights tell them apart.  The k-th largest value is found exactly by narrowing histograms, not by a sort.

The target model is fitted on at most ``MAX_TARGET`` labelled good documents
(smallest hash of id), so the broadcast list of ids has that bound; raw counts
come from all documents.  Both models are arrays of ``BUCKETS`` numbers.

Edge cases: null, empty and blank texts have no feature, get weight -inf and are
never kept; ties at the k-th value are kept together (rows that repeat an id
have the same noise); without labelled good documents all weights are 0 and every row with a word
is kept; an empty table gives no row.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attriscope.llm.common import annotate, kth_largest, let_go, parts_of, small_batches, stored, table, texts_of
from attriscope.llm.words import Words, longs, per_text

BUCKETS = 1 << 16
MAX_TARGET = 20_000
PSEUDO = 16.0  # counts added to both models, so a thin bucket says little
SEED = 10
GOOD_KEPT = 0.999  # share of the labelled good documents that the draw keeps; they are in the fit, so others score a little lower


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every word and of every pair of neighbouring words."""
    w = Words(texts)
    h = w.hashes(fold_case=True)
    at, pair = w.windows(h, 2)
    shift = np.uint64(64 - 16)
    return np.concatenate([h >> shift, pair >> shift]).astype(np.int64), np.concatenate([w.doc, w.doc[at]])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Log ratio of target to raw probability of each bucket."""
    good = good_ids(labels).orderBy(F.xxhash64("good", F.lit(SEED)), "good").limit(MAX_TARGET)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    src = src.join(F.broadcast(good), F.col("id") == F.col("good"), "left").select("text", F.col("good").isNotNull().alias("good"))

    def count(batches):
        let_go()
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts, is_good = texts_of(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for part in parts_of(texts):
                b, doc = features(texts[part])
                raw += np.bincount(b, minlength=BUCKETS)
                target += np.bincount(b[is_good[part][doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([longs(at), longs(raw[at]), longs(target[at])], names=["bucket", "raw", "target"])

    small_batches(docs.sparkSession)
    sums = src.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    rows = sums.toArrow()  # at most BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = rows.column("bucket").to_numpy()
    raw[at], target[at] = rows.column("raw").to_numpy(), rows.column("target").to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + PSEUDO) / (raw * (target.sum() / raw.sum()) + PSEUDO))


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with log_weight and score (log_weight plus Gumbel noise)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float64))  # BUCKETS numbers

    def make():
        def run(array):
            texts = texts_of(array)
            b, doc = features(texts)
            n = np.bincount(doc, minlength=len(texts))
            total = per_text(shared.value[b], doc, len(texts))
            yield pa.array(np.where(n > 0, total, -np.inf), pa.float64())

        return run

    uid = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    u = (F.shiftrightunsigned(F.xxhash64(uid, F.lit(SEED)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    src = docs.withColumn("__gumbel", -F.log(-F.log(u)))
    out = annotate(src, [text_col], [T.StructField("log_weight", T.DoubleType())], make, [*keep, "__gumbel"], chunk_bytes=1 << 19)
    return out.withColumn("score", F.col("log_weight") + F.col("__gumbel")).drop("__gumbel")


def good_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("good")).distinct()


def label_threshold(scores: DataFrame, labels: DataFrame, id_col: str) -> float:
    """The largest score at or above which ``GOOD_KEPT`` of all labelled good rows are."""
    good = scores.where("score > double('-infinity')").join(good_ids(labels), F.col(f"`{id_col}`") == F.col("good"), "left_semi")
    good = stored(good.select("score"), "good")
    n = good.count()
    return kth_largest(good, math.ceil(GOOD_KEPT * n)) if n else -sys.float_info.max


def threshold(scores: DataFrame, share: float) -> float:
    """The score of the last document kept."""
    finite = scores.where("score > double('-infinity')").select("score")
    n = finite.count()
    k = round(share * n)
    return kth_largest(finite, k) if 0 < k <= n else float("inf")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, keep_share: float | None = None) -> DataFrame:
    """Columns ``keep`` (default: id) with log_weight, score and kept."""
    keep = [id_col] if keep is None else keep
    ratio = fit(docs, labels, id_col, text_col)

    def cut_of(scores):
        return label_threshold(scores, labels, id_col) if keep_share is None else threshold(scores, keep_share)

    if keep == [id_col]:
        scored = stored(weigh(docs, ratio, id_col, text_col, keep), "weights")
        cut = cut_of(scored)
    else:  # scores only are written; the rows themselves are scored again on their way out
        cut = cut_of(stored(weigh(docs, ratio, id_col, text_col, [id_col]), "weights"))
        scored = weigh(docs, ratio, id_col, text_col, keep)
    return scored.withColumn("kept", F.col("score") >= cut)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """All documents against the labelled good ones."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
