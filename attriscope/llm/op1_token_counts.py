"""Token counts with a digest cache.

Every content (null: empty) has a SHA-256 digest, every tokenizer version the
SHA-256 of its file.  Counts live in a Parquet table keyed by both.  The
operator anti-joins the distinct digests with that table, encodes one text for
each distinct miss, appends the counts and joins them back to all rows.

The content normaliser is null -> empty and nothing else: a byte-level
tokenizer tells any two different texts apart, so a stronger one would give
wrong counts.

Edge cases: null and empty text count 0; repeated rows and copies are encoded
once; a digest that holds a third of the rows adds one row for each task to
the aggregate and is split by the skew join; an empty table gives no row and
appends nothing; other columns are not read.  A cache may hold a key twice
(two writers); counts are equal then, and the read takes the largest.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attriscope.llm.common import annotate, texts_of
from attriscope.session import work_path

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: digest of its file and of the settings used here."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no added tokens|no truncation|no padding").hexdigest()


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Counter:
    """Counts tokens as the tokenizer file's own library does.

    A plain byte-level BPE file (no normaliser, standard split, no dropout) is
    run by the faster rank encoder over the same merges; any other .json by
    tokenizers, a .model by sentencepiece.  ``tests/llm`` compares the two.
    """

    def __init__(self, path: str):
        self.specials: list[str] = []
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
            return
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if self._plain(spec):
            import tiktoken

            of, vocab = _byte_of_char(), spec["model"]["vocab"]
            added = {a["content"] for a in spec["added_tokens"]}
            ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in added}
            enc = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.specials = sorted(added)
            self.count = lambda texts: [self._ranked(enc, t) for t in texts]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.count = lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _plain(spec: dict) -> bool:
        m, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if m["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel":
            return False
        if pre.get("add_prefix_space") or not pre.get("use_regex", True) or m.get("dropout") or m.get("byte_fallback"):
            return False
        if m.get("continuing_subword_prefix") or m.get("end_of_word_suffix") or m.get("ignore_merges"):
            return False
        if any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in spec["added_tokens"]):
            return False
        merged = [m["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in m["merges"]]
        return all(a < b for a, b in zip(merged, merged[1:]))  # ranks are ids

    def _ranked(self, enc, text: str) -> int:
        parts, n = [text], 0
        for s in self.specials:
            split = [p.split(s) for p in parts]
            n += sum(len(x) - 1 for x in split)
            parts = [y for x in split for y in x]
        return n + sum(len(enc.encode_ordinary(p)) for p in parts if p)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``cache_path`` is a Parquet table (created when absent) in a store that all executors reach.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("content"),
    ).withColumn("digest", F.unhex(F.sha2("content", 256)))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cached = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)

    # one row stands for each distinct missing content; its text moves by its own id, never by a hot digest
    key = F.coalesce(F.xxhash64("id"), F.lit(0)).alias("key")
    first = rows.select("digest", key).groupBy("digest").agg(F.min("key").alias("key"))
    misses = first.join(cached.select("digest").distinct(), "digest", "left_anti")
    texts = rows.select("digest", key, "content").join(misses, ["digest", "key"], "left_semi")

    def make():
        counter = Counter(tokenizer_path)

        def count(array: pa.Array):
            yield pa.array(counter.count(texts_of(array)), pa.int64())

        return count

    counted = annotate(texts, ["content"], [T.StructField("n_tokens", T.LongType())], make, ["digest"])
    counted = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # rows repeated with their id
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)

    counts = (
        spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        .where(F.col("tokenizer") == version)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )
    return (
        rows.select("id", "digest", F.octet_length("content").cast("long").alias("n_bytes"))
        .join(counts, "digest")
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents, byte_bpe_50k.json.  The cache is a new table for each call, so the call's cost is a cold one."""
    from attriscope.llm.common import table

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), work_path(spark, "token_cache"))
