"""Training-corpus pipeline over ``documents``: five stages, each on all rows its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again before the next one.  Stages 1 to 4 return the columns
of ``documents``; the last one adds the pieces of each text.

1. quality_classifier  documents outside the importance-resampling draw go
2. quality_rules       documents that fail the base rules or leave their language's perplexity band go
3. near_duplicates     one document of each SimHash component stays (3-word shingles, 3 bits)
4. mixing              documents repeat or go by the fair-queue mix of their sources
5. sentencepiece       every remaining text is encoded, decoded and checked

Edge rows: null, empty and blank texts go at stage 1 (they have no feature); repeated rows pass stages 1 and 2 each
and one of them stays at stage 3; null ids, languages and sources are kept as values; an empty table passes all
stages and gives no row.

No stage has an SQL form for all its steps, so ``ORACLE_SQL`` is None; tests/llm compares the operators behind the
stages with brute force, and checks what each stage keeps.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attriscope.llm.common import stored, table
from attriscope.llm.op5_quality_rules import quality_rules as rules
from attriscope.llm.op6_sentencepiece import tokenize
from attriscope.llm.op7_mixing import mix
from attriscope.llm.op9_simhash import drop_near_duplicates
from attriscope.llm.op10_quality_classifier import classify

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classify(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).where("kept").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix(docs, keep=COLUMNS)
    copies = F.sequence(F.lit(1), F.col("copies"))
    return mixed.where("copies > 0").select(*COLUMNS, F.explode(copies).alias("copy")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenize(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=COLUMNS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the whole ``documents`` table; each stage but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
