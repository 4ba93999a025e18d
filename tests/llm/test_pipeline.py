"""The pipeline's stages take effect, keep clean documents and chain as run() does; SQL forms agree."""

import duckdb

import corpus_pipeline
from attriscope.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [docs]
    for _, stage in corpus_pipeline.STAGES:
        rows.append(stage(spark, rows[-1], SF).cache())
    ids = [[r.doc_id for r in x.select("doc_id").collect()] for x in rows]
    assert all(x.columns == docs.columns for x in rows[:-1]) and {"ids", "n_pieces"} <= set(rows[-1].columns)
    assert len(ids[1]) < len(ids[0]) and set(ids[2]) <= set(ids[1]) and len(ids[3]) == len(set(ids[3])) and set(ids[4]) <= set(ids[3])
    assert len(ids[4]) > len(set(ids[4])) and sorted(ids[5]) == sorted(ids[4])
    good = [i for i in ids[0] if labels.get(i) == 1]
    assert len(set(ids[2]) & set(good)) >= 0.9 * len(good)
    out = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(ids[5])


def test_stages_on_edge_rows(spark, docs, empty):
    """Nulls, blank texts, repeated rows and an empty table through every stage."""
    for source in (docs, empty):
        rows = source.selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS long) AS n_chars")
        for name, stage in corpus_pipeline.STAGES:
            before = rows.collect()
            rows = stage(spark, spark.createDataFrame(before, rows.schema), SF)
            after = rows.collect()
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and (before or not after)
            assert all(r.text and r.text.strip() for r in after)
            if name == "near_duplicates":
                assert len({r.text for r in after}) == len(after)


def test_sql_forms(spark):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")

    def rows(df, cols):  # sums of products in another order differ in their last bits
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df[cols].values.tolist())

    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, SF)
        want = con.execute(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert rows(got.toPandas(), cols) == rows(want, cols)


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


def test_a_worker_lets_go_of_another_stages_model(spark, docs):
    """A task of another kind frees the tokenizer (and the runs it has met) that the worker's earlier tasks kept."""
    import gc

    import public_tokenizers
    import pyarrow as pa
    from pyspark.sql import types as T

    from attriscope.llm.common import annotate
    from attriscope.llm.op6_sentencepiece import tokenize

    def make():
        def run(array):
            from attriscope.llm.op6_sentencepiece import SentencePiece

            yield pa.array([sum(isinstance(o, SentencePiece) for o in gc.get_objects())] * len(array), pa.int64())

        return run

    one = docs.select("doc_id", "text").coalesce(1)
    for _ in range(2):
        assert tokenize(one, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"]).agg({"n_pieces": "sum"}).first()[0] > 0
        # as many tasks at once as there are workers, so the one that has the model is among them
        many = docs.select("doc_id", "text").repartition(16)
        held = annotate(many, ["text"], [T.StructField("held", T.LongType())], make, ["doc_id"])
        assert max(r.held for r in held.collect()) == 0
