"""k-NN join, SMOTE and Tomek-link queries on ``embeddings`` (label 0 is the minority)."""

from pyspark.sql import functions as F

from attriscope.operators import resample as RS
from attriscope.operators.common import round_cols
from attriscope.operators.knn import knn_join
from attriscope.plans.base import query
from attriscope.sources.tables import load

MINORITY = 0
_DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))"


def _emb(spark, sf):
    return load(spark, sf, "embeddings")


@query("knn_join", f"""
WITH p AS (SELECT vec_id, embedding FROM embeddings)
SELECT vec_id, nn_id, CAST(nn_rank AS INT) AS nn_rank, ROUND(dist, 6) AS dist FROM (
  SELECT a.vec_id, b.vec_id AS nn_id, {_DIST} AS dist,
         ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS nn_rank
  FROM p a, p b WHERE a.vec_id <> b.vec_id) WHERE nn_rank <= 5""")
def q_knn_join(spark, sf):
    return round_cols(knn_join(_emb(spark, sf), 5, id_col="vec_id", vec_col="embedding"), {"dist": 6})


_SMOTE_SQL = f"""
WITH p AS (SELECT vec_id, embedding FROM embeddings WHERE label = 0),
c AS (SELECT CAST(SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS m, CAST(SUM(CASE WHEN label <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS big,
             MAX(vec_id) AS max_id FROM embeddings),
k AS (SELECT m, max_id, (big - m) // m AS base, (big - m) % m AS rem, LEAST(5, m - 1) AS kk FROM c),
nn AS (SELECT a.vec_id, b.vec_id AS nn_id,
              ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS nn_rank
       FROM p a, p b WHERE a.vec_id <> b.vec_id),
r AS (SELECT vec_id, embedding, ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS r0 FROM p),
x AS (SELECT r.vec_id, r.embedding, r0, base, rem, kk, max_id,
             unnest(range(0, base + CASE WHEN r0 < rem THEN 1 ELSE 0 END)) AS j FROM r, k),
y AS (SELECT vec_id, embedding, max_id + r0 * base + LEAST(r0, rem) + j + 1 AS id,
             ((vec_id * 7919 + j * 104729 + 42) % 10007) % kk + 1 AS t,
             CAST((vec_id * 15485863 + j * 32452843 + 42) % 1000003 AS DOUBLE) / 1000003E0 AS u FROM x),
s AS (SELECT y.id, y.vec_id AS parent_id, nn.nn_id, y.u,
             list_transform(list_zip(y.embedding, q.embedding), lambda p: p[1]::DOUBLE + y.u * (p[2]::DOUBLE - p[1]::DOUBLE)) AS vec
      FROM y JOIN nn ON nn.vec_id = y.vec_id AND nn.nn_rank = y.t JOIN p q ON q.vec_id = nn.nn_id)"""


@query("smote_resample", _SMOTE_SQL + """
SELECT id, parent_id, nn_id, ROUND(u, 9) AS u, CAST(dim AS INT) AS dim, ROUND(value, 6) AS value
FROM (SELECT id, parent_id, nn_id, u, generate_subscripts(vec, 1) AS dim, unnest(vec) AS value FROM s)""")
def q_smote_resample(spark, sf):
    """Synthetic minority rows exploded to (id, dim, value) for an exact comparison."""
    s = RS.smote(_emb(spark, sf), "label", MINORITY, 5, id_col="vec_id", vec_col="embedding")
    out = s.select(F.col("vec_id").alias("id"), "parent_id", "nn_id", "u", F.posexplode("embedding").alias("_pos", "value"))
    return round_cols(out.withColumn("dim", (F.col("_pos") + 1).cast("int")).drop("_pos"), {"u": 9, "value": 6})


@query("smote_class_counts", _SMOTE_SQL + """
SELECT label, COUNT(*) AS n, CAST(SUM(CASE WHEN synthetic THEN 1 ELSE 0 END) AS BIGINT) AS n_synthetic FROM (
  SELECT label, FALSE AS synthetic FROM embeddings UNION ALL SELECT 0, TRUE FROM s) GROUP BY label""")
def q_smote_class_counts(spark, sf):
    res = RS.smote_resample(_emb(spark, sf), "label", MINORITY, 5, id_col="vec_id", vec_col="embedding")
    return res.groupBy("label").agg(F.count("*").alias("n"), F.count_if("synthetic").alias("n_synthetic"))


_NN1 = f"""
WITH p AS (SELECT vec_id, embedding, CASE WHEN label = 0 THEN 1 ELSE 0 END AS cls FROM embeddings),
nn AS (SELECT vec_id, nn_id FROM (
  SELECT a.vec_id, b.vec_id AS nn_id, ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS rk
  FROM p a, p b WHERE a.vec_id <> b.vec_id) WHERE rk = 1),
links AS (SELECT x.vec_id AS a, x.nn_id AS b, pa.cls AS class_a, pb.cls AS class_b
          FROM nn x JOIN nn y ON x.vec_id = y.nn_id AND x.nn_id = y.vec_id
          JOIN p pa ON pa.vec_id = x.vec_id JOIN p pb ON pb.vec_id = x.nn_id
          WHERE x.vec_id < x.nn_id AND pa.cls <> pb.cls)"""


def _classed(spark, sf):
    return _emb(spark, sf).withColumn("cls", (F.col("label") == MINORITY).cast("int"))


@query("tomek_links", _NN1 + "\nSELECT a, b, class_a, class_b FROM links")
def q_tomek_links(spark, sf):
    return RS.tomek_links(_classed(spark, sf), "cls", id_col="vec_id", vec_col="embedding")


@query("tomek_clean", _NN1 + """
SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT a FROM links UNION SELECT b FROM links)""")
def q_tomek_clean(spark, sf):
    return RS.tomek_clean(_classed(spark, sf), "cls", id_col="vec_id", vec_col="embedding").select("vec_id", "label")


@query("smote_tomek", _SMOTE_SQL + f""",
allp AS (SELECT vec_id, label, FALSE AS synthetic, CAST(embedding AS DOUBLE[]) AS embedding,
                CASE WHEN label = 0 THEN 1 ELSE 0 END AS cls FROM embeddings
         UNION ALL SELECT id, 0, TRUE, vec, 1 FROM s),
nn1 AS (SELECT vec_id, nn_id FROM (
  SELECT a.vec_id, b.vec_id AS nn_id, ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS rk
  FROM allp a, allp b WHERE a.vec_id <> b.vec_id) WHERE rk = 1),
lk AS (SELECT x.vec_id AS a, x.nn_id AS b FROM nn1 x JOIN nn1 y ON x.vec_id = y.nn_id AND x.nn_id = y.vec_id
       JOIN allp pa ON pa.vec_id = x.vec_id JOIN allp pb ON pb.vec_id = x.nn_id
       WHERE x.vec_id < x.nn_id AND pa.cls <> pb.cls)
SELECT vec_id, label, synthetic FROM allp WHERE vec_id NOT IN (SELECT a FROM lk UNION SELECT b FROM lk)""")
def q_smote_tomek(spark, sf):
    """SMOTE then Tomek-link removal (the v2 resampler); rows-only + property tests."""
    res = RS.smote_tomek(_emb(spark, sf), "label", MINORITY, 5, id_col="vec_id", vec_col="embedding")
    return res.select("vec_id", "label", "synthetic")
