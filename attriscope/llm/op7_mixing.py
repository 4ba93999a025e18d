"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source has a queue of its documents in shuffled order (by the MD5 of
seed, id and the text's MD5), walked twice at most.  A document's virtual finish time is the
source's words up to and with it, divided by the source's target, which is its
weight times the water level of the capped shares.  All items are ranked by
finish time and the mix is cut where it would exceed the total budget.

No source is ordered in one task: the shuffle key's leading hex digits cut
each queue into ``16 ** digits`` cells, running sums are taken inside a cell,
and cell offsets come from the table of cell totals.  The cut is found from
the totals of finish-time cells; only the one cell it falls into is ordered.
Words are counted once: sizes and shuffle keys are written to the shared folder
(with the kept columns, unless the text is one of them; then the texts are read
once more for the result).

Edge cases: null text has size 0; a null source is a source of its own, last;
sources without words get target 0 and nothing is taken of them; documents of
equal finish time are taken or left together; rows that repeat an id, or have
none, spread over the queue by their texts, and only rows equal in both follow
each other; an empty table gives no row.  Kept columns of the
same names as the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attriscope.llm.common import WORD, stored, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
TIME_CELLS = 65536
ADDED = ["size", "source_size", "target", "copies", "taken"]


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(skey, source_size) -> plus target: shares of ``share`` times all words by weight, none above ``epochs`` x its size.

    With sources in order of cap / weight, the saturated ones are a prefix; the
    rest share what is left.  One row for each source is ordered, not documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1).cast("int"))
    s = totals.withColumn("w", w).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    ranked = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    upto = ranked.rowsBetween(Window.unboundedPreceding, -1)
    rest = ranked.rowsBetween(0, Window.unboundedFollowing)
    budget = F.lit(share) * F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("left", budget - F.coalesce(F.sum("cap").over(upto), F.lit(0))).withColumn("wsum", F.sum("w").over(rest))
    s = s.withColumn("level", F.col("left") / F.col("wsum"))
    s = s.withColumn("open", F.col("cap") > F.col("w") * F.col("level"))
    level = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("o"), "skey", "level"))).over(Window.partitionBy())["level"]
    target = F.when(level.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("w") * level))
    return s.select("skey", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS, digits: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default all) with size, source_size, target, copies (times taken) and taken (words taken).

    ``16 ** digits`` cells cut each source's queue; with the default, 4,096
    cells, a source of 1e10 documents has 2.4 million narrow rows in a cell.
    """
    src = F.col(f"`{source_col}`")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    base = docs.select(  # kept columns travel in a struct, so none clashes with a working column
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD))).cast("long").alias("size"),
        F.when(src.isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), src)).alias("skey"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))).alias("u"),
    ).withColumn("cell", F.substring("u", 1, digits))
    if text_col in kept:
        sizes = stored(base.drop("row"), "mix-sizes")
    else:
        base = sizes = stored(base, "mix-rows")
    cells = sizes.groupBy("skey", "cell").agg(F.sum("size").alias("cell_size"))
    totals = cells.groupBy("skey").agg(F.sum("cell_size").alias("source_size"))
    before = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.withColumn("before", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
        .join(source_targets(totals, weights, share, epochs), "skey")
        .select("skey", "cell", "before", "source_size", "target")
        .checkpoint()
    )
    queue = Window.partitionBy("skey", "cell").orderBy("u", "size").rowsBetween(Window.unboundedPreceding, 0)

    def placed(rows):
        return rows.join(offsets, ["skey", "cell"]).withColumn("upto", F.col("before") + F.sum("size").over(queue))

    def finish(epoch):
        return (epoch * F.col("source_size") + F.col("upto")) / F.col("target")

    items = placed(sizes).where("target > 0").select("size", F.explode(F.array(*[finish(F.lit(e)) for e in range(epochs)])).alias("t"))
    items = items.withColumn("tcell", F.floor(F.col("t") * TIME_CELLS)).checkpoint()
    budget = F.lit(share) * F.sum("source_size").over(Window.partitionBy())
    total = totals.select(budget.alias("b")).agg(F.max("b").alias("b"))
    # cells are whole-number multiples of 1 / TIME_CELLS up to the largest finish time; the totals are one row each
    run = items.groupBy("tcell").agg(F.sum("size").alias("n"))
    run = run.select("tcell", F.sum("n").over(Window.orderBy("tcell")).alias("upto"), "n")
    cut = run.crossJoin(F.broadcast(total)).where("upto > b").agg(F.min(F.struct("tcell", (F.col("upto") - F.col("n")).alias("before"), "b")).alias("c")).first()["c"]
    if cut is None:
        last = None
    else:
        inside = items.where(F.col("tcell") == cut["tcell"]).groupBy("t").agg(F.sum("size").alias("n"))
        inside = inside.withColumn("upto", F.lit(cut["before"]) + F.sum("n").over(Window.orderBy("t")))
        got = inside.where(F.col("upto") <= cut["b"]).agg(F.max("t")).first()[0]
        last = got if got is not None else cut["tcell"] / TIME_CELLS
    if last is None:
        copies = F.lit(epochs)
    elif cut is not None and got is None:
        copies = sum((F.floor(finish(F.lit(e)) * TIME_CELLS) < cut["tcell"]).cast("int") for e in range(epochs))
    else:
        copies = sum((finish(F.lit(e)) <= F.lit(last)).cast("int") for e in range(epochs))
    return (
        placed(base).withColumn("copies", F.coalesce(F.when(F.col("target") > 0, copies), F.lit(0)))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .select("row.*", *ADDED)
    )


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed by the contract's weights 5, 2, 1 to 150 % of all words."""
    return mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH base AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         CASE WHEN source IS NULL THEN '2' ELSE concat('1', source) END AS skey,
         md5(concat('7:', coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', md5(coalesce(text, '')))) AS u
  FROM documents),
tot AS (SELECT skey, sum(size)::BIGINT AS source_size FROM base GROUP BY skey),
wt AS (SELECT skey, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM tot),
lv AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM tot)
         - coalesce(sum(cap) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / sum(w) OVER (ORDER BY cap / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
one AS (SELECT level FROM lv WHERE cap > w * level ORDER BY cap / w, skey LIMIT 1),
tg AS (SELECT skey, source_size, least(cap::DOUBLE, w * coalesce((SELECT level FROM one), 1e300)) AS target FROM lv),
q AS (SELECT b.doc_id, b.size, t.source_size, t.target, b.skey,
         (sum(b.size) OVER (PARTITION BY b.skey ORDER BY b.u, b.size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
      FROM base b JOIN tg t USING (skey)),
items AS (SELECT doc_id, size, e, (e * source_size + upto) / target AS t FROM q, (VALUES (0), (1)) AS ep(e) WHERE target > 0),
per AS (SELECT t, sum(size)::BIGINT AS n FROM items GROUP BY t),
run AS (SELECT t, sum(n) OVER (ORDER BY t)::BIGINT AS upto FROM per),
cut AS (SELECT max(t) AS t FROM run WHERE upto <= 1.5 * (SELECT sum(source_size)::BIGINT FROM tot))
SELECT doc_id, size, source_size, target,
       CASE WHEN target > 0 THEN size * ((upto / target <= (SELECT t FROM cut))::BIGINT + ((source_size + upto) / target <= (SELECT t FROM cut))::BIGINT) ELSE 0 END AS taken
FROM q
"""
