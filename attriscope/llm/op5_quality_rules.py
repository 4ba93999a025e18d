"""Quality rules by n-gram perplexity.

Spark counts the character 4-grams of all documents by language and makes a modified Kneser-Ney model of
them.  Each document gets the negative log-probability of all its characters for each of its letters (so symbols
cost and do not lengthen a text); the documents of a language give a lower and an upper band, and documents outside
the band are rejected.

Characters are UTF-16 code units as they stand: no folding, so case, every symbol and every script count.
A 4-gram fills 64 bits exactly.  Every language (and null) has a model and a band of its own, as rows keyed by the
language: neither their number nor the number of n-grams has a limit, and no model is broadcast or collected.

1. The scan is cut into packs of about ``PACK`` bytes of text.  Each pack sends its distinct n-grams with their
   counts, so what is gathered grows with the input; summed by language they are the counts of the model.  All
   lower orders are continuation counts of the highest.
2. The model's rows go back to the packs that asked for them; each pack, compressed, meets its slice of the model
   in a cogroup, where the slice is a sorted hash array.  A task holds one pack and one slice.

Both passes must cut the same packs: an input that is not a plain scan of files is written first.  If
an n-gram of a pack is not in its slice, the job stops with a message; it never scores by less.

Band: from ``LOWER`` robust standard deviations below to ``UPPER`` above the median of a language's distinct scores
(a group of copies counts once, so it cannot move the band).  A deviation is scaled by the root of the length, up to
``LENGTH`` letters, as a short text's mean scatters more.  The spread is drawn towards ``SPREAD`` with the weight of
``PRIOR`` documents, so a language with few documents has a band too; it depends on no other language's rows.

Edge cases: null and empty texts have no word and fail the base rules; a text
without a letter or digit has perplexity null and no verdict of the model; a null language is a language of its own;
repeated rows are counted as often as they occur; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attriscope.llm.common import let_go, parts_of, small_batches, stored, table, texts_of
from attriscope.llm.words import Words, longs, mix64, per_text
from attriscope.operators.common import join_small

ORDER, BITS = 4, 16
CLASSES = 1 << BITS
PACK = 16 << 20
LOWER, UPPER = 8.0, 12.0
LENGTH, PRIOR, SPREAD = 1000.0, 20.0, 2.0
MIN_WORDS, MAX_REPEAT = 10, 20
SYMBOLS = b"#*$%&|<>"
_LETTER = np.arange(CLASSES) >= 128  # letters and digits: of ASCII by kind, else all
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram code, document) at each character; each text is padded with line ends on its left."""
    pad = "\n" * (ORDER - 1)
    units = [(pad + t).encode("utf-16-le", "surrogatepass") for t in texts]
    u = np.frombuffer(b"".join(units), "<u2").astype(np.uint64)
    size = np.fromiter((len(x) // 2 for x in units), np.int64, len(units))
    code = u.copy()
    for k in range(1, ORDER):
        code[k:] |= u[:-k] << np.uint64(BITS * k)
    begin = np.cumsum(size) - size
    inside = np.ones(len(u), bool)
    for k in range(ORDER - 1):
        inside[begin + k] = False
    return code[inside], np.repeat(np.arange(len(units)), size - (ORDER - 1))


def packs(batches: Iterable[pa.RecordBatch], pack_bytes: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(pack number, its rows) of a task: cut by the bytes of the texts (first column) alone, however the batches are cut."""
    first = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = number = 0
    for batch in batches:
        upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(0)), 0), np.int64) + 64)
        at, before = 0, 0
        while at < batch.num_rows:
            end = min(batch.num_rows, int(np.searchsorted(upto, before + pack_bytes - size)) + 1)
            held.append(batch.slice(at, end - at))
            size += int(upto[end - 1]) - before
            at, before = end, int(upto[end - 1])
            if size >= pack_bytes:
                yield first + number, held
                held, size, number = [], 0, number + 1
    if held:
        yield first + number, held


def by_language(texts: list[str], lang: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """(language, its rows) of a batch."""
    rows: dict[str, list[int]] = {}
    for i, m in enumerate(lang):
        rows.setdefault(m, []).append(i)
    for m, own in rows.items():
        yield m, np.array(own)


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of several (codes, counts), counts added."""
    code, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return code, np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def language_key(lang_col: str):
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{lang_col}`").cast("string")), F.lit(""))


def count_ngrams(docs: DataFrame, text_col: str, lang_col: str, pack_bytes: int = PACK) -> DataFrame:
    """(pack, model, code, n): how often each 4-gram occurs in a pack's texts of a language."""
    src = docs.select(F.col(f"`{text_col}`").alias("text"), language_key(lang_col).alias("model"))

    def count(batches):
        let_go()
        for pack, rows in packs(batches, pack_bytes):
            found: dict[str, list] = {}
            for batch in rows:
                texts, lang = texts_of(batch.column(0)), batch.column(1).to_pylist()
                for m, own in by_language(texts, lang):
                    mine = [texts[i] for i in own]
                    for part in parts_of(mine, 1 << 20):
                        found.setdefault(m, []).append(np.unique(codes_of(mine[part])[0], return_counts=True))
                    if len(found[m]) > 16:
                        found[m] = [merged(found[m])]
            for m, parts in found.items():
                code, n = merged(parts)
                if len(code):
                    same = [pa.array([x]).take(pa.array(np.zeros(len(code), np.int32))) for x in (pack, m)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(code.view(np.int64)), longs(n)], names=["pack", "model", "code", "n"])
        let_go()

    small_batches(docs.sparkSession)
    return stored(src.mapInArrow(count, "pack long, model string, code long, n long"), "ngrams")


def kneser_ney(grams: DataFrame) -> list[DataFrame]:
    """For each order (model, code, p, h, gamma): interpolated modified Kneser-Ney from counts of the highest order.

    p is the interpolated probability of the n-gram's last character after the others; gamma is the
    weight of the shorter history when an n-gram with this history h is unseen.
    """
    levels = {ORDER: grams.groupBy("model", "code").agg(F.sum("n").cast("double").alias("n")).checkpoint()}
    for o in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters to the left
        tail = F.col("code").bitwiseAND(F.lit((1 << (BITS * o)) - 1))
        levels[o] = levels[o + 1].groupBy("model", tail.alias("code")).agg(F.count("*").cast("double").alias("n"))
    out, lower = [], None
    for o in range(1, ORDER + 1):
        c = levels[o]
        f = c.groupBy("model").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

        def d(k):
            raw = F.coalesce(F.lit(float(k)) - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.5 * k))
            return F.greatest(F.lit(0.05), F.least(raw, F.lit(k - 0.05))).alias(f"d{k}")

        f = f.select("model", d(1), d(2), d(3)).checkpoint()  # a row for each language
        disc = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        c = join_small(c, f, "model").withColumn("h", F.shiftrightunsigned("code", BITS)).withColumn("d", disc)
        w = Window.partitionBy("model", "h")  # at most CLASSES rows
        c = c.withColumn("all", F.sum("n").over(w)).withColumn("gamma", F.sum("d").over(w) / F.col("all"))
        if lower is None:
            below = F.lit(1.0 / CLASSES)
        else:
            low = lower.select("model", F.col("code").alias("tail"), F.col("p").alias("plow"))
            c = c.withColumn("tail", F.col("code").bitwiseAND(F.lit((1 << (BITS * (o - 1))) - 1))).join(low, ["model", "tail"])
            below = F.col("plow")
        c = c.withColumn("p", (F.col("n") - F.col("d")) / F.col("all") + F.col("gamma") * below)
        lower = c.select("model", "code", "p", "h", "gamma").checkpoint()
        out.append(lower)
    return out


class HashedSlice:
    """Sorted hash array of 4-grams with their log-probabilities."""

    def __init__(self, code: np.ndarray, logp: np.ndarray):
        keys = mix64(code.astype(np.int64).view(np.uint64))  # a bijection, so no two n-grams share a key
        order = np.argsort(keys)
        self.keys, self.logp = keys[order], logp[order].astype(np.float64)

    def score(self, codes: np.ndarray) -> np.ndarray:
        want = mix64(codes)
        at = np.minimum(np.searchsorted(self.keys, want), max(0, len(self.keys) - 1))
        if len(want) and not (len(self.keys) and np.array_equal(self.keys[at], want)):
            raise RuntimeError("the input changed its order between two reads; write it to files first")
        return self.logp[at]


def slice_scores(texts: list[str], lang: list[str], model: dict[str, HashedSlice]) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the log-probabilities of all characters, number of letters and digits) of each text."""
    total, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for m, own in by_language(texts, lang):
        mine = [texts[i] for i in own]
        for part in parts_of(mine):
            code, doc = codes_of(mine[part])
            if len(code):
                rows = own[part]
                total[rows] = per_text(model[m].score(code), doc, len(rows))
                size[rows] = np.bincount(doc[_LETTER[code & np.uint64(CLASSES - 1)]], minlength=len(rows))
    return total, size


def base_counts(texts: list[str]) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(texts)
    w = Words(texts)
    n_words = np.diff(w.first) if n else np.zeros(0, np.int64)
    lead = np.concatenate([[0], np.cumsum(((w.data & 0xC0) != 0x80) & ~w.space)])
    chars = per_text(lead[w.end] - lead[w.start], w.doc, n)
    sym = np.zeros(256, bool)
    sym[list(SYMBOLS)] = True
    of = np.concatenate([[0], np.cumsum(sym[w.data])])
    edges = np.concatenate([[0], w.ends])
    n_sym = np.diff(of[edges]) if n else np.zeros(0, np.int64)
    dup = np.fromiter((_dup_lines(t) for t in texts), np.int64, n)
    at, win = w.windows(w.hashes(), 5)
    repeat = np.zeros(n, np.int64)
    if len(at):
        doc = w.doc[at]
        order = np.lexsort((win, doc))
        same = (win[order][1:] == win[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(w) + 5, np.int64)
        hit = at[twice]
        cover[hit] += 1
        cover[hit + 5] -= 1  # a window starts once, so no index repeats
        repeat = per_text(np.cumsum(cover)[: len(w)] > 0, w.doc, n).astype(np.int64)
    return n_words, chars.astype(np.int64), n_sym, dup, repeat


def _dup_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


MODEL, SCORED = "__model", "__n_scored"  # names that no kept column has
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain_scan(docs: DataFrame) -> bool:
    """Whether a second read gives the same rows in the same tasks: files or local rows, without a shuffle."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Exchange", "InMemoryTableScan", "Python", "Arrow"))


def scored_rows(docs: DataFrame, grams: DataFrame, top: DataFrame, text_col: str, lang_col: str, keep: list[str], pack_bytes: int = PACK) -> DataFrame:
    """Columns ``keep`` with METRICS, MODEL, SCORED and log_perplexity: each pack with its slice of the model."""
    fields = [T.StructField(c, T.LongType()) for c in METRICS]
    fields += [T.StructField(MODEL, T.StringType()), T.StructField(SCORED, T.LongType()), T.StructField("log_perplexity", T.DoubleType())]
    src = docs.select(F.col(f"`{text_col}`").alias("__text"), language_key(lang_col).alias("__lang"), *[F.col(f"`{c}`") for c in keep if c != text_col])
    schema = T.StructType([docs.schema[c] for c in keep] + fields)
    others = [c for c in keep if c != text_col]

    def pack_up(batches):
        let_go()
        for pack, rows in packs(batches, pack_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                for batch in rows:
                    out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["pack", "data"])
        let_go()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        let_go()
        model = {}
        for m in pc.unique(right.column("model")).to_pylist():
            own = right.filter(pc.equal(right.column("model"), m))
            model[m] = HashedSlice(own.column("code").to_numpy(), own.column("logp").to_numpy())
        out = []
        for data in left.column("data"):
            for batch in pa.ipc.open_stream(data.as_buffer()):
                texts, lang = texts_of(batch.column(0)), batch.column(1).to_pylist()
                total, size = slice_scores(texts, lang, model)
                base = [longs(np.concatenate(x)) for x in zip(*(base_counts(texts[part]) for part in parts_of(texts)))]
                mean = pa.array(-total / np.maximum(size, 1), pa.float64(), mask=size == 0)
                kept = [batch.column(0) if c == text_col else batch.column(2 + others.index(c)) for c in keep]
                arrays = [*kept, *base, pa.array(lang, pa.string()), longs(size), mean]
                out.append(pa.RecordBatch.from_arrays(arrays, names=schema.names))
        return pa.Table.from_batches(out)

    small_batches(docs.sparkSession)
    left = src.mapInArrow(pack_up, "pack long, data binary")
    right = grams.join(top.select("model", "code", F.log("p").cast("float").alias("logp")), ["model", "code"]).select("pack", "model", "code", "logp")
    return left.groupBy("pack").cogroup(right.groupBy("pack")).applyInArrow(score, schema)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep: list[str] | None = None,
    pack_bytes: int = PACK,
) -> DataFrame:
    """Columns ``keep`` (default: id) with the base counts, base_failed, kept, log_perplexity and z, which replace kept columns of their names."""
    made = [*METRICS, "base_failed", "kept", "log_perplexity", "z"]
    keep = [c for c in ([id_col] if keep is None else keep) if c not in made]
    docs = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col, lang_col])])
    if not plain_scan(docs):
        docs = stored(docs, "quality-input")
    grams = count_ngrams(docs, text_col, lang_col, pack_bytes)
    top = kneser_ney(grams)[-1]
    scored = stored(scored_rows(docs, grams, top, text_col, lang_col, keep, pack_bytes), "perplexity")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    band = bands(scored.select(F.col(MODEL).alias("model"), F.col(SCORED).alias("n_scored"), "log_perplexity", "base_failed"))
    band = band.select(F.col("model").alias(MODEL), F.col("middle").alias("__middle"), F.col("spread").alias("__spread"))
    z = (F.col("log_perplexity") - F.col("__middle")) * weight(F.col(SCORED)) / F.col("__spread")
    inside = F.coalesce((F.col("z") >= -LOWER) & (F.col("z") <= UPPER), F.lit(True))
    return (
        join_small(scored, band, MODEL, "left")
        .withColumn("z", z)
        .withColumn("kept", ~F.col("base_failed") & inside)
        .select(*[f"`{c}`" for c in keep], *made)
    )


def weight(n):
    """Root of a length that stops growing near LENGTH: longer texts differ by more than chance."""
    return F.sqrt(n * LENGTH / (n + LENGTH))


def bands(scored: DataFrame) -> DataFrame:
    """(model, middle, spread) of written scores: a row for each language that has a scored document past the base rules.

    Medians come from counts over cells of 1/512 nat and of 1/64 spread unit: partial aggregates of all documents.
    """
    use = scored.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull()).select("model", "n_scored", "log_perplexity").distinct()

    def median(x, step):
        cells = x.groupBy("model", F.floor(F.col("v") / step).alias("cell")).agg(F.count("*").alias("n"))
        w = Window.partitionBy("model")
        upto = F.sum("n").over(w.orderBy("cell"))
        cells = cells.withColumn("upto", upto).withColumn("all", F.sum("n").over(w))
        return cells.where(2 * F.col("upto") >= F.col("all")).groupBy("model").agg(((F.min("cell") + 0.5) * step).alias("m"), F.max("all").alias("n"))

    mid = median(use.select("model", F.col("log_perplexity").alias("v")), 1 / 512).select("model", F.col("m").alias("middle")).checkpoint()
    off = join_small(use, mid, "model").select("model", (F.abs(F.col("log_perplexity") - F.col("middle")) * weight(F.col("n_scored"))).alias("v"))
    own = F.pow(F.col("m") * 1.4826, 2)
    spread = median(off, 1 / 64).select("model", F.sqrt((F.col("n") * own + PRIOR * SPREAD**2) / (F.col("n") + PRIOR)).alias("spread"))
    return mid.join(spread, "model").checkpoint()


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents: base counts and the perplexity verdict."""
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *METRICS, "base_failed", "kept", "log_perplexity", "z")
