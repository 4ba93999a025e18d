"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into runs of ``STEPS`` bytes; over each run one GRU goes forwards and one
backwards, and every position gets a softmax over the languages from both
states.  A document's probabilities are the means over all its positions, so
the whole text counts, whatever its length.

The network is trained in numpy by backpropagation through time (Adam, cross
entropy at every position) on a bounded sample: about ``TRAIN_DOCS`` documents a language,
``PIECES`` runs of each from places spread over the whole text, and never more
than ``2 * TRAIN_DOCS`` documents a language.  Every labelled language is learned.

Edge cases: a text that is null or has no letter is ``und`` with score 1; if
nothing can be learned all texts are ``und``, with score 0 where there is a letter;
a null id is not held out and is not learned from; repeated rows get equal
results; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attriscope.llm.common import annotate, table, texts_of

HIDDEN, STEPS, PIECES = 10, 64, 12
TRAIN_DOCS = 400
EPOCHS, MIN_STEPS, BATCH, RATE = 4, 250, 256, 0.02  # a small sample is gone through more often, for at least MIN_STEPS batches
SEED = 4


class Network:
    """Weights: by direction, gate tables by byte x (2, 3H, 256) and recurrent u (2, 3H, H) in the order z, r, n; readout w (L, 2H), c (L)."""

    def __init__(self, langs: list[str], rng: np.random.Generator):
        h, n = HIDDEN, len(langs)
        self.langs = langs
        self.p = {
            "x": rng.normal(0, 0.3, (2, 3 * h, 256)).astype(np.float32),
            "u": rng.normal(0, 1 / np.sqrt(h), (2, 3 * h, h)).astype(np.float32),
            "b": np.zeros((2, h, 1), np.float32),
            "w": rng.normal(0, 1 / np.sqrt(2 * h), (n, 2 * h)).astype(np.float32),
            "c": np.zeros((n, 1), np.float32),
        }

    def states(self, data: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Hidden states (T, 2, H, B) of byte runs ``data`` (T, B); the second direction is stored in reading order."""
        h, p = HIDDEN, self.p
        steps, width = data.shape
        out = np.empty((steps, 2, h, width), np.float32)
        s = np.zeros((2, h, width), np.float32)
        g = np.empty((2, 3 * h, width), np.float32)
        zr = np.empty((2, 2 * h, width), np.float32)
        for t in range(steps):
            np.take(p["x"][0], data[t], axis=1, out=g[0], mode="clip")
            np.take(p["x"][1], data[steps - 1 - t], axis=1, out=g[1], mode="clip")
            a = np.matmul(p["u"], s)
            np.add(g[:, : 2 * h], a[:, : 2 * h], out=zr)
            zr *= 0.5  # the logistic function by tanh
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            an = a[:, 2 * h :] + p["b"]
            n = np.tanh(g[:, 2 * h :] + zr[:, h:] * an)
            new = n + zr[:, :h] * (s - n)
            if trace is not None:
                trace.append((s, zr.copy(), an, n))
            s = new
            out[t, 0] = s[0]
            out[steps - 1 - t, 1] = s[1]
        return out

    def log_probs(self, states: np.ndarray) -> np.ndarray:
        """Softmax numerators' normalised probabilities (T, L, B)."""
        steps, _, h, width = states.shape
        logit = np.matmul(self.p["w"], states.reshape(steps, 2 * h, width)) + self.p["c"]
        logit -= logit.max(axis=1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(axis=1, keepdims=True)
        return logit

    def gradients(self, data: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean cross entropy of all unmasked positions."""
        h, p = HIDDEN, self.p
        steps, width = data.shape
        trace: list = []
        st = self.states(data, trace)
        d = self.log_probs(st)
        d[:, y, np.arange(width)] -= 1
        d *= (mask / max(1, mask.sum()))[:, None, :].astype(np.float32)
        flat = st.reshape(steps, 2 * h, width)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["w"] = np.einsum("tlb,thb->lh", d, flat, optimize=True)
        g["c"] = d.sum(axis=(0, 2))[:, None]
        up = np.matmul(p["w"].T, d).reshape(steps, 2, h, width)
        carry = np.zeros((2, h, width), np.float32)
        for t in range(steps - 1, -1, -1):
            s, zr, an, n = trace[t]
            z, r = zr[:, :h], zr[:, h:]
            dh = carry + np.stack([up[t, 0], up[steps - 1 - t, 1]])
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (s - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            dan = dn * r
            da = np.concatenate([dz, dr, dan], axis=1)
            g["u"] += np.matmul(da, s.transpose(0, 2, 1))
            g["b"] += dan.sum(axis=2, keepdims=True)
            carry = dh * z + np.matmul(p["u"].transpose(0, 2, 1), da)
            dx = np.concatenate([dz, dr, dn], axis=1)
            for k, byte in enumerate((data[t], data[steps - 1 - t])):
                one = np.zeros((width, 256), np.float32)
                one[np.arange(width), byte] = 1
                g["x"][k] += dx[k] @ one
        return g

    def pooled(self, texts: list[bytes], width: int = 2048) -> np.ndarray:
        """(texts, L): mean probabilities over all bytes of each text; 0 for an empty one."""
        runs = [-(-len(t) // STEPS) for t in texts]
        data = np.zeros((sum(runs), STEPS), np.uint8)
        size = np.zeros(len(data), np.int64)
        at = 0
        for t, n in zip(texts, runs):
            data[at : at + n].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
            size[at : at + n] = STEPS
            if n:
                size[at + n - 1] = len(t) - STEPS * (n - 1)
            at += n
        doc = np.repeat(np.arange(len(texts)), runs)
        total = np.zeros((len(texts), len(self.langs)))
        for a in range(0, len(data), width):
            part = np.ascontiguousarray(data[a : a + width].T).astype(np.intp)
            prob = self.log_probs(self.states(part))
            prob *= (np.arange(STEPS)[:, None] < size[a : a + width])[:, None, :]
            of = prob.sum(axis=0)
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(doc[a : a + width], weights=of[k], minlength=len(texts))
        return total / np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))[:, None]


def train(runs: list[bytes], y: np.ndarray, langs: list[str], epochs: int = EPOCHS) -> Network:
    """A network fitted to labelled byte runs (each at most ``STEPS`` bytes)."""
    rng = np.random.default_rng(SEED)
    net = Network(langs, rng)
    data = np.zeros((STEPS, len(runs)), np.intp)
    mask = np.zeros((STEPS, len(runs)))
    for i, r in enumerate(runs):
        data[: len(r), i] = np.frombuffer(r, np.uint8)
        mask[: len(r), i] = 1
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    batches = -(-len(runs) // BATCH)
    epochs = max(epochs, -(-MIN_STEPS // batches))
    steps = epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(runs))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            for k, g in net.gradients(data[:, pick], mask[:, pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def sample_runs(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[bytes], np.ndarray, list[str]]:
    """The bounded training sample: runs, class indices and languages (by code point)."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    src = src.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).where(~held_out("id"))
    counts = src.groupBy("lang").agg((TRAIN_DOCS / F.count("*")).alias("share"))  # one row a language
    h = F.xxhash64("id", F.lit(SEED))
    u = F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))
    place = F.transform(
        F.sequence(F.lit(0), F.lit(PIECES - 1)),
        lambda k: F.col("text").substr((k * F.length("text") / PIECES).cast("int") + 1, F.lit(STEPS)),
    )
    rows = src.join(F.broadcast(counts), "lang").where(u < F.col("share")).select("lang", h.alias("h"), place.alias("runs"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # more than the share come when ids repeat
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= 2 * TRAIN_DOCS).orderBy("h", "lang").collect()
    langs = sorted({r["lang"] for r in rows})
    index = {lang: i for i, lang in enumerate(langs)}
    runs, y = [], []
    for r in rows:
        for t in r["runs"]:
            b = t.encode("utf-8", "surrogatepass")[:STEPS]
            if b:
                runs.append(b)
                y.append(index[r["lang"]])
    return runs, np.array(y, np.int64), langs


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: id) with held_out, lang_pred and score."""
    keep = [id_col] if keep is None else keep
    runs, y, langs = sample_runs(docs, id_col, text_col, lang_col)
    net = train(runs, y, langs) if langs else None
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def make():
        net = shared.value

        def run(text):
            texts = texts_of(text)
            letter = [any(map(str.isalpha, t)) for t in texts]
            if net is None:
                yield pa.array(["und"] * len(texts), pa.string())
                yield pa.array([0.0 if x else 1.0 for x in letter], pa.float64())
                return
            prob = net.pooled([t.encode("utf-8", "surrogatepass") if x else b"" for t, x in zip(texts, letter)])
            best = prob.argmax(axis=1)
            yield pa.array([net.langs[b] if x else "und" for b, x in zip(best, letter)], pa.string())
            yield pa.array(np.where(letter, np.minimum(1.0, prob.max(axis=1)), 1.0), pa.float64())

        return run

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    src = docs.withColumn("held_out", held_out(id_col))
    out = annotate(src, [text_col], fields, make, [*[c for c in keep if c != "held_out"], "held_out"], chunk_bytes=2 << 20)
    return out


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """All documents; learned from those that are not held out."""
    return identify(table(spark, sf_dir, "documents"))
