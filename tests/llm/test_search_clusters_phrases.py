"""Operators 11 to 13 against brute-force versions, with odd rows, hot groups and ties."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from attriscope.llm import op11_inverted_multi_index as t11
from attriscope.llm import op12_orchard_clusters as t12
from attriscope.llm import op13_phrases as t13
from attriscope.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = [(900, None), (901, []), (902, [0.0] * 6), (903, [1.0, None, 0, 0, 0, 0]), (904, [float("nan")] + [1.0] * 5), (905, [float("inf")] * 6)]


def frame(spark, rows):
    """Vectors with extra columns that clash with names inside the operators."""
    data = [(i, v and [None if x is None else float(x) for x in v], "extra", 1, 0.5, [1]) for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, node string, rank int, score double, ids array<int>")


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


# ---- op11 -------------------------------------------------------------------------------------


def brute_search(rows, every, top):
    good = [(i, n, np.array(v, float)) for n, (i, v) in enumerate(rows) if usable(v) and any(v)]
    out = []
    for i, n, q in good:
        if i is None or i % every:
            continue
        with np.errstate(all="ignore"):
            found = [(float((q * x).sum()), j) for j, m, x in good if m != n and len(x) == len(q)]
        found.sort(key=lambda f: (f[0] != f[0], -f[0] if f[0] == f[0] else 0, f[1] is None, f[1] or 0))
        out += [(i, k + 1, j, repr(s)) for k, (s, j) in enumerate(found[:top])]
    return collections.Counter(out)


def got_search(df, **more):
    return collections.Counter((r[0], r[1], r[2], repr(r[3])) for r in t11.search(df, **more).collect())


@pytest.mark.parametrize("probe,block,per_cell,queries", [(2048, 32768, 256, 1024), (12, 20, 4, 3)])
def test_index_equals_brute_force(spark, monkeypatch, probe, block, per_cell, queries):
    for name, v in (("PROBE", probe), ("BLOCK", block), ("PER_CELL", per_cell), ("QUERIES", queries)):
        monkeypatch.setattr(t11, name, v)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 6))
    rows = [(i, (np.round(centres[i % 9] + rng.normal(scale=0.1, size=6), 3) * (1 + i % 3)).tolist()) for i in range(200)]
    rows += [(300 + i, [1.0, 0, 0, 0, 0, 0]) for i in range(110)]  # a third of all rows is one vector
    rows += [(-20, [0.5] * 6), (500, [1e200] * 6), (501, [1e200, -1e200, 0, 0, 0, 0]), (520, [1e-200] * 6), (20, rows[20][1]), (None, [1.0] * 6)]
    rows += [*ODD, (600, [1.0, 2.0]), (601, [3.0, 1.0]), (620, [2.0, -1.0]), (640, [4.0]), (641, [0.25])]
    assert got_search(frame(spark, rows), every=20, top=5) == brute_search(rows, 20, 5)


def test_search_of_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])]
    assert got_search(frame(spark, rows)) == brute_search(rows, 20, 20)
    assert t11.search(frame(spark, rows).where("false")).count() == 0
    assert t11.search(frame(spark, ODD)).count() == 0
    assert got_search(frame(spark, [(0, [1.0])])) == collections.Counter()


def test_recall_on_the_table_is_one(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, SF, "embeddings").collect()]
    got = collections.defaultdict(set)
    for r in t11.op11_inverted_multi_index(spark, SF).collect():
        got[r.query_id].add(r.vec_id)
    want = collections.defaultdict(set)
    for q, _, v, _ in brute_search(rows, 20, 20):
        want[q].add(v)
    assert got == want and all(len(v) == 20 for v in got.values())


def test_traversal_order_and_pruning():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(16, 8)), 40, axis=0) + rng.normal(scale=0.01, size=(640, 8))
    index = t11.Index(8, (t11.codebook(x[:, :4], 8), t11.codebook(x[:, 4:], 8)))
    cell, r1, r2 = index.place(x)
    np.add.at(index.count, cell, 1)
    for radius, r, at in ((index.radii[0], r1, cell // 8), (index.radii[1], r2, cell % 8)):
        np.maximum.at(radius, at, r)
    order = list(index.cells(x[0]))
    assert [c for _, c in order] and sorted(c for _, c in order) == sorted(np.flatnonzero(index.count).tolist())
    assert all(a >= b for (a, _), (b, _) in zip(order, order[1:]))
    scores = x @ x[0]
    for bound, c in order:
        assert scores[cell == c].max() <= bound
    best = np.sort(scores)[-20]
    assert sum(int(index.count[c]) for b, c in order if b >= best) <= 160  # of 640: the rest is never looked at


# ---- op12 -------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dim, scale=64):
    def whole(x):
        return math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale

    kept = [(i, [whole(float(x)) for x in v], v) for i, v in rows if usable(v) and len(v) == dim]
    if not kept:
        return []
    key = lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[2])
    c = [r[1] for r in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))

    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, v, _ in kept:
            of[near(v)[1]].append(v)
        c = [[sum(col) // len(of[j]) for col in zip(*of[j])] if of[j] else w for j, w in enumerate(c)]
    return [(i, near(v)[1], near(v)[0]) for i, v, _ in kept], c


@pytest.mark.parametrize("k", [1, 5, 16])
def test_orchard_equals_brute_force(spark, k):
    random.seed(k)
    rows = [(i, [random.choice([0, 0.5, 1, 1.5]) for _ in range(4)]) for i in range(150)]  # many ties
    rows += [(500 + i, [0.25] * 4) for i in range(80)] + [(7, [0.1, -0.1, 0.3, -7.77]), (None, [1.0, 2.0, 3.0, 4.0]), (8, [1.0] * 3), (9, [1.0] * 5)]
    rows += [(i, v and v[:4]) for i, v in ODD if i != 902]
    got, centroids = t12.clusters(frame(spark, rows), k=k, dim=4)
    want, last = brute_clusters(rows, k, 3, 4)
    assert collections.Counter((r.id, r.cluster, r.distance) for r in got.collect()) == collections.Counter(want)
    assert centroids == last
    assert got.where(f"n_measured > {k} OR n_measured < 1").count() == 0


def test_orchard_on_very_large_components(spark):
    rows = [(i, [1e300 * (i % 3), -1e18 * i, float(i)]) for i in range(12)] + [(50, [1.5e308, 0.0, -0.5]), (51, [2.0**40, 3.0, 4.0])]
    got, centroids = t12.clusters(frame(spark, rows), k=4, dim=3)
    want, last = brute_clusters(rows, 4, 3, 3)
    assert centroids == last
    fits = collections.Counter((i, c, d if d < 1 << 63 else None) for i, c, d in want)
    assert collections.Counter((r.id, r.cluster, r.distance) for r in got.collect()) == fits


def test_orchard_measures_few_centroids_on_separate_clusters(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (100 * np.eye(8)[i % 8] + rng.normal(size=8)).tolist()) for i in range(400)]
    got, _ = t12.clusters(frame(spark, rows), k=8, dim=8, rounds=1)
    want, _ = brute_clusters(rows, 8, 1, 8)
    assert collections.Counter((r.id, r.cluster, r.distance) for r in got.collect()) == collections.Counter(want)
    assert got.agg({"n_measured": "avg"}).first()[0] < 8


def test_clusters_of_few_and_no_rows(spark):
    few = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [3.0, 0.0])])
    got, centroids = t12.clusters(few, dim=2)
    assert len(centroids) == 3 and got.count() == 3
    none, centroids = t12.clusters(few.where("false"), dim=2)
    assert none.count() == 0 and centroids == [] and none.columns == got.columns


# ---- op13 -------------------------------------------------------------------------------------


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_counts(docs, size):
    out = collections.Counter()
    for lang, text in docs:
        for w in pieces_of(text):
            for i in range(len(w) - size + 1):
                out[(lang or "und", tuple(w[i : i + size]))] += 1
    return out


def brute_phrases(docs, least, top, share=50):
    f = brute_counts(docs, 1) + brute_counts(docs, 2) + brute_counts(docs, 3)
    n = collections.Counter()
    for (lang, g), c in f.items():
        n[lang] += c if len(g) == 1 else 0
    found = collections.defaultdict(list)
    for (lang, g), a in f.items():
        if len(g) < 2 or a < least:
            continue
        if len(g) == 2 and any(len(h) == 3 and o == lang and c >= least and g in (h[:2], h[1:]) and 100 * c >= share * a for (o, h), c in f.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return collections.Counter(
        (lang, r + 1, p.decode(), -a, l, right, n[lang], -s) for lang, v in found.items() for r, (s, a, p, l, right) in enumerate(sorted(v)[:top]))


def texts(spark, docs):
    return spark.createDataFrame([(*d, "x", 1, 2, True) for d in docs], "lang string, text string, phrase string, n int, w1 int, last boolean")


def random_docs():
    random.seed(8)
    words = ["a", "b", "B", "cc", "Ünï", "x\x1cy", "😀", " ", "d" * 40]
    seps = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", " ! "]
    docs = [(random.choice(["en", "de", None, "und"]), "".join(random.choice(words) + random.choice(seps) for _ in range(random.randint(0, 60)))) for _ in range(60)]
    same = "the same passage a b cc stands in each of these texts, and a b cc again"
    docs += [("en", same)] * 40 + [("en", same + " a b"), ("de", None), ("de", ""), ("fr", " \t "), ("fr", "...")]
    return docs + [("en", "long " * 30000 + "end"), ("de", "x " * 7 + "\n" + "x " * 5000), ("en", "w" * 100000)]


@pytest.mark.parametrize("mean", [1, 3, 24])
def test_parse_counts_each_ngram_once(spark, monkeypatch, mean):
    monkeypatch.setattr(t13, "BATCH_BYTES", 1 << 12)
    docs = random_docs()
    dictionary = t13.parse(texts(spark, docs), mean=mean).cache()
    assert dictionary.where("times >= 40").count() > 0  # the repeated text is stored once
    tables = [None]
    for size in (1, 2, 3):
        got = t13.count_phrases(dictionary, size, *tables[1:])
        counts = {(r[0], tuple(r[1 : size + 1])): r["f"] for r in got.collect()}
        want = brute_counts(docs, size)
        assert counts == dict(want)
        if size < 3:
            tables.append(t13.bit_table(got, [f"w{i + 1}" for i in range(size)]))


def test_phrases_equal_brute_force(spark):
    docs = random_docs()
    for least, top in ((10, 2000), (2, 7)):
        got = collections.Counter(map(tuple, t13.collocations(texts(spark, docs), least=least, top=top).collect()))
        assert got == brute_phrases(docs, least, top)


def test_phrases_of_nothing(spark):
    df = texts(spark, [("en", None), (None, ""), ("de", "one two three")])
    assert t13.collocations(df).count() == 0
    assert t13.collocations(df.where("false")).count() == 0


def test_counts_past_64_bits(spark):
    dictionary = spark.createDataFrame([("en", True, "new york", 6 * 10**12)], "lang string, last boolean, chunk string, times long")
    import unittest.mock as mock

    with mock.patch.object(t13, "parse", lambda *a, **k: dictionary):
        (row,) = t13.collocations(texts(spark, [])).collect()
    assert tuple(row) == ("en", 1, "new york", 6 * 10**12, 6 * 10**12, 6 * 10**12, 12 * 10**12, 1000000)
