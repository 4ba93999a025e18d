"""Each operator against a brute-force version, on small frames and on the sf0.001 tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from attriscope.llm import op1_token_counts as t1
from attriscope.llm import op2_cover_tree as t2
from attriscope.llm import op3_license_scan as t3
from attriscope.llm import op4_language_id as t4
from attriscope.llm import op5_quality_rules as t5
from attriscope.llm import op6_sentencepiece as t6
from attriscope.llm import op7_mixing as t7
from attriscope.llm import op8_html_extraction as t8
from attriscope.llm import op9_simhash as t9
from attriscope.llm import op10_quality_classifier as t10
from attriscope.llm.common import components, kth_largest
from attriscope.session import work_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def bag(df):
    return collections.Counter(map(tuple, df.collect()))


# ---- helpers ----------------------------------------------------------------------------------


def test_components_on_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(1, i) for i in range(2, 40)] + [(50, 51), (51, 51)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 131)) and all(got[i] == 1 for i in range(1, 40)) and got[51] == 50


def test_kth_largest_is_exact(spark):
    random.seed(1)
    v = [random.choice([random.gauss(0, 1), random.gauss(0, 1) * 1e300, 0.5]) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in v], "score double")
    for k in (1, 2, 77, 250, 499, 500):
        assert kth_largest(df, k) == sorted(v, reverse=True)[k - 1]


# ---- op1 --------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    cache = work_path(spark, "test_cache")
    got = bag(t1.count_tokens(docs, BPE, cache).select("doc_id", "n_bytes", "n_tokens", "over_limit"))
    want = collections.Counter()
    for r in docs.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want[(r.doc_id, len((r.text or "").encode()), n, n > 1024)] += 1
    assert got == want
    stored = spark.read.parquet(cache).count()
    assert stored == docs.na.fill("", ["text"]).select("text").distinct().count()  # copies are encoded once
    assert bag(t1.count_tokens(docs, BPE, cache)) == want
    assert spark.read.parquet(cache).count() == stored  # nothing is missed a second time
    assert t1.count_tokens(empty, BPE, cache).count() == 0


def test_rank_encoder_equals_the_library_on_odd_texts():
    from tokenizers import Tokenizer

    random.seed(2)
    tok, fast = Tokenizer.from_file(BPE), t1.Counter(BPE)
    chars = "ab Z9'  \n\t.,é漢😀  <|endoftext|>"
    texts = ["".join(random.choice(chars) for _ in range(random.randint(0, 60))) for _ in range(2000)]
    texts += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "they'll we've I'm", "   \n\n  x"]
    assert fast.count(texts) == [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizer_files():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    assert t1.Counter(path).count(["a b", ""]) == [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(["a b", ""])]
    assert t1.Counter(public_tokenizers.path("word_bpe_49k.json")).count(["Hello there", ""])[1] == 0


# ---- op2 --------------------------------------------------------------------------------------


def brute_links(rows, t=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in rows]
    links, comp = {k: 0 for k in range(len(rows))}, list(range(len(rows)))
    of = [k for k, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= t:
                links[of[a]] += 1
                links[of[b]] += 1
                p, q = comp[of[a]], comp[of[b]]
                comp = [min(p, q) if c in (p, q) else c for c in comp]
    least = {}
    for k, c in enumerate(comp):
        least[c] = min(least.get(c, ids[k]), ids[k])
    return collections.Counter((ids[k], links[k], least[comp[k]], ids[k] == least[comp[k]]) for k in range(len(rows)))


@pytest.mark.parametrize("block", [4096, 16])
def test_cover_tree_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(t2, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + rng.normal(scale=0.03 if i % 2 else 0.4, size=6)).tolist()) for i in range(150)]
    rows += [(200 + i, [1.0, 0, 0, 0, 0, 0]) for i in range(20)] + [(230, [2.0, 0, 0, 0, 0, 0]), (231, [-1.0, 0, 0, 0, 0, 0])]
    rows += [(240, None), (241, []), (242, [0.0] * 6), (243, [1.0, None, 0, 0, 0, 0]), (244, [float("nan")] + [1.0] * 5), (245, [float("inf")] * 6), (246, [1.0, 0.0])]
    rows += [(247, [1.0, 0.0]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], "extra", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, n long")
    assert bag(t2.near_duplicates(df)) == brute_links(rows)
    assert t2.near_duplicates(df.where("false")).count() == 0


def test_vectors_of_any_length_link(spark):
    """Squares of these components over- or underflow; the direction alone decides."""
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.0001e200]), (3, [1e-200, 1e-200]), (4, [1e-200, 1.0001e-200]), (5, [5e-324, 0.0]), (6, [1.7e308, 1.0]), (7, [-1e200, 1e200])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in t2.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_traversal_prunes_separate_clusters():
    rng = np.random.default_rng(4)
    c = np.eye(8)
    x = np.repeat(c, 50, axis=0) + rng.normal(scale=0.01, size=(400, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    centre, levels = t2.centres(x, 8, 0.1)
    leaf = (x @ centre.T).argmax(1)
    radius = np.array([np.sqrt(np.maximum(0, 2 - 2 * x[leaf == k] @ centre[k])).max() for k in range(8)])
    parent, cover = t2._tree(centre, levels, radius)
    assert t2.traverse(centre, levels, parent, cover, math.sqrt(0.1)) == [(k, k) for k in range(8)]


# ---- op3 --------------------------------------------------------------------------------------


def test_license_rules(spark, docs):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"
    bsd = ". ".join(t3.SENTENCES[k] for k in (20, 21, 22))
    swapped = ". ".join(t3.SENTENCES[k] for k in (22, 21, 20))
    rows = [(1, mit), (2, bsd + "."), (3, swapped), (4, "text\nLicensed under CC BY-NC 4.0.\nmore"), (5, bsd + ". Other words. " + t3.SENTENCES[23]), (6, None), (7, "the license of a licensed driver")]
    got = {r.doc_id: r.licenses for r in t3.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["BSD-2-Clause"], 3: [], 4: ["CC-BY-NC-4.0"], 5: ["BSD-2-Clause", "BSD-3-Clause"], 6: [], 7: []}
    out = t3.scan(docs)
    assert out.columns == docs.columns + ["licenses", "n_licenses", "sentence_ids"] and out.count() == docs.count()
    assert {r.doc_id for r in out.where("n_licenses > 0").collect()} == {10}


NOTICES = {
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.": ["GPL-3.0"],
    "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n": ["LGPL-2.1"],
    " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n"
    " * version 2.1 of the License, or (at your option) any later version.\n": ["LGPL-2.1"],
    "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU Affero General Public License as published\n    by the Free Software Foundation, either version 3 of the License, or\n"
    "    (at your option) any later version.\n\n    This program is distributed in the hope": ["AGPL-3.0"],
    "# This program is free software; you can redistribute it and/or\n# modify it under the terms of the GNU General Public License\n# as published by the Free Software Foundation; either version 2\n"
    "# of the License, or (at your option) any later version.\n": ["GPL-2.0"],
    "// SPDX-License-Identifier: GPL-2.0-or-later\n#include <x.h>": ["GPL-2.0"],
    "/* SPDX-License-Identifier: BSD-2-Clause */\nint x;": ["BSD-2-Clause"],
    "# SPDX-License-Identifier: (MIT OR Apache-2.0)\n": ["Apache-2.0", "MIT"],
    "/* SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0 AND (ISC or Zlib) */": ["GPL-2.0", "ISC", "Zlib"],
    "SPDX-License-Identifier: Own-1.0": [],
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.\n": ["Apache-2.0", "MIT"],
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS": ["Apache-2.0"],
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright\n"
    "   notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright\n   notice, this list of conditions and the following disclaimer in the\n"
    "   documentation and/or other materials provided with the distribution.\n3. Neither the name of the University nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n"
    "   without specific prior written permission.\n": ["BSD-2-Clause", "BSD-3-Clause"],
    " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n": ["MPL-2.0"],
    "This software is provided 'as-is', without any express or implied\nwarranty. In no event\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\n"
    "freely, subject to the following restrictions:\n\n1. The origin": ["Zlib"],
    "Permission is granted by the library. Use of licences is distributed.": [],
}


def test_license_notices_in_both_engines(spark):
    """Notices as they stand in files: wrapped lines, comment marks, SPDX expressions, a holder's own name; texts before and after."""
    import duckdb

    pad = "Words that are no licence. " * 3
    rows = [(i, pad + "\n\n" + text + "\n\n" + pad) for i, text in enumerate(NOTICES)] + [(i + 100, t) for i, t in enumerate(NOTICES)]
    df = spark.createDataFrame([*rows, (-1, None), (-2, ""), (-3, pad * 20000)], "doc_id long, text string")
    got = {r.doc_id: r for r in t3.scan(df).collect()}
    for i, want in enumerate(NOTICES.values()):
        assert sorted(got[i].licenses) == sorted(got[i + 100].licenses) == sorted(want), list(NOTICES)[i]
    assert [got[k].licenses for k in (-1, -2, -3)] == [[], [], []]
    documents = df.toArrow()  # noqa: F841  read by the SQL below
    sql = {r[0]: r[1:] for r in duckdb.sql(t3.OP3_SQL).fetchall()}
    assert sql == {k: (",".join(r.licenses), r.n_licenses, r.sentence_ids) for k, r in got.items()}


def test_license_tables_are_arguments(spark):
    own = t3.known({1: "You may use this under the House License"}, ["House-1.0"], [("House", [(1,)]), ("House", [(t3.FIRST_TERM,)])])
    df = spark.createDataFrame([(1, "Notice. You may use this under\nthe House License."), (2, "SPDX-License-Identifier: House-1.0"), (3, "MIT License")], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in t3.scan(df, using=own).collect()} == {1: ["House"], 2: ["House"], 3: []}
    with pytest.raises(ValueError):
        t3.known({1: "no word of the kind"}, [], [])


def test_license_table_is_whole():
    used = {i for _, places in t3.TEXT_RULES for p in places for i in p}
    assert used <= set(t3.SENTENCES) and len(t3.LICENSES) >= 40 and len(dict(t3.GIVEN.terms)) == len(t3.SPDX)


# ---- op4 --------------------------------------------------------------------------------------


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(5)
    net = t4.Network(["a", "b", "c"], rng)
    data, y = rng.integers(0, 256, (9, 4)), np.array([0, 1, 2, 1])
    mask = np.ones((9, 4))
    mask[6:, 2] = 0

    def loss():
        p = net.log_probs(net.states(data))[:, y, np.arange(4)].astype(np.float64)
        return float(-(np.log(p) * mask).sum() / mask.sum())

    g = net.gradients(data, mask, y)
    for name, at in (("u", (0, 3, 2)), ("u", (1, 25, 4)), ("b", (1, 2, 0)), ("w", (2, 7)), ("c", (1, 0)), ("x", (0, 14, int(data[2, 0]))), ("x", (1, 22, int(data[3, 1])))):
        old = net.p[name][at]
        net.p[name][at] = old + 5e-3
        up = loss()
        net.p[name][at] = old - 5e-3
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 1e-2 - g[name][at]) < 2e-3


def test_language_of_held_out_documents(spark, docs, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = t4.identify(d, keep=["doc_id", "lang"]).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.9 and all(0 <= r.score <= 1 for r in got)
    small = {r.doc_id: r for r in t4.identify(docs).collect()}
    assert small[3].lang_pred == small[4].lang_pred == small[5].lang_pred == "und" and small[None].held_out is False
    assert t4.identify(empty).count() == 0
    assert {r.lang_pred for r in t4.identify(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def test_every_labelled_language_is_learned(spark):
    rows = [(i, chr(0x4E00 + 50 * (i % 40)) * 30, f"l{i % 40:02}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, y, langs = t4.sample_runs(df, "doc_id", "text", "lang")
    assert langs == [f"l{i:02}" for i in range(40)] and len(set(y.tolist())) == 40


def test_pooling_covers_the_whole_text():
    net = t4.Network(["a", "b"], np.random.default_rng(6))
    text = bytes(range(256)) * 3 + b"tail"
    whole = net.pooled([text, b"", text[:70]])
    parts = [net.pooled([text[i : i + t4.STEPS]])[0] * len(text[i : i + t4.STEPS]) for i in range(0, len(text), t4.STEPS)]
    assert np.allclose(whole[0], sum(parts) / len(text), atol=1e-6) and whole[1].sum() == 0


# ---- op5 --------------------------------------------------------------------------------------


def brute_base(t):
    t = t or ""
    w = WORD.findall(t)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        dup += x in seen and bool(WORD.search(x))
        seen.add(x)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover)


def test_base_counts_equal_brute_force(spark, docs):
    random.seed(7)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [r.text for r in docs.collect()]
    texts += ["".join(random.choice("ab #é\n\r\x0b\x1c") for _ in range(random.randint(0, 90))) for _ in range(500)]
    got = list(zip(*(x.tolist() for x in t5.base_counts([t or "" for t in texts]))))
    assert got == [brute_base(t) for t in texts]


def brute_kn(codes):
    """Modified Kneser-Ney by dictionaries: probability of a 4-gram tuple's last class."""
    k, n = t5.CLASSES, t5.ORDER
    grams = {n: collections.Counter(codes)}
    for o in range(n - 1, 0, -1):
        grams[o] = collections.Counter(g[1:] for g in grams[o + 1])
    disc = {}
    for o, c in grams.items():
        m = collections.Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + m[2] else None
        disc[o] = [max(0.05, min(i - 0.05, i - (i + 1) * y * m[i + 1] / m[i] if y is not None and m[i] else 0.5 * i)) for i in (1, 2, 3)]

    def prob(g):
        o = len(g)
        if not o:
            return 1 / k
        own = {x: v for x, v in grams[o].items() if x[:-1] == g[:-1]}
        if not own:
            return prob(g[1:])
        total = sum(own.values())
        d = lambda v: disc[o][min(v, 3) - 1]
        have = own.get(g, 0)
        return (have - d(have) if have else 0) / total + sum(map(d, own.values())) / total * prob(g[1:])

    return prob


def test_kneser_ney_equals_brute_force(spark):
    text = "the cat sat on the mat. The cat ran at the rat; THAT is that!! \u0448\U0001f600"
    df = spark.createDataFrame([(1, text, "en"), (2, None, "en"), (3, "der Hund", "de")], "doc_id long, text string, lang string")
    grams = t5.count_ngrams(df, "text", "lang")
    orders = [x.toPandas() for x in t5.kneser_ney(grams)]
    unit = (1 << t5.BITS) - 1
    split = lambda c, o=4: tuple((int(c) >> (t5.BITS * (o - 1 - i))) & unit for i in range(o))
    codes = t5.codes_of([text, ""])[0]
    prob = brute_kn([split(c) for c in codes])
    for o, x in enumerate(orders, 1):
        x = x[x.model == "=en"]
        want = {split(c, 4)[4 - o:] for c in codes}
        got = {split(np.int64(c).view(np.uint64), o): p for c, p in zip(x.code, x.p)}
        assert set(got) == want and all(abs(p - prob(g)) < 1e-9 for g, p in got.items())
    # the scores of whole texts are the sums of these logarithms for each letter
    out = {r.doc_id: r for r in t5.quality_rules(df).collect()}
    letters = sum((x >> 8 > 0) or chr(x).isalnum() for x in np.frombuffer(text.encode("utf-16-le"), "<u2").tolist())
    assert abs(out[1].log_perplexity + sum(math.log(prob(split(c))) for c in codes) / letters) < 1e-4
    assert out[2].log_perplexity is None


def test_packs_and_order_change_no_verdict(spark, docs):
    """Many small packs, one pack, or an input that comes from a shuffle: the same rows."""
    src = docs.select("doc_id", "text", "lang")
    want = sorted(map(str, t5.quality_rules(src).collect()))
    assert sorted(map(str, t5.quality_rules(src, pack_bytes=100).collect())) == want
    assert sorted(map(str, t5.quality_rules(src.repartition(5), pack_bytes=500).collect())) == want


def invented(n, syllables, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    return [" ".join(word() for _ in range(r.randint(40, 300))) for _ in range(n)]


def test_bands_reject_symbols_and_tables_in_any_language(spark):
    """Junk goes and prose stays; a rare language's verdicts are the same alone and beside a large one."""
    many = ["the", "an", "re", "on", "er", "st", "ing", "ed", "ou"]
    rows = [(i, t, "en") for i, t in enumerate(invented(400, many, 1))]
    rows += [(1000 + i, " ".join(w + "%#$&"[j % 4] * 3 for j, w in enumerate(t.split())), "en") for i, t in enumerate(invented(10, many, 2))]
    rows += [(2000 + i, " | ".join(t.split()), "en") for i, t in enumerate(invented(10, many, 3))]
    rare = [(5000 + i, t, "xx") for i, t in enumerate(invented(12, ["ka", "lo", "mi", "nu", "po"], 4))]
    rare += [(6000, " ".join(random.Random(5).choice(["q%z", "#x", "w&&"]) for _ in range(200)), "xx"), (6001, rare[0][1], "xx")]
    run = lambda x: {r.doc_id: (r.kept, r.z) for r in t5.quality_rules(spark.createDataFrame(x, "doc_id long, text string, lang string")).collect()}
    both, alone = run(rows + rare), run(rare)
    assert sum(both[i][0] for i in range(400)) >= 398
    assert not any(v[0] for i, v in both.items() if 1000 <= i < 5000)
    assert all(v[0] == (i != 6000) for i, v in alone.items())
    assert all(abs(both[i][1] - alone[i][1]) < 1e-6 and both[i][0] == alone[i][0] for i in alone)


def test_more_languages_than_any_list_and_one_long_text(spark):
    rows = [(i, t, f"l{i % 40}") for i, t in enumerate(invented(80, ["ab", "cd", "ef"], 6))]
    rows += [(900, " ".join(invented(3000, ["ab", "cd", "ef"], 7)), "l1"), (901, None, None), (902, "!!! ??? ...", "l2")]
    out = {r.doc_id: r for r in t5.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(out) == 83 and all(out[i].z is not None for i in range(80)) and out[900].n_words > 400_000
    assert out[901].z is None and out[902].log_perplexity is None and not out[902].kept


def test_quality_rules_on_edge_rows(docs, empty):
    out = t5.quality_rules(docs).collect()
    assert len(out) == docs.count()
    by = {r.doc_id: r for r in out}
    assert by[3].base_failed and not by[3].kept and by[3].n_words == 0 and by[7].base_failed and by[0].kept
    assert t5.quality_rules(empty).count() == 0
    assert t5.quality_rules(docs, keep=docs.columns).columns[:3] == ["doc_id", "text", "lang"]


def test_perplexity_band_rejects_junk_and_keeps_prose(spark):
    random.seed(9)
    syllable = ["the", "an", "re", "on", "er", "st", "ing", "ed", "ou"]
    word = lambda: "".join(random.choice(syllable) for _ in range(random.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(200)), "en") for i in range(300)]
    rows += [(1000 + i, " ".join("".join(random.choice("qxzjkvw") for _ in range(6)) for _ in range(200)), "en") for i in range(5)]
    out = {r.doc_id: r.kept for r in t5.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i] for i in range(300)) and not any(out[1000 + i] for i in range(5))


def test_quality_rules_keep_columns_of_any_name(spark, docs):
    """Kept columns whose names the operator uses inside stay as they are; its own results replace theirs."""
    odd = docs.selectExpr("doc_id", "text", "lang", "1 AS middle", "'s' AS spread", "7L AS model", "8L AS n_scored", "9 AS n", "1.0 AS z", "false AS base_failed", "5 AS pack", "'b' AS data")
    out = t5.quality_rules(odd, keep=odd.columns)
    assert out.where("middle <> 1 OR spread <> 's' OR model <> 7 OR n_scored <> 8 OR n <> 9 OR pack <> 5 OR data <> 'b'").count() == 0 and out.count() == docs.count()
    plain = bag(t5.quality_rules(docs.select("doc_id", "text", "lang")).select("doc_id", "kept", "n_words"))
    assert bag(out.select("doc_id", "kept", "n_words")) == plain


# ---- op6 --------------------------------------------------------------------------------------


def test_sentencepiece_parity_and_round_trip(spark, docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), t6.SentencePiece(path)
    random.seed(10)
    texts = ["".join(random.choice(" \n\tab▁é<s>日.0A") for _ in range(random.randint(0, 40))) for _ in range(1500)]
    texts += ["", " ", "▁", "a" * 300, "日本語 😀 тест", "<s> </s>"] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()]
    ids = own.encode(texts)
    assert [x.tolist() for x in ids] == lib.encode(texts) and not own.differ
    assert own.decode(ids) == [own.plain(t) for t in texts]
    out = t6.tokenize(docs, path)
    assert out.columns == docs.columns + ["ids", "n_pieces", "n_parity", "round_trip"]
    for r in out.collect():
        assert r.ids == lib.encode(r.text or "") and r.n_pieces == len(r.ids) and r.n_parity == 0 and r.round_trip
    assert t6.tokenize(empty, path).count() == 0


def test_a_difference_is_marked_and_stops_nothing():
    class Other:
        def encode(self, x, num_threads=1):
            return [[0]] * len(x) if isinstance(x, list) else [0]

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = t6.SentencePiece(path)
    texts = [f"some words {i}" for i in range(500)]
    want = own.lib.encode(texts)
    own.bare = own.lib = Other()
    assert [x.tolist() for x in own.encode(texts)] == want and own.differ  # the backend's own ids, the difference noted
    marked = [own.whole_differs(t, np.array(x)) for t, x in zip(texts, want)]
    assert marked == [zlib.crc32(t.encode()) % t6.WHOLE == 0 for t in texts] and any(marked) and not all(marked)


def test_every_text_is_compared_with_the_library():
    """A library whose normal form of some texts differs: each of those texts is marked, not one in 64 of them."""
    own = t6.SentencePiece(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [f"some words {i}" for i in range(500)] + ["", " \n\t", "日本 é", "a" * 300]
    ids = own.encode(texts)
    assert own.differences(texts, ids) == [0] * len(texts) == [int(x.tolist() != y) for x, y in zip(ids, own.lib.encode(texts))]

    class Other:
        def __init__(self, lib):
            self.lib, self.encode = lib, lib.encode

        def normalize(self, texts):
            return [f"{x}." if t.endswith("3") else x for t, x in zip(texts, self.lib.normalize(texts))]

    own.lib = Other(own.lib)
    assert own.differences(texts, ids) == [int(t.endswith("3")) for t in texts]
    own.lib, own.unk = own.lib.lib, int(ids[0][0])  # texts with an unknown piece go to the library as a whole
    other = [np.append(x, 7).astype(np.int32) for x in ids]
    assert own.differences(texts[:500], other[:500]) == [1] * 500


def test_unigram_model_is_rebuilt(tmp_path):
    import struct

    import sentencepiece

    def field(n, kind, value):
        key = bytes([(n << 3) | kind]) if n < 16 else bytes([((n << 3) | kind) & 127 | 128, n >> 4])
        return key + (bytes([len(value)]) + value if kind == 2 else value)

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -2.0, 1), ("▁a", -3.0, 1), ("ab", -2.5, 1), ("a", -4.0, 1), ("b", -4.2, 1), ("▁ab", -4.5, 1), ("c", -5.0, 1), ("bc", -5.5, 1)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([t]))) for p, s, t in pieces)
    data += field(2, 2, field(3, 0, b"\x01") + field(35, 0, b"\x01"))
    data += field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x01") + field(5, 0, b"\x01"))
    path = tmp_path / "uni.model"
    path.write_bytes(data)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), t6.SentencePiece(str(path))
    texts = ["ab abc  cab", " a b ", "abab", "é b", "", "bca abca"]
    assert own.kind == "unigram" and [x.tolist() for x in own.encode(texts)] == lib.encode(texts)


# ---- op7 --------------------------------------------------------------------------------------


def test_targets_by_repeated_sharing(spark):
    sizes = {"1a": 100, "1b": 5000, "1c": 30, "1d": 0, "1e": 700, "2": 90}
    got = {r.skey: r.target for r in t7.source_targets(spark.createDataFrame(list(sizes.items()), "skey string, source_size long")).collect()}
    w = {k: (5.0, 2.0, 1.0)[i % 3] for i, k in enumerate(sorted(sizes))}
    left, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:  # the contract's own words: what is above a cap is shared again
        total = sum(w[k] for k in open_)
        full = {k for k in open_ if left * w[k] / total >= 2 * sizes[k]}
        if not full:
            want |= {k: left * w[k] / total for k in open_}
            break
        want |= {k: 2.0 * sizes[k] for k in full}
        left -= sum(want[k] for k in full)
        open_ -= full
    assert got == pytest.approx(want)


def test_mixing(spark, docs, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = t7.mix(d).collect()
    again = t7.mix(d.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    taken, target, most = collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(r.text)) and r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] + 1 for s in target)
    out = t7.mix(docs, keep=docs.columns)
    assert out.count() == docs.count() and out.columns.count("size") == 1
    assert t7.mix(empty).count() == 0 and t7.mix(docs.where("doc_id in (3, 4)")).count() == 2


@pytest.mark.parametrize("keep", [["doc_id"], ["doc_id", "text", "source"]])
def test_mixing_without_ids(spark, keep):
    """A third of the rows has no id: they spread over the queue by their texts; equal rows follow each other."""
    rng = random.Random(5)
    rows = [(None if i % 3 == 0 else i, " ".join(["w%d" % rng.randrange(90)] * rng.randint(1, 30)), "ab"[i % 7 == 0]) for i in range(600)]
    rows += [(None, "same text here", "a")] * 40
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = t7.mix(d, keep=keep).collect()
    again = t7.mix(d.repartition(5), keep=keep).collect()
    assert len(out) == 640 and sizes_taken(out) == sizes_taken(again)
    by = collections.defaultdict(lambda: [0, 0, 0])
    for r in out:
        by[r.source_size][0] += r.taken
        by[r.source_size][1] = r.target
        by[r.source_size][2] = max(by[r.source_size][2], r["size"])
    assert len(by) == 2 and all(abs(got - want) <= most + 1 for got, want, most in by.values())


def sizes_taken(rows):
    return sorted((r["size"], r.taken) for r in rows)


# ---- op8 --------------------------------------------------------------------------------------


def test_main_text():
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><header>Top</header><nav><ul><li><a>Menu</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><aside>Side</aside><article><h1>A &amp; B</h1><p>One  two<br>three &copy;<p><b>Four</b> five"
        "<form><input>Search</form><div class=\"ad\">Buy</div><p>Six<section class='comments'><p>Nice!</p></section></article><footer>Foot</footer>"
    )
    assert t8.main_text(page) == "A & B\n\nOne two three ©\n\nFour five\n\nSix"
    assert t8.main_text("") == "" and t8.main_text("plain &lt;text&gt;") == "plain <text>"


@pytest.mark.parametrize("rows_a_salt", [2048, 2])
def test_template_text_goes_where_no_article_tells(spark, monkeypatch, rows_a_salt):
    monkeypatch.setattr(t8, "ROWS_A_SALT", rows_a_salt)

    def page(i, note):
        extra = f"<div class='x9'><p>Subscribe now to our letter</p></div>" if note else ""
        return f"<html><body><div class='b'><p>Welcome to the site</p></div>{extra}<div class='c'><p>Story {i} begins</p><p>and ends {i * 7}</p></div><p>All rights reserved</p></body></html>"

    rows = [(i, f"http://h.example.com/{i}", page(i, i % 2)) for i in range(12)] + [(50, "http://other.example.com/", page(3, True)), (51, None, None), (52, "http://h.example.com/0", page(0, 0))]
    got = {r.page_id: r for r in t8.extract(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, salt int")).collect()}
    for i in range(12):
        assert got[i].text == f"Story {i} begins\n\nand ends {i * 7}" and got[i].n_chars == len(got[i].text)
    assert got[52].text == got[0].text and got[51].text == "" and got[50].text.startswith("Welcome")
    assert t8.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_template_text_goes_inside_article_and_copies_stay(spark):
    def page(i, body, note):
        extra = "<div class='k7'><p>Read our house rules before you write</p></div>" if note else ""
        return f"<html><body><!-- {i} --><article><p>{body}</p>{extra}<p>{body[::-1]}</p><div class='q'>Mail this page</div></article></body></html>"

    rows = [(i, "http://a.example.com/", page(i, prose(i), i % 2)) for i in range(12)]
    rows += [(100 + i, "http://copies.example.com/", page(i, prose(99), 0)) for i in range(9)]  # one content, different bytes
    rows += [(200 + i, "http://near.example.com/", page(i, prose(98) + f" and {i}", 0)) for i in range(9)]
    got = {r.page_id: r.text for r in t8.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"{prose(i)}\n\n{prose(i)[::-1]}"
    for i in range(9):
        assert got[100 + i] == f"{prose(99)}\n\n{prose(99)[::-1]}\n\nMail this page"
        assert got[200 + i].startswith(prose(98)) and prose(98)[::-1] in got[200 + i]


def test_ids_and_classes_of_one_page_hide_no_template(spark):
    def page(i, note):
        extra = "<div class='x9'><p>Subscribe now to our letter</p></div>" if note else ""
        own = f"id='post-{prose(i, 1)}' class='page-{i} c{i}'"
        return f"<html><body {own}><div {own}><p>Welcome to the site</p>{extra}<div {own}><p>Story {i} begins</p></div><p>All rights reserved</p></div></body></html>"

    rows = [(i, "http://h.example.com/", page(i, i % 2)) for i in range(12)]
    got = {r.page_id: r.text for r in t8.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} begins" for i in range(12)}


def test_recurring_text_of_an_article_stays(spark):
    """Headings, bylines and captions that recur inside articles are content; a constant container is not."""
    def page(i):
        by = f"<div class='byline'>By author {i % 2}</div>"
        part = f"<section><h2>Background</h2><p>{prose(1000 + i, 20)}</p></section><figure><figcaption>Map {i % 3}</figcaption></figure>"
        return f"<html><body><article><p>Introduction</p>{by}<p>{prose(i, 20)}</p>{part}<p>Conclusion</p><div class='z1'><p>Tell a friend</p></div></article></body></html>"

    rows = [(i, "http://a.example.com/", page(i)) for i in range(10)]
    got = {r.page_id: r.text for r in t8.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(10):
        assert got[i] == "\n\n".join(["Introduction", f"By author {i % 2}", prose(i, 20), "Background", prose(1000 + i, 20), f"Map {i % 3}", "Conclusion"])


def test_two_pages_show_a_template(spark):
    def page(i):
        return f"<html><body><div class='a'><p>Top links here</p></div><div><p>{prose(i)}</p></div><div class='z'>All rights kept by us</div></body></html>"

    rows = [(i, "http://two.example.com/", page(i)) for i in range(2)] + [(5, "http://one.example.com/", page(5))]
    got = {r.page_id: r.text for r in t8.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[0], got[1]] == [prose(0), prose(1)] and got[5].startswith("Top links here")


def test_deep_and_unclosed_html_is_linear():
    import time

    for html in ("<div>" * 100_000 + "deep" + "</div>" * 100_000, "<article>" + "<div><p>x" * 50_000, "</div>" * 100_000 + "end", "<ul>" + "<li>a" * 100_000):
        t = time.time()
        text = t8.main_text(html)
        assert time.time() - t < 30 and text.split()[-1] in ("deep", "x", "end", "a")
    assert t8.main_text("<div>" * 100_000 + "deep") == "deep"


def test_templates_equal_an_occurrence_vector_version(spark):
    """Whole vectors in memory, one host at a time, against the signatures of the Spark job, on random pages."""
    rng = random.Random(13)

    def part(d):
        kind = rng.choice(["p", "div", "section", "li", "h2", "div"])
        inner = rng.choice(["same text", "other text", f"own {rng.random()}", "menu words"]) if d == 0 or rng.random() < 0.4 else "".join(part(d - 1) for _ in range(rng.randint(1, 3)))
        name = rng.choice(["", " class='k1'", " class='k2 k3'", f" id='n{rng.randint(0, 3)}'"])
        return f"<{kind}{name}>{inner}</{kind}>"

    def page(i):
        body = "".join(part(2) for _ in range(rng.randint(1, 4)))
        fixed = "<div class='f'><p>fixed note</p></div>"
        main = f"<article><p>{prose(i, 12)}</p>{fixed if i % 3 else ''}{body}</article>" if rng.random() < 0.5 else body
        return f"<html><body><div>head line</div>{main}<p>foot line</p></body></html>"

    rows = [(i, f"http://h{i % 7}.example.com/{i}", page(i)) for i in range(200)]
    vectors, pages = collections.defaultdict(lambda: collections.defaultdict(dict)), collections.defaultdict(set)
    for i, url, html in rows:
        p, host = t8.Page(html), url.split("/")[2]
        (digest,) = t8.content_digests([p], [html])
        pages[host].add(digest)
        n = collections.Counter([(t, 0) for t in p.elements] + [(t, 2) for _, _, t in p.containers])
        n.update((t8.token("t", path, text), 1) for path, text, main, out in p.blocks if not out and not main)
        for k, c in n.items():
            at = vectors[host][k]
            at[digest] = max(at.get(digest, 0), c)
    want = {}
    for host, tokens in vectors.items():
        classes, total = collections.defaultdict(list), len(pages[host])
        for (t, kind), at in tokens.items():
            classes[frozenset(at.items())].append((t, kind))
        for vector, members in classes.items():
            support, element = len(vector), any(k == 0 for _, k in members)
            if support < 0.3 * total or support < 2:
                continue
            for t, kind in members:
                if kind == 1 and (support == total or (element and support >= 4)) or kind == 2 and element and support >= 4:
                    want.setdefault(host, set()).add(t)
    got = {r.host: set(r.template) for r in t8.templates(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html").collect()}
    assert got == want and len(got) == 7


# ---- op9 --------------------------------------------------------------------------------------


def brute_print(t, k=3):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, docs, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(docs.where("doc_id is not null").select((docs.doc_id + 1000).alias("doc_id"), "text"))
    rows = d.collect()
    f = [brute_print(r.text) for r in rows]
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(f[a] ^ f[b]).count("1") <= 3:
                comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    least = {}
    for r, c in zip(rows, comp):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = collections.Counter((r.doc_id, f"{x:016x}", least[c]) for r, x, c in zip(rows, f, comp))
    assert bag(t9.near_duplicates(d)) == want
    assert t9.near_duplicates(empty).count() == 0
    kept = t9.drop_near_duplicates(d)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_one_row_of_each_component_stays_when_ids_repeat(spark):
    a, b, c = (prose(i) for i in range(3))
    rows = [(1, a), (5, a), (5, b), (7, b), (5, b), (None, c), (None, c), (9, a), (7, None)]
    kept = t9.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert bag(kept) == collections.Counter([(1, a), (5, b), (None, c), (7, None)])


@pytest.mark.parametrize("bits", [8, 13])
def test_ball_links_find_all_pairs_at_three_bits(spark, monkeypatch, bits):
    monkeypatch.setattr(t9, "MIN_BITS", bits)
    rng = random.Random(11)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        fps |= {f} | {f ^ sum(1 << b for b in rng.sample(range(64), n)) for n in (1, 2, 3, 3, 4, 5)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = t9.links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(fps))
    got = {r.node: r.component for r in components(edges).collect()}
    comp = {x: x for x in signed}
    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= 3:
                p, q = comp[signed[i]], comp[signed[j]]
                comp = {k: min(p, q) if v in (p, q) else v for k, v in comp.items()}
    assert {x: got.get(x, x) for x in signed} == comp
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3 for r in edges.collect())


# ---- op10 -------------------------------------------------------------------------------------


def test_importance_weights_equal_brute_force(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (1, 1), (7, 0), (6, None), (None, 1)], "doc_id long, quality int")
    ratio = t10.fit(docs, labels, "doc_id", "text")
    raw, target = np.zeros(t10.BUCKETS), np.zeros(t10.BUCKETS)
    for r in docs.collect():
        b, _ = t10.features([r.text or ""])
        np.add.at(raw, b, 1)
        if r.doc_id in (0, 1):
            np.add.at(target, b, 1)
    assert np.allclose(ratio, np.log((target + t10.PSEUDO) / (raw * target.sum() / raw.sum() + t10.PSEUDO)))
    out = t10.classify(docs, labels, keep_share=0.6).collect()
    live = sorted((r.score for r in out if r.score > -math.inf), reverse=True)
    cut = live[round(0.6 * len(live)) - 1]
    assert len(out) == docs.count() and all(r.kept == (r.score >= cut) for r in out)
    for r in out:
        want = {x.doc_id: x.text for x in docs.collect()}[r.doc_id]
        b, _ = t10.features([want or ""])
        assert (r.log_weight == -math.inf) if not len(b) else abs(r.log_weight - ratio[b].sum()) < 1e-9
    wide = t10.classify(docs, labels, keep=docs.columns, keep_share=0.6)
    assert sorted(r.doc_id is None or r.doc_id for r in wide.where("kept").collect()) == sorted(r.doc_id is None or r.doc_id for r in out if r.kept)
    assert t10.classify(empty, labels).count() == 0 and t10.classify(docs, labels.where("false")).count() == docs.count()


def test_labelled_bad_rows_go_as_far_as_the_weights_tell(spark):
    rng = random.Random(11)
    good, bad = [prose(f"w{i}", 1) for i in range(200)], [prose(f"b{i}", 1) for i in range(40)]
    rows = [(i, " ".join(rng.choice(good if i < 300 else bad) for _ in range(80))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(0, 400, 2)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in t10.classify(df, labels).where("kept").collect()}
    assert not [i for i in kept if i >= 300] and len([i for i in range(0, 300, 2) if i in kept]) == math.ceil(t10.GOOD_KEPT * 150)
    assert {r.doc_id for r in t10.classify(df, labels, keep=["doc_id", "text"]).where("kept").collect()} == kept


def test_features_are_words_and_pairs():
    b, doc = t10.features(["A b", "a B a", "", "c"])
    assert [collections.Counter(doc.tolist())[i] for i in range(4)] == [3, 5, 0, 1]
    assert sorted(b[doc == 0]) == sorted(t10.features(["a  B"])[0])  # case and white space fold
