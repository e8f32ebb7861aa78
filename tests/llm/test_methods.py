"""The operators' methods against plain versions on small fixtures."""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import ann, graph, jaccard, licenses, lines, mixing, packing, quality, sstable
from siltstone.llm.tokens import Encoder


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def changed(text, letters, edits):
    b = list(text)
    for _ in range(edits):
        k, how = random.randint(0, len(b)), random.random()
        if how < 0.34:
            b.insert(k, random.choice(letters))
        elif b:
            b[min(k, len(b) - 1) : min(k, len(b) - 1) + 1] = [] if how < 0.67 else [random.choice(letters)]
    return "".join(b)


@pytest.mark.parametrize(("name", "words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_are_the_library_s(name, words):
    path = public_tokenizers.path(name)
    t, e = Tokenizer.from_file(path), Encoder(path, words)
    t.encode_special_tokens = True
    for x in ("a  b\n\nc", " x", "x ", "\n", "don't it's 12 3a é́ ×÷ ÀÉ!?", "tab\tx", "nb sp a  b", "<|endoftext|> a", "汉字 text", "A.B,C 'tis", "x\x1cy z", "ß ÿ Ÿ", "", "One two.\nThree, four!"):
        assert e.ids(x.encode()) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x


def test_a_shard_is_read_back_and_searched():
    sink = io.BytesIO()
    w = sstable.Writer(sink)
    entries = [(k, bytes([k % 251]) * (k % 3000)) for k in range(-50, 900, 3)]
    for k, v in entries:
        w.add(sstable.key_of(k), v, len(v))
    w.finish()
    r = sstable.Reader(io.BytesIO(sink.getvalue()), len(sink.getvalue()))
    assert [(sstable.value_of(k), v) for k, v in r] == entries
    assert len(r.places) >= 3 and r.entries == len(entries)
    assert r.get(sstable.key_of(100)) == [dict(entries)[100]] and r.get(sstable.key_of(101)) == []
    with pytest.raises(ValueError):
        w.add(sstable.key_of(-99), b"", 0)


def test_bins_hold_all_pieces_and_are_nearly_full():
    random.seed(2)
    counts = {n: random.randint(1, 400) for n in random.sample(range(1, 513), 300)}
    rows = packing.layout(counts, 512)
    for n, c in counts.items():
        ranges = sorted((a, b) for m, a, b, *_ in rows if m == n)
        assert ranges[0][0] == 0 and ranges[-1][1] == c and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
    bins = sum(times for times, _ in packing.patterns(counts, 512))
    assert all(sum(n * k for n, k in b) <= 512 for _, b in packing.patterns(counts, 512))
    assert bins <= 1.05 * sum(n * c for n, c in counts.items()) / 512 + 1


def test_recall_of_the_search(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 24)) + 2 * rng.normal(size=(20, 24))[rng.integers(0, 20, 3000)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, is_query=F.col("id") % 100 == 0, rerank=8).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = sum(len(got[i] & set([j for j in np.argsort(-(u @ u[i]), kind="stable") if j != i][:5])) for i in got)
    assert len(got) == 30 and hits >= 0.9 * 150


def test_search_is_exact_in_full_chunks_with_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_CHUNKS", 1)  # as on large tables: chunks are full
    rng = np.random.default_rng(5)
    v = rng.normal(size=(ann.CHUNK_VECTORS, 16))
    near = np.arange(0, len(v), 3)  # a third are near copies; codes don't tell them apart
    v[near] = v[0] + 1e-3 * rng.normal(size=(len(near), 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, is_query=F.col("id") % 400 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == {i: [j for j in np.argsort(-(u @ u[i]), kind="stable").tolist() if j != i][:5] for i in range(0, len(v), 400)}


def test_anisotropic_codes_lower_the_error_along_the_vector():
    x = ann.unit(np.random.default_rng(1).normal(size=(500, 64)))
    q = ann.Quantiser(64).fit(x, rounds=1)
    back = lambda codes: np.take_along_axis(q.words[None], codes[:, :, None, None].astype(int), 2)[:, :, 0].reshape(len(x), -1)
    plain = np.stack([((q._split(x)[:, m, None] - q.words[m]) ** 2).sum(-1).argmin(1) for m in range(q.pairs)], 1)
    along = lambda codes: (((x - back(codes)) * x).sum(1) ** 2).mean()
    assert along(q.encode(x)) < along(plain)


def test_mixing_codes_are_proper_and_beat_word_counts(spark):
    lengths, codes = mixing.huffman(np.array([5.0, 1, 1, 9, 0]))
    assert np.sum(0.5 ** lengths.astype(float)) == 1 and len({(int(n), int(c)) for n, c in zip(lengths, codes)}) == 5
    random.seed(6)
    run = lambda: (lambda a: " ".join(f"w{(a + k) % 50}" for k in range(100)))(random.randint(0, 49))
    docs = spark.createDataFrame([(i, run()) for i in range(140)], "doc_id long, text string")
    got = mixing.scores(docs, vocabulary=64).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(140) if zlib.crc32(str(i).encode()) % 7 == 2}
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    random.seed(edits)
    pairs = [(a, changed(a, "abé", random.randint(0, 5))) for a in ("".join(random.choice("abé") for _ in range(random.randint(0, 14))) for _ in range(250))]
    got = spark.createDataFrame(pairs, "a string, b string").select(lines.within(F.col("a"), F.col("b"), edits)).collect()
    assert [r[0] for r in got] == [distance(a, b) <= edits for a, b in pairs]


def test_lines_against_all_pairs(spark):
    random.seed(8)
    base = ["".join(random.choice("abcd ") for _ in range(random.randint(20, 40))) for _ in range(12)]
    texts = ["\n".join(changed(random.choice(base), "abcd", random.randint(0, 4)) for _ in range(3)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = {}
    for i, t in enumerate(texts):
        for p, x in enumerate(t.split("\n")):
            if len(x) >= lines.LEAST_CHARS:
                at.setdefault(x, []).append((i, p))
    found, first = list(at), {}
    group = {x: x for x in found}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for k, x in enumerate(found):
        for y in found[:k]:
            if abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2:
                group[top(x)] = top(y)
    for x in found:
        first[top(x)] = min(first.get(top(x), (99, 0)), *at[x])
    want = {i: sorted(p for x in found for j, p in at[x] if j == i and (j, p) != first[top(x)]) for i in range(30)}
    assert {r["doc_id"]: r["__dropped"] or [] for r in lines.deduplicated(docs).collect()} == want


def test_short_lines_that_repeat_go_and_blank_ones_stay(spark):
    docs = ["Les.\n\nErheed. Titionly.\nx", "Les.\n\nErheed. Titionly!\nx", "Des.\n \nErheid. Titionly!\ny\nx", " \nA line of 19 letters\nA line of 19 letter", "A line of 1O letters.\nMes."]
    got = {r["doc_id"]: r["__dropped"] for r in lines.deduplicated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    # 2's third line is two edits from 0's and one from 1's; 4's first line is two edits from 3's of 20 characters.
    assert got == {0: None, 1: [0, 2, 3], 2: [2, 4], 3: [2], 4: [0]}


def test_groups_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # connected sets of several blocks
    random.seed(9)
    base = [[f"w{random.randint(0, 400)}" for _ in range(60)] for _ in range(4)]
    texts = []
    for _ in range(60):
        w = list(random.choice(base))
        for _ in range(random.randint(0, 3)):
            w[random.randrange(60)] = f"x{random.randint(0, 999)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    group = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), group[i]) for i in range(60)}


def test_components(spark):
    links = [(i, i + 1) for i in range(40, 60)] + [(100 + i, 99) for i in range(1, 30)] + [(7, 7), (3, 5), (5, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 40 for i in range(40, 61)} | {i: 99 for i in [99, *range(101, 130)]} | {3: 3, 5: 3}


def test_kneser_ney_sums_to_one_and_is_that_of_a_plain_version(spark):
    texts = ["the cat sat on the mat", "the the end", "a cat at the end of the mat is a mat \U0001f600"]
    hashes, bits, alphabet = quality.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    model, start = quality.Model(hashes, bits, alphabet), quality.START * (quality.ORDER - 1)
    counts = [{} for _ in range(quality.ORDER)]
    for t in texts:
        for i in range(len(t)):
            g = (start + t)[i : i + quality.ORDER]
            counts[-1][g] = counts[-1].get(g, 0) + 1
    for k in range(quality.ORDER - 1, 0, -1):
        for g in counts[k]:
            counts[k - 1][g[1:]] = counts[k - 1].get(g[1:], 0) + 1

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not all(n):
            return quality.PLAIN_DISCOUNTS
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]

    def p(context, w):
        low = 1 / (alphabet + 1) if context is None else p(context[1:] if context else None, w)
        if context is None:
            return low
        c, d = counts[len(context)], discounts(counts[len(context)])
        own = {g: n for g, n in c.items() if g[:-1] == context}
        if not own:
            return low
        off = {g: d[min(n, 3) - 1] for g, n in own.items()}
        g = context + w
        return (own.get(g, 0) - off.get(g, 0) + sum(off.values()) * low) / sum(own.values())

    for t in ("the mat cat", "xyz end", "a"):
        want = sum(-np.log2(p((start + t)[i : i + quality.ORDER - 1], t[i])) for i in range(len(t))) / len(t)
        assert abs(model.mean_bits([t.encode()])[0] - want) < 1e-4
    letters = [*counts[0], "?"]  # the last for any unknown character
    for context in ("the ", "zzzz", start):
        c = np.concatenate([quality.characters((context + w).encode()) for w in letters])
        assert abs((2.0 ** -model.of_places(c)[quality.ORDER - 1 :: quality.ORDER].astype(float)).sum() - 1) < 1e-3


def test_thresholds_are_of_the_language_s_own_trusted_documents(spark):
    random.seed(3)
    text = lambda letters: " ".join("".join(random.choice(letters) for _ in range(5)) for _ in range(8))
    rows = [(i, text("abcde"), "en") for i in range(2000)] + [(2000 + i, text("vwxyz"), "xx") for i in range(160)] + [(3000 + i, text("klmno"), "yy") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    got = quality.judged(docs, labels, trusted_docs=200).collect()
    kept = {x: [r["keep"] for r in got if r["lang"] == x] for x in ("en", "xx", "yy")}
    assert all(kept["yy"]) and sum(kept["xx"]) >= 150 and sum(kept["en"]) >= 1970
    of_lang = {r["lang"]: r["threshold"] for r in got}
    fitted = {r["__id"] for r in quality.fit_sample(docs.select(F.col("doc_id").alias("__id"), "lang"), 200).collect()}
    bits = np.log2([r["perplexity"] for r in got if r["lang"] == "xx" and r["doc_id"] not in fitted])
    assert of_lang["yy"] == float("inf") and abs(np.log2(of_lang["xx"]) - np.quantile(bits, 0.995)) <= 2e-4
    assert 20 < sum(i in fitted for i in range(2000, 2160)) < 100
    assert quality.quota([2000, 60, 10], 200) == 130 and quality.quota([5, 3], 200) == 5 and quality.quota([], 9) == 1


def test_all_trusted_documents_make_up_the_model_and_the_thresholds(spark, monkeypatch):
    random.seed(5)
    text = lambda: " ".join("".join(random.choice("abcdefgh") for _ in range(4)) for _ in range(6))
    docs = spark.createDataFrame([(i, text(), "en") for i in range(7000)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "cast(doc_id < 6800 as int) as quality", "0 as toxic")
    fits, of = [], quality.fit_counts
    monkeypatch.setattr(quality, "fit_counts", lambda grams: fits.append(grams.selectExpr("sum(n)").first()[0]) or of(grams))
    got = quality.judged(docs, labels).collect()
    # A count for each character of each trusted document: 29 of each text.
    assert len(fits) == 3 and max(fits) == 6800 * 29 and sorted(fits)[0] + sorted(fits)[1] == 6800 * 29
    half = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 2) as h").collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect() if r["doc_id"] < 6800}
    bits = []
    for h in (0, 1):
        model = quality.Model(*quality.fit(spark.createDataFrame([(t.decode(),) for i, t in texts.items() if half[i] != h], "text string")))
        bits += model.mean_bits([t for i, t in texts.items() if half[i] == h])
    assert len(got) == 7000 and abs(np.log2(got[0]["threshold"]) - np.quantile(bits, quality.QUANTILE)) <= 2e-4


def test_licences_are_inherited_from_the_nearest_directory(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code"), (3, "a/b/c/COPYING", "Licensed under the Apache License, Version 2.0"), (4, "a/b/c/d/y.py", "code"),
        (5, "z.py", None), (6, "a/q.py", "code\n# Licensed under CC BY-NC 4.0.\n" + "long text of the file " * 30), (7, None, "code"),
    ]
    df = spark.createDataFrame(files, "doc_id long, p string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["directory"]) for r in licenses.scan(df, path=F.col("p")).collect()}
    assert got[2] == ("MIT", "inherited", "a") and got[4] == ("Apache-2.0", "inherited", "a/b/c")
    assert got[5] == got[7] == (None, None, None) and got[6] == ("CC-BY-NC-4.0", "own", None) and got[1][:2] == ("MIT", "own")


def test_licences_of_real_notices(spark):
    gpl = "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\n" + "x y z " * 50
    bsd = "Copyright (c) 2001\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Source code must retain"
    prose = "Much stands before it. Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. And more after it."
    texts = ["# SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: Apache-2.0\ncode", "SPDX-License-Identifier: GPL-2.0-only", gpl, bsd, prose, "Copyright (c) 2020 Jane Doe. Licensed under the MIT license.", "All rights reserved.", "a license to fish", "code"]
    df = spark.createDataFrame([(i, t, "p/LICENSE" if t == bsd else f"p/{chr(113 + (i > 7))}/{i}.c") for i, t in enumerate(texts)], "doc_id long, text string, p string")
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan(df, path=F.col("p")).collect()}
    own = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0", "BSD-3-Clause", "Apache-2.0", "MIT", "Proprietary"]
    assert got == {i: (x, "own") for i, x in enumerate(own)} | {i: ("BSD-3-Clause", "inherited") for i in (8, 9)}


def test_line_links_against_all_pairs_when_segments_are_shared(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHOWN", 1)
    monkeypatch.setattr(lines, "SHARED", 4)
    monkeypatch.setattr(lines, "LEVELS", 2)
    random.seed(3)
    heads = ["The quick brown fox of page ", "Listing entry number for item "]
    base = [random.choice(heads) + "".join(random.choice("abcd") for _ in range(random.randint(3, 14))) for _ in range(25)]
    every = sorted({changed(random.choice(base), "abcd", random.randint(0, 3)) for _ in range(120)})
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    l = lines._lines(docs, "doc_id", "text")  # noqa: E741
    common = l.selectExpr("h", "g", "struct(id, struct(row, row2, pos) as at) as first").limit(0)
    node = {r["n"]: r["line"] for r in l.select(lines._node().alias("n"), "line").collect()}
    got = {frozenset((node[r["x"]], node[r["y"]])) for r in lines.line_links(l, common, edits=2, least_chars=20).collect()}
    allow = lambda x: min(2, 2 * len(x) // 20)
    assert got == {frozenset((x, y)) for k, x in enumerate(every) for y in every[:k] if distance(x, y) <= min(allow(x), allow(y))}


def test_mixing_does_not_depend_on_partitions_and_counts_words_as_a_plain_version(spark):
    import math
    import re
    from collections import Counter

    random.seed(12)
    vocabulary = [f"W{random.randint(0, 99)}é" if k % 9 == 0 else f"w{k}" for k in range(60)]
    texts = [" ".join(random.choice(vocabulary) for _ in range(random.randint(0, 80))) for _ in range(60)]
    texts = [*texts, *texts[:4], None, "\t a  b\nA"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, again = ({r["doc_id"]: r for r in mixing.scores(d, vocabulary=16).collect()} for d in (docs, docs.repartition(7)))
    assert all(abs(got[i]["score"] - again[i]["score"]) < 1e-9 for i in got)
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode())), None]
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, t in enumerate(texts) if i not in held for w in words(t))
    for i, t in enumerate(texts):
        r, w = got[i], words(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(w), sum(x in c for x in w), sum(c.values()))
        assert abs(r["base_score"] - sum(math.log10((c[x] + 1) / (sum(c.values()) + len(c) + 1)) for x in w)) < 1e-6


def test_successors_are_mixed_in_without_a_document_s_own():
    tokens = [(7, 1), (7, 1), (7, 2), (9, 1)]  # context, symbol
    data = mixing.token(*(np.array(x) for x in zip(*tokens)), np.full(4, -2.01))
    assert (mixing._wide([mixing._narrow(data[:3]), mixing._narrow(data[3:])]) == data).all()
    out = mixing.blended(data, np.array([0, 1, 1, 2]), np.array([True, True, True, False]))
    # Of token 0's context two others are left, one with its symbol; of token 2 the other document's, with another one; 3 knows none.
    assert out[0] > -2 and out[1] > -2 and out[2] < -2.01 and out[3] == pytest.approx(-2.01)


@pytest.mark.parametrize("known", [0, 1, 300])
def test_probabilities_of_what_follows_a_context_sum_to_one(known):
    rng = np.random.default_rng(known)
    many = mixing.VOCABULARY + 2  # every symbol, asked once of one context by a document that doesn't train
    plain = rng.random(many) ** 4
    plain /= plain.sum()
    seen = rng.integers(0, 40, known)
    data = np.r_[mixing.token(np.full(known, 5), seen, np.log10(plain[seen])), mixing.token(np.full(many, 5), np.arange(many), np.log10(plain))]
    out = mixing.blended(data, np.arange(known + many), np.arange(known + many) < known)
    assert 0.95 < (10 ** out[known:]).sum() <= 1 + 1e-6


def test_bit_predictors_are_a_distribution_over_symbols_and_spellings():
    rng = np.random.default_rng(4)
    coder = mixing.Coder([(f"w{i}".encode(), 1000 // (i + 1) + 1) for i in range(200)], 9000, 500, 18)
    tables = [rng.integers(-60, 60, 1 << 18).astype(np.int8) for _ in range(mixing.CONTEXTS)]
    mixer = mixing.Mixer(rng.normal(0.5, 0.2, (mixing.GATES, mixing.CONTEXTS)), rng.uniform(0.1, 0.9, mixing.GATES * mixing.STEPS).astype(np.float32))

    def symbol_probabilities(docs, place):
        slots, bits, kinds, owner, sizes, *_ = coder.events(docs)
        p = mixer.probability(*mixer.inputs(tables, slots, kinds)).astype(np.float64)
        p[bits == 0] = 1 - p[bits == 0]
        own = np.bincount(owner[kinds == 0], np.log10(p[kinds == 0]), sizes.sum())
        return 10 ** own[np.cumsum(sizes) - sizes + place]

    before = [b"w3", b"odd"]
    docs = [[*before, f"w{i}".encode()] for i in range(200)] + [[*before, b"unknown"], before]
    assert symbol_probabilities(docs, 2).sum() == pytest.approx(1, abs=1e-4)


def test_gray_codes_differ_in_no_more_bits_than_counts(spark):
    from pyspark.sql import functions as F

    counts = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).cast("long").alias("y"))
    bits = F.bit_count(lines.gray(F.col("x")).bitwiseXOR(lines.gray(F.col("y"))))
    assert counts.where(bits > lines.sketch_distance(F.col("x"), F.col("y"))).count() == 0
    high = counts.select(*(F.shiftleft(c, 60).alias(c) for c in ("x", "y")))
    assert high.where(bits > lines.sketch_distance(F.col("x"), F.col("y"))).count() == 0


def test_trusted_texts_are_marked_without_moving_them(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 3000 if i % 100 else None, f"text {i}") for i in range(6000)], "doc_id long, text string")
    ids = spark.range(0, 9000, 3).select(F.col("id").alias("__id"))
    want = sorted(f"text {i}" for i in range(6000) if i % 100 and i % 3000 % 3 == 0)
    for bits in (quality.BITS_AN_ID, 1):  # with one bit an id many pass that aren't among them
        monkeypatch.setattr(quality, "BITS_AN_ID", bits)
        got = quality.among(docs, ids, id_col="doc_id")
        assert sorted(r["text"] for r in got.collect()) == want and got.columns == docs.columns
        # Texts are in no shuffle.
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert quality.among(docs, ids.limit(0), id_col="doc_id").count() == 0


def test_equal_tokens_are_worked_on_once_with_the_results_of_all(spark):
    rng = np.random.default_rng(6)
    coder = mixing.Coder([(f"w{i}".encode(), 1000 // (i + 1) + 1) for i in range(200)], 9000, 500, 18)
    docs = [[f"w{i}".encode() for i in rng.integers(0, 230, 50)] for _ in range(40)] * 3
    slots, bits, kinds, owner, _, symbols, *_ = coder.events(docs)
    _, own, before, marker, _, rare_at, rare = coder.tokens(docs)
    for k, context in enumerate([None, before, marker]):
        got, want = np.zeros(2 << 18, np.uint32), slots[k][kinds == 0] << 1 | bits[kinds == 0]
        coder.count_symbols(k, context, own, got)
        assert (got == np.bincount(want, minlength=2 << 18)).all()
    tables = [rng.integers(-60, 60, 1 << 18).astype(np.int8) for _ in range(mixing.CONTEXTS)]
    mixer = mixing.Mixer(rng.normal(0.5, 0.2, (mixing.GATES, mixing.CONTEXTS)), rng.uniform(0.1, 0.9, mixing.GATES * mixing.STEPS).astype(np.float32))
    p = mixer.probability(*mixer.inputs(tables, slots, kinds)).astype(np.float64)
    p = np.log10(np.where(bits == 0, 1 - p, p))
    first, like = coder.different(own, before, marker)
    assert len(first) <= len(own) // 3 + len(rare)
    got = mixer.log_probability(tables, *coder.symbol_bits(own[first], before[first], marker[first]), 0)[like]
    assert np.allclose(got, np.bincount(owner[kinds == 0], p[kinds == 0], len(symbols)), atol=1e-5)
    got = mixer.log_probability(tables, *coder.byte_bits(rare, marker[rare_at]), 1)
    assert np.allclose(got, np.bincount(owner[kinds == 1], p[kinds == 1], len(symbols))[rare_at], atol=1e-5)


def test_letters_of_unknown_words_are_worked_on_once_with_the_results_of_all(monkeypatch):
    rng = np.random.default_rng(13)
    counted = [(b"w%d" % k, 1000 - k) for k in range(200)]
    words = ["".join(rng.choice(list("abcde\u00e4"), int(rng.integers(1, 9)))).encode() for _ in range(5000)] + [b"\xff", b"a" * 300]
    for known in (200, 5):  # many words, fewer than there are markers
        coder = mixing.Coder(counted[:known], 10**6, 1000, 18)
        marker = np.where(rng.random(len(words)) < 0.3, np.uint32(0xFFFFFFFF), rng.integers(0, 64, len(words)).astype(np.uint32)).astype(np.uint32)
        slots, bits, many = coder.byte_bits(words, marker)
        assert many.sum() == len(bits) and len(many) == len(words)
        *letters, n = coder.letters(words, marker)
        assert n.tolist() == [len(w) + 1 for w in words]
        for k in range(mixing.CONTEXTS):
            monkeypatch.setattr(mixing, "CHUNK_TOKENS", 1000)
            got = np.zeros(2 << 18, np.uint32)
            coder.count_letters(k, *letters, got)
            assert (got == np.bincount(slots[k].astype(np.int64) << 1 | bits, minlength=len(got))).all()
        tables = [rng.integers(-120, 120, 1 << 18).astype(np.int8) for _ in range(mixing.CONTEXTS)]
        mixer = mixing.Mixer(refine=rng.random(mixing.GATES * mixing.STEPS).astype(np.float32))
        first, like = coder.different_letters(*letters)
        of_letter = mixer.log_probability(tables, *coder.letter_bits(*(x[first] for x in letters)), 1)[like]
        assert np.allclose(np.add.reduceat(of_letter, np.cumsum(n) - n), mixer.log_probability(tables, slots, bits, many, 1), rtol=1e-9)
        assert known == 5 or len(first) < len(like) / 2
    own = rng.integers(0, 50, 3000).astype(np.uint64)
    for width in (6, 60):  # beside the places, or not
        assert (mixing._order(own, width) == np.argsort(own, kind="stable")).all()


class _Task:
    """Stands for a table: keeps the function that a task would run."""

    def mapInArrow(self, function, schema):
        self.function = function
        return self

    def _same(self, *columns):
        return self

    select = where = groupBy = agg = _same


def _traced(rows, batches) -> tuple[list, float]:
    """What a task passes on, and the most memory in MB that Python and numpy held in it."""
    import tracemalloc

    tracemalloc.start()
    try:
        return list(rows.function(iter(batches))), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_counting_of_n_grams_holds_little_however_long_the_texts_are(spark, monkeypatch):
    import pyarrow as pa

    rng, of_size = np.random.default_rng(7), []
    for many in (60, 240):
        texts = ["".join(rng.choice(list("abcd ä"), 20_000)) for _ in range(many)]
        batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 20]), pa.array([k % 2 for k in range(len(texts[i : i + 20]))])], names=["text", "part"]) for i in range(0, many, 20)]
        quality.gram_counts(task := _Task(), text_col="text", by="half")
        got, mb = _traced(task, batches)
        assert sum(sum(b.column(1).to_pylist()) for b in got) == many * 20_000 and sum(b.num_rows for b in got) <= 2 * (6**5 + 1_000)
        of_size.append(mb)
    assert max(of_size) < 64 and of_size[1] < 1.3 * of_size[0]
    # Bounds that are passed many times over change no count.
    docs = spark.createDataFrame([(t[:300], i % 2) for i, t in enumerate(texts[:40])] + [(None, 0), ("", 1), ("ä", 1)], "text string, half int")
    want = {(r["gram"], r["part"]): r["n"] for r in quality.gram_counts(docs, text_col="text", by="half").collect()}
    plain = {}
    for t, part in docs.where("text <> ''").collect():
        for i in range(len(t)):
            g = (quality.START * 4 + t)[i : i + 5]
            plain[g, part] = plain.get((g, part), 0) + 1
    assert want == plain
    for name in ("COUNTED_CHARS", "HELD_GRAMS", "PASSED_GRAMS"):
        monkeypatch.setattr(quality, name, 100)
    quality.gram_counts(task := _Task(), text_col="text", by="half")
    small = {}
    for b in task.function(iter([pa.RecordBatch.from_arrays([pa.array([r[0] for r in docs.collect()]), pa.array([r[1] for r in docs.collect()])], names=["text", "part"])])):
        for g, n, part in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            small[g, part] = small.get((g, part), 0) + n
    assert small == plain


def test_a_fit_takes_few_jobs_and_sends_nothing_through_the_driver(spark, monkeypatch):
    sc, rng = spark.sparkContext, np.random.default_rng(11)
    rows = [("".join(rng.choice(list("abcdef ä\U0001f600"), int(rng.integers(1, 60)))), i % 2) for i in range(300)]
    grams = quality.gram_counts(spark.createDataFrame(rows, "text string, half int"), text_col="text")
    monkeypatch.setattr(type(sc), "broadcast", lambda *_: pytest.fail("a model was sent by the driver"))
    monkeypatch.setattr(quality, "SHARD_GRAMS", 100)  # many shards
    sc.setJobGroup("fit", "one model")
    held = quality.fit_counts(quality.written(grams, "grams"))
    sc.setJobGroup("other", "")
    assert len(sc.statusTracker().getJobIdsForGroup("fit")) <= 16  # each is several plans, stages and tasks that the driver keeps
    # A worker's model, made of what the shards hold, is that of the whole.
    model, (hashes, _) = quality._model(held), quality.stored_model(held[0])
    assert len(set(hashes.tolist())) == len(hashes) and held[1] == len({c for t, _ in rows for c in t})
    letters = np.concatenate([quality.characters((" abc" + w).encode()) for w in [*"abcdef ä\U0001f600", "?"]])
    assert abs((2.0 ** -model.of_places(letters)[quality.ORDER - 1 :: quality.ORDER].astype(float)).sum() - 1) < 1e-3
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert quality.judged(spark.createDataFrame([(i, t, "en") for i, (t, _) in enumerate(rows)], "doc_id long, text string, lang string"), labels).count() == 300


def test_words_are_split_and_counted_without_an_object_for_each(spark, monkeypatch):
    import pyarrow as pa

    texts = [b" A b\x0bC\x1cx\t", None, b"", b" \n", "ÄÖ\x85É x\x00y".encode(), b"\xff\xfe bad \xc3", b"b B b"]
    plain = [bytes(c + 32 if 65 <= c <= 90 else c for c in t or b"").split() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([b"left out", *texts], pa.binary()).view(pa.string()).slice(1)], names=["text"])
    mixing.word_counts(task := _Task())
    long = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i % 100}" for i in range(200_000))])], names=["text"])
    got, mb = _traced(task, [long])
    assert [n for b in got for n in b.column(1).to_pylist()] == [2_000] * 100 and mb < 4
    for most in (mixing.SPLIT_BYTES, 1):
        monkeypatch.setattr(mixing, "COUNTED_WORDS", 3)
        found = [(first, many.tolist(), words.to_pylist()) for _, first, many, words in mixing.split_pieces([batch], 0, most)]
        assert [n for _, many, _ in found for n in many] == [len(x) for x in plain] and [w for *_, words in found for w in words] == sum(plain, [])
        assert [first for first, *_ in found] == list(np.cumsum([0, *(len(many) for _, many, _ in found)])[:-1])
    counts = {}
    for b in task.function(iter([batch, batch])):
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts[w] = counts.get(w, 0) + n
    assert counts == {w: 2 * sum(plain, []).count(w) for w in sum(plain, [])}
    for kind in (pa.large_string(), pa.large_binary(), pa.binary()):
        many, words = mixing.split_words(pa.array([x.encode() for x in ("A b", "", "C ")], pa.large_binary() if kind != pa.binary() else kind).view(kind))
        assert many.tolist() == [2, 0, 1] and words.to_pylist() == [b"a", b"b", b"c"]
    coder = mixing.Coder([(b"b", 5), (b"a", 2)], 9, 2, 18)
    for tokens in (1, 4, 1_000):
        parts = [(first, words, coder.tokens(words)) for _, first, words in mixing._chunks([batch], 0, coder, tokens)]
        assert [first for first, *_ in parts] == list(np.cumsum([0, *(len(w.many) for _, w, _ in parts)])[:-1])
        assert np.concatenate([w.octets() for _, w, _ in parts]).tolist() == [sum(map(len, x)) + len(x) for x in plain]
        whole = coder.tokens(plain)
        for i in (0, 1, 2, 4):
            assert np.concatenate([t[i] for *_, t in parts]).tolist() == whole[i].tolist()
        assert sum((t[6] for *_, t in parts), []) == whole[6] == [w for w in sum(plain, []) if w not in (b"a", b"b")]
