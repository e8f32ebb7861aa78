"""Whole queries against plain versions on the smallest tables, and the pipeline on odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from siltstone.llm import queries, sstable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def encoded(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return {i: e.ids for i, e in zip(texts, t.encode_batch([x or "" for x in texts.values()], add_special_tokens=False), strict=True)}


def test_languages(spark, docs):
    def ranked(texts):
        c = Counter()
        for t in texts:
            x = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
            c.update(x[i] for i in range(len(x)) if x[i] != " ")
            c.update(x[i : i + 2] for i in range(len(x) - 1) if x[i : i + 2] != "  ")
            c.update(x[i : i + 3] for i in range(len(x) - 2) if x[i + 1] != " ")
        code = lambda g: tuple(ord("_") if ch == " " else ord(ch) for ch in g)
        return sorted(c, key=lambda g: (-c[g], len(code(g)), code(g)))[:300]

    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in docs}
    profiles = {lang: ranked([r["text"] for i, r in docs.items() if fold[i] and r["lang"] == lang]) for lang in {r["lang"] for r in docs.values()}}
    places = {lang: {g: k for k, g in enumerate(p)} for lang, p in profiles.items()}
    for r in queries.op1_rank_order(spark, SF).collect():
        own = ranked([docs[r["doc_id"]]["text"]])
        far = {lang: sum(abs(p[g] - k) if g in p else 300 for k, g in enumerate(own)) for lang, p in places.items()}
        best = min(sorted(far), key=far.get)
        assert (r["held_out"], r["lang_pred"]) == (fold[r["doc_id"]] == 0, best)
        assert r["score"] == pytest.approx(1 - far[best] / (300 * len(own)), abs=1e-9)


def test_token_shards(spark, docs):
    ids, start = encoded("byte_bpe_50k.json", {i: docs[i]["text"] for i in sorted(docs)}), 0
    got = {r["doc_id"]: r for r in queries.op2_sstable(spark, SF).collect()}
    for i in sorted(docs):
        whole = [*ids[i], 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(whole), crc(whole))
        start += len(whole)
    assert len(got) == len(docs)


def test_a_key_is_looked_up_across_shards(spark, docs, tmp_path):
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/shards"
    table = spark.read.parquet(f"{SF}/documents.parquet")
    manifest = sstable.write_shards(table.unionByName(table.limit(1)), folder, tokenizer_path=path, end_id=2, shard_bytes=40_000)
    assert len(manifest) > 3 and [x["last_key"] for x in manifest] == sorted(x["last_key"] for x in manifest)
    twice = table.limit(1).first()["doc_id"]
    ids = encoded("byte_bpe_50k.json", {i: docs[i]["text"] for i in docs})
    for i in [*list(docs)[::17], twice]:
        found = sstable.lookup(folder, manifest, i)
        assert len(found) == 1 + (i == twice) and all(x.tolist() == [*ids[i], 2] for x in found)
    assert sstable.lookup(folder, manifest, -5) == [] and sstable.lookup(folder, manifest, 10**9) == []


def test_packed_sequences(spark, docs):
    ids, bins, seen = encoded("word_bpe_49k.json", {i: docs[i]["text"] for i in docs}), {}, set()
    for r in queries.op9_best_two_fit(spark, SF).collect():
        whole = [*ids[r["doc_id"]], 1]
        part = whole[4096 * r["piece"] : 4096 * (r["piece"] + 1)]
        assert (r["start"], r["length"], r["ids_crc32"]) == (4096 * r["piece"], len(part), crc(part)) and part
        seen.add((r["doc_id"], r["piece"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(seen) == sum(-(-(len(x) + 1) // 4096) for x in ids.values())
    for places in bins.values():
        ends = np.cumsum([0, *(n for _, n in sorted(places))]).tolist()
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096
    assert len(bins) <= 1.02 * sum(len(x) + 1 for x in ids.values()) / 4096 + 1


def test_contamination(spark, docs):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode()))
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(r["item_id"]))
    sizes = {len(w) for w in windows}
    for r in queries.op10_decontamination(spark, SF).collect():
        w, hit, items = words(docs[r["doc_id"]]["text"]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    items |= found
        want = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
        assert tuple(r[k] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want


def test_pipeline_on_odd_rows(spark, tmp_path):
    item = " ".join(f"q{k}" for k in range(30))
    one, two = (" ".join(f"{c}{k * 7919 % 101}" for k in range(60)) for c in "ab")
    rows = [(1, one), (1, item), (2, one), (2, two), (2, two), (3, None), (4, ""), (None, " ".join(f"c{k}" for k in range(40)))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Of id 1 the contaminated row goes and the clean one stays; of id 2 the copy of 1's text and one of two equal rows.
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got if r["doc_id"]) == [(False, 1), (False, 2)] and len(got) == 3
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
