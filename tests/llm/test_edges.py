"""Every operator on null and empty texts, null ids, repeated rows, long texts, clashing columns and empty tables."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siltstone.llm import ann, decontaminate, jaccard, language, licenses, lines, mixing, packing, quality, sstable, stages

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words int, `from` string"
LONG = "la casa de la vida " * 3000


def rows(*texts):
    return [(i, t, {3: "en", 4: "en", 5: "es", 8: "en"}.get(i), "s", len(t or ""), 1.0, 7, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    base = rows(None, "", " \n ", "Hello there, world of words and letters!", "Hello there, world of words and letters!", LONG, "漢字 ça va", "12 34", "a b c d e f g h i j k l m n")
    return spark.createDataFrame([*base, base[3], (None, "no id here at all", "en", "s", 1, 1.0, 7, "x")], COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_language(spark, odd, empty):
    learned = language.profiles(odd)
    assert sorted(learned) == ["en", "es"]
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identify(odd.drop("lang"), learned).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (7, "und"), (5, "es"), (3, "en")} <= got
    assert language.identify(empty, learned).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.profiles(empty)).collect()} == {"und"}


def test_sstable(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = sstable.encode_to_shards(odd, tokenizer_path=path, end_id=2).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8]
    assert got[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    assert sstable.encode_to_shards(empty, tokenizer_path=path, end_id=2).count() == 0


def test_packing(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(odd, tokenizer_path=path, end_id=1, capacity=64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty, tokenizer_path=path, end_id=1).count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (8, [1.0, 0.0]), (9, [1.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0]), (10, [1e300, 1e300])]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, id string")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, is_query=F.col("id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 8), (0, 3, 10), (0, 4, 7)]
    assert ann.nearest(df.limit(0), is_query=F.col("id") == 0).count() == 0


def test_mixing(spark, odd, empty):
    got = mixing.scores(odd, vocabulary=4).collect()
    assert len(got) == odd.count() and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    assert mixing.scores(empty).count() == 0


def test_lines(spark, odd, empty):
    got = {r["doc_id"]: r["text"] for r in lines.deduplicated(odd).collect()}
    assert got[0] is None and got[1] == "" and got[2] == " \n " and got[3] and got[4] == ""
    assert lines.deduplicated(empty).count() == 0


def test_jaccard(spark, odd, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(odd).collect()}
    assert got[0] == (0, 0) and got[2] == (0, 2) and got[4] == (3, 3) and got[7] == (1, 7)
    assert jaccard.near_groups(odd).count() == odd.count() - 1
    assert jaccard.near_groups(empty).count() == 0


def test_licenses(spark, odd, empty):
    assert licenses.scan(odd, path=F.lit("a/b")).count() == odd.count()
    assert licenses.scan(empty, path=F.lit("a/b")).count() == 0


def test_quality(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (5, 1, None), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["perplexity"], r["keep"]) for r in quality.judged(odd, labels).collect()}
    assert got[0] == (None, False) and got[1] == (None, False) and got[3][1]
    assert all(r["keep"] for r in quality.judged(odd.where("text <> ''"), labels.limit(0)).collect())
    assert quality.judged(empty, labels).count() == 0


def test_decontamination(spark, odd, empty):
    bench = spark.createDataFrame([(1, "A b c d e f g h i j k l m"), (2, None), (3, "?!"), (4, "hello there"), (None, "12 34")], "item_id long, text string")
    for size in (1 << 20, 8):  # one automaton, several
        got = {r["doc_id"]: r for r in decontaminate.contamination(odd, bench, automaton_bytes=size).collect()}
        assert [got[i]["n_hit"] for i in (0, 1, 2, 3, 7, 8)] == [0, 0, 0, 2, 2, 13]
        assert got[3]["items"] == ["4"] and got[7]["items"] == ["null"] and [tuple(x) for x in got[3]["spans"]] == [(0, 11)]
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(odd, bench.limit(0)).collect())


def test_stages_keep_the_columns(spark, odd, empty, tmp_path):
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "q")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for stage in (stages.trusted_style, stages.first_lines, stages.one_of_each, stages.unseen_benchmark):
        for docs in (odd, empty):
            assert stage(spark, docs, str(tmp_path)).columns == odd.columns
    assert stages.sequences(spark, empty, str(tmp_path)).count() == 0


def test_the_quality_stage_scores_its_documents_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(i, f"some words and {i}", "en", "web", 20) for i in range(90)], "doc_id long, text string, lang string, source string, n_chars long")
    passes, of = [], quality.score
    monkeypatch.setattr(quality, "score", lambda rows, held, **how: passes.append(how.get("keep_text", False)) or of(rows, held, **how))
    assert stages.trusted_style(spark, docs, str(tmp_path)).count() >= 55
    # All documents once, with their texts; the trusted ones of each half once more, for the threshold.
    assert sorted(passes) == [False, False, True]
