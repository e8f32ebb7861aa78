"""Providers in batches by length, with errors of their own rows, and the cache of responses."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.operators import providers, search
from siltstone.plans import ask


def shouting():
    def load():
        calls = []

        def answer(prompts):
            calls.append(len(prompts))
            lengths = [len(p["text"] or "") for p in prompts]
            if any((p["text"] or "").startswith("bad") for p in prompts):
                raise RuntimeError("no answer")
            return [{"reply": (p["text"] or "").upper(), "spread": max(lengths) - min(lengths), "call": len(calls)} for p in prompts]

        return answer

    return providers.Provider("shout", ("text",), "reply string, spread int, call int", load)


def test_batches_of_like_length_and_errors(spark):
    rows = [(i, "x" * (i * 37 % 200), i % 5) for i in range(400)] + [(1000, "bad one", 0), (1001, None, 1), (1002, "", 2)]
    out = {r["i"]: r for r in shouting()(spark.createDataFrame(rows, "i long, text string, other int").repartition(3)).collect()}
    assert len(out) == len(rows) and all(out[i]["reply"] == (t or "").upper() and out[i]["other"] == o for i, t, o in rows if i != 1000)
    assert (out[1000]["reply"], out[1000]["error"]) == (None, "RuntimeError: no answer")
    assert sum(r["error"] is not None for r in out.values()) == 1
    assert max(r["spread"] for r in out.values() if r["error"] is None) < 120  # of 199; batches of 32 of about 134 sorted rows
    assert shouting()(spark.createDataFrame([], "text string")).count() == 0


def test_cache_asks_only_what_is_new(spark, tmp_path):
    cache, asked = providers.ResponseCache(spark, str(tmp_path / "c")), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def model(x):
        asked.add(1)
        return f"{x}!"

    def ask_model(prompts):
        return prompts.withColumn("y", model("x")).withColumn("error", F.when(F.col("y") == "fails!", "down"))

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, ""), (5, "fails")], "i int, x string")
    want = [(1, "a!"), (2, "a!"), (3, "None!"), (4, "!"), (5, None)]
    got = lambda df, kind="k": sorted(((r["i"], r["y"]) for r in cache.answered(df, kind, ["x"], ask_model, "y string").collect()), key=str)
    assert got(rows) == want and asked.value == 4
    assert got(rows) == want and asked.value == 5  # what failed is asked again
    more = spark.createDataFrame([(i, f"p{i % 700}") for i in range(1400)], "i int, x string")
    assert got(more.unionByName(rows)) == sorted([*want, *((i, f"p{i % 700}!") for i in range(1400))], key=str)
    assert asked.value == 706
    assert got(rows, "other kind") == want and asked.value == 710
    assert cache.rows().count() == 3 + 700 + 3


def test_second_run_of_questions_asks_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The red fox runs far. It sleeps."), (2, "The blue whale swims.")], "chunk_id long, text string")
    index, cache = search.load_or_build(docs, str(tmp_path / "i")), providers.ResponseCache(spark, str(tmp_path / "c"))
    questions = spark.createDataFrame([(1, "What does the fox do?"), (2, "What does the whale do?")], "question_id long, text string")
    plain = sorted(map(tuple, ask.ask(index, questions).collect()))
    assert sorted(map(tuple, ask.ask(index, questions, cache=cache).collect())) == plain
    kept = sorted(map(tuple, cache.rows().collect()))
    assert sorted(map(tuple, ask.ask(index, questions, cache=cache).collect())) == plain
    assert sorted(map(tuple, cache.rows().collect())) == kept and len(kept) == 6
    said = spark.createDataFrame([("a b", "a b"), ("a b", "a b"), ("a b", None)], "gold string, predicted string")
    assert sorted(r["metric"] for r in ask.judged(said, cache).collect()) == [0.0, 1.0, 1.0]
    assert cache.rows().where("kind = 'judge'").count() == 2


def test_the_filter_is_sound_at_any_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(providers, "MOST_BITS", 1 << 10)  # far too small: everything passes, nothing is lost
    cache = providers.ResponseCache(spark, str(tmp_path / "c"))
    rows = spark.range(3000).selectExpr("cast(id as string) as x")
    for _ in range(2):
        out = cache.answered(rows, "k", ["x"], lambda p: p.withColumn("y", F.reverse("x")), "y string")
        assert out.where("y = reverse(x)").count() == 3000
    assert cache.rows().count() == 3000
