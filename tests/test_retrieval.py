from __future__ import annotations

import math

import pytest

from siltstone.operators import evaluate, inverted, providers, retrieval, search


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "red fox runs"), (2, "blue whale swims far"), (3, "red whale"), (4, None), (5, "")], "chunk_id int, text string")


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return search.load_or_build(docs, str(tmp_path_factory.mktemp("index")))


def test_bm25_by_hand(spark, index):
    got = {r["chunk_id"]: r["score"] for r in inverted.topk(index, spark.createDataFrame([(1, "Red, red!")], "query_id int, text string"), 5).collect()}
    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    assert got == pytest.approx({i: idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / 2.25)) for i, dl in ((1, 3), (3, 2))})


def test_pools_and_cuts(spark, index):
    queries = spark.createDataFrame([(1, "red whale"), (2, "nothing here")], "query_id int, text string")
    found = search.hybrid(index, queries, 1)
    assert found.groupBy("query_id").count().where("count > 3").count() == 0
    assert search.retrieve(index, queries, 1, k_asked=5).where("rank > 1").count() == 0


def test_expansions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Why so?", "a\n\n b \nc\nd", ["1", "2", "3"])], "q string, l string, x array<string>")
    lines, listed = df.select(retrieval.expansions(F.col("q"), lines=F.col("l")), retrieval.expansions(F.col("q"), listed=F.col("x"))).first()
    assert lines[:3] == ["Why so?", "a", "b"] and len(lines) == 4
    assert listed[1:4] == ["1", "2", "3"]


def test_metric(spark):
    from pyspark.sql import functions as F

    rows = [("a b", "a b"), ("a b", None), ("a b", "  "), ("a b", "c"), ("I don't know.", "Sorry, I don't know")]
    got = [r[0] for r in spark.createDataFrame(rows, "g string, p string").select(evaluate.metric(F.col("g"), F.col("p"))).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0, 1.0]


def test_equal_prompts_are_asked_once(spark):
    from pyspark.sql import functions as F

    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def model(x):
        asked.add(1)
        return f"{x}!"

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "i int, x string")
    out = providers.asked_once(rows, ["x"], lambda d: d.withColumn("y", model("x")))
    assert sorted((r["i"], r["y"]) for r in out.collect()) == [(1, "a!"), (2, "a!"), (3, "None!")]
    assert asked.value == 2


def test_providers_by_name():
    assert providers.model_provider("local/x") == "local"
    for name in ("hosted/x", "other"):
        with pytest.raises(ValueError):
            providers.model_provider(name)
