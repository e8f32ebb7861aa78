"""Questions to grounded answers, as one plan for all questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import evaluate, providers, retrieval, search


def expanded(questions: DataFrame, cache: providers.ResponseCache | None = None) -> DataFrame:
    """question_id, query_pos, text: each question, its expansions and its hypothetical answer, by way of the cache."""
    if cache is None:
        return questions.select("question_id", F.posexplode(retrieval.expansions(F.col("text"))).alias("query_pos", "text"))
    whole = retrieval.expansions(F.col("text"))
    lists = cache.answered(questions, "expand", ["text"], lambda asked: asked.withColumn("queries", F.slice(whole, 2, F.size(whole) - 2)), "queries array<string>")
    both = cache.answered(lists, "hypothetical answer", ["text"], lambda asked: asked.withColumn("passage", F.element_at(whole, -1)), "passage string")
    return both.select("question_id", F.posexplode(F.concat(F.array("text"), "queries", F.array("passage"))).alias("query_pos", "text"))


def ask(index: search.Index, questions: DataFrame, k: int = retrieval.K, generate=providers.extracted_answer, cache: providers.ResponseCache | None = None) -> DataFrame:
    """question_id, question, context (all different passages, in order), answer (from the first k + 2 of them).

    index: see :mod:`siltstone.operators.search`; questions: question_id, text. A question without any passage is
    answered from none. With a cache, expansions, hypothetical answers and answers are asked for once and then kept.
    """
    context = retrieval.distinct_context(search.multi_query(index, questions, k, expanded(questions, cache)))
    gathered = context.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("c"))
    asked = questions.join(gathered, "question_id", "left").withColumn("context", F.coalesce(F.col("c.text"), F.expr("cast(array() as array<string>)")))
    rows = asked.select("question_id", F.col("text").alias("question"), "context", F.slice("context", 1, k + 2).alias("window"))
    if cache is None:
        return rows.withColumn("answer", generate(F.col("window"))).drop("window")
    return cache.answered(rows, "answer", ["question", "window"], lambda new: new.withColumn("answer", generate(F.col("window"))), "answer string").drop("window")


def judged(answers: DataFrame, cache: providers.ResponseCache, judge=providers.accepts) -> DataFrame:
    """``answers`` (with gold, predicted) with ``metric``, the judge's verdicts by way of the cache."""
    said = cache.answered(answers, "judge", ["gold", "predicted"], lambda asked: asked.withColumn("metric", evaluate.metric(F.col("gold"), F.col("predicted"), judge)), "metric double")
    return said
