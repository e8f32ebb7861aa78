"""Scores of predictions, summaries of runs, and the choice among program candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import strip
from siltstone.operators.providers import accepts


def metric(gold: Column, predicted: Column, judge=accepts) -> Column:
    """1.0 or 0.0 by the judge; 0.0 for a missing or blank answer, or if the judge has no verdict."""
    blank = predicted.isNull() | (strip(predicted) == "")
    return F.when(blank, 0.0).otherwise(F.coalesce(judge(gold, predicted).cast("double"), F.lit(0.0)))


def summary(scored: DataFrame, *by: str) -> DataFrame:
    """total, n and percent (one digit) of ``metric``."""
    return scored.groupBy(*by).agg(F.sum("metric").alias("total"), F.count("*").alias("n"), F.round(100 * F.avg("metric"), 1).alias("percent"))


def delta(runs: DataFrame, before: str, after: str, *by: str) -> DataFrame:
    """percent before and after, side by side, and their difference."""
    side = lambda run, name: runs.where(F.col("run") == run).select(*by, F.col("percent").alias(name))
    return side(before, "before").join(side(after, "after"), list(by), "full").withColumn("delta", F.round(F.col("after") - F.col("before"), 1))


def minibatch(rows: DataFrame, trial: Column, key: Column, n: int) -> DataFrame:
    """``n`` rows for each trial, fixed by hashes of trial and key."""
    order = Window.partitionBy("trial").orderBy(F.md5(F.concat(trial.cast("string"), F.lit("|"), key.cast("string"))), key)
    return rows.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n)


def best_candidate(scored: DataFrame) -> DataFrame:
    """candidate, score, place: mean metric of each candidate on its minibatches, best first (ties to the smaller)."""
    means = scored.groupBy("candidate").agg(F.round(F.avg("metric"), 6).alias("score"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "candidate")))  # one row for each candidate


def bootstrapped(traces: DataFrame, most: int = 1) -> DataFrame:
    """Demonstrations: the first traces of each predictor that passed the metric."""
    order = Window.partitionBy("predictor").orderBy("pos")
    return traces.where("metric = 1").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, both, either, share of two rankings' passages."""
    joined = a.select("query_id", "chunk_id", F.lit(1).alias("a")).join(b.select("query_id", "chunk_id", F.lit(1).alias("b")), ["query_id", "chunk_id"], "full")
    return joined.groupBy("query_id").agg(F.sum((F.col("a").isNotNull() & F.col("b").isNotNull()).cast("long")).alias("both"), F.count("*").alias("either")).withColumn("share", F.round(F.col("both") / F.col("either"), 6))
