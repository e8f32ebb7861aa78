"""Choosing among candidate programs by their scores on minibatches.

A program is an instruction and a set of demonstrations. All pairs of them are candidates; successive halving scores all
on a small minibatch, keeps the better half, doubles the minibatch and goes on, so most of the work goes to the best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import strip
from siltstone.operators import evaluate, providers
from siltstone.sources.shared import written

TRIALS, BATCH = 5, 4
#: Rungs of a search, share of the candidates that go on to the next, least F1 of two questions from which on a demonstration answers.
RUNGS, KEPT, ALIKE = 3, 0.5, 0.5
#: A candidate's number is its instruction's times this plus its set's.
STRIDE = 1000
DEMO = "struct<pos:bigint,question:string,answer:string>"


def instructions() -> dict[str, Column]:
    """The stand-in instructions: what each makes of a row (question, answer)."""
    sentence = strip(F.regexp_extract("answer", r"^([^.!?\n]*[.!?]?)", 1))
    return {"question": F.col("question"), "sentence": sentence, "answer": F.col("answer"), "unknown": F.lit(providers.UNKNOWN)}


def demo_sets(traces: DataFrame, most: int = 1) -> DataFrame:
    """set_no, demos: none (0), and for each predictor its first ``most`` traces that passed, in the order of its name."""
    held = evaluate.bootstrapped(traces, most)
    sets = held.groupBy("predictor").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "question", "answer"))).alias("demos"))
    numbered = sets.select(F.row_number().over(Window.orderBy("predictor")).alias("set_no"), "demos")  # one row for each predictor
    return traces.sparkSession.createDataFrame([(0, [])], f"set_no int, demos array<{DEMO}>").unionByName(numbered)


def programs(names: list[str], sets: DataFrame) -> DataFrame:
    """candidate, instruction, demos of every pair of an instruction and a set."""
    listed = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(name).alias("instruction")) for i, name in enumerate(names)))).alias("x")
    return sets.select("set_no", "demos", listed).select((F.col("x.i") * STRIDE + F.col("set_no")).alias("candidate"), "x.instruction", "demos")


def said(told: dict[str, Column]) -> Column:
    """A program's answer: that of the demonstration whose question is most alike (of equal ones the last), if alike enough, or else what the instruction makes."""
    alike = F.array_max(F.transform("demos", lambda d: F.struct(providers.token_f1(F.col("question"), d["question"]).alias("f"), d["pos"].alias("pos"), d["answer"].alias("answer"))))
    own = F.lit(None).cast("string")
    for name, answer in told.items():
        own = F.when(F.col("instruction") == name, answer).otherwise(own)
    return F.when(alike["f"] >= ALIKE, alike["answer"]).otherwise(own)


def halving(rows: DataFrame, candidates: DataFrame, told: dict[str, Column] | None = None, *, rungs: int = RUNGS, batch: int = BATCH) -> DataFrame:
    """candidate, instruction, n_demos, rung, score, place: every program with its score on the last rung that it reached.

    rows: pos, question, answer; those that are demonstrations are left out. A rung's minibatch is the same for all of its
    programs; of equal scores the smaller candidate goes on.
    """
    told = told or instructions()
    used = candidates.select(F.explode("demos").alias("d")).select("d.pos").distinct()
    rows = rows.select("pos", "question", "answer").join(used, "pos", "left_anti")
    alive, scores, left = candidates, [], candidates.count()
    for rung in range(rungs):
        some = evaluate.minibatch(rows.withColumn("trial", F.lit(rung)), F.col("trial"), F.col("pos"), batch * 2**rung)
        # A minibatch against the programs that are left: two small tables of given sizes.
        tried = some.crossJoin(F.broadcast(alive)).withColumn("predicted", said(told))
        found = tried.groupBy("candidate").agg(F.round(F.avg(evaluate.metric(F.col("answer"), F.col("predicted"))), 6).alias("score"))
        scores.append(written(found.withColumn("rung", F.lit(rung)), "rung"))
        left = max(1, round(left * KEPT))
        alive = candidates.join(F.broadcast(scores[-1].orderBy(F.desc("score"), "candidate").limit(left).select("candidate")), "candidate", "left_semi")
    every = scores[0]
    for more in scores[1:]:
        every = every.unionByName(more)
    last = every.groupBy("candidate").agg(F.max(F.struct("rung", "score")).alias("x"))
    order = Window.orderBy(F.desc("x.rung"), F.desc("x.score"), "candidate")  # one row for each program
    return candidates.join(last, "candidate").select("candidate", "instruction", F.size("demos").alias("n_demos"), "x.rung", "x.score", F.row_number().over(order).alias("place"))


def search(rows: DataFrame, *, trials: int = TRIALS, batch: int = BATCH, programs: list[Column] | None = None) -> DataFrame:
    """candidate, score, place. rows: pos, question, answer; programs: columns, one for each candidate's answer.

    The candidates by default are the trivial programs: repeat the question, the answer's first sentence, the answer,
    or not know, scored exhaustively; :func:`halving` searches larger sets.
    """
    if programs is None:
        programs = list(instructions().values())
    tries = evaluate.minibatch(rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))), F.col("trial"), F.col("pos"), batch)
    said = F.explode(F.array(*(F.struct(F.lit(i).alias("candidate"), p.alias("predicted")) for i, p in enumerate(programs))))
    return evaluate.best_candidate(tries.withColumn("x", said).select("x.candidate", "trial", "pos", evaluate.metric(F.col("answer"), F.col("x.predicted")).alias("metric")))
