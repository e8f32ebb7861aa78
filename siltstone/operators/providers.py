"""Where models plug in: provider objects that are asked in batches, a cache of their responses, and stand-ins.

A provider maps named inputs to named outputs over a DataFrame. Models on the executors are :class:`Provider` objects,
loaded once by each worker. The stand-ins are made of column functions and only show the dataflow. Equal prompts are asked
once, and with a :class:`ResponseCache` once for good.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import normalized, strip, tokens
from siltstone.sources.shared import written
from siltstone.sources.tables import exists

UNKNOWN = "I don't know."
#: F1 of normalised tokens from which on the stand-in judge accepts an answer.
ACCEPTED = 0.5


#: Rows that are sorted by length together, rows of a call, and calls for a batch before its rows are asked one by one.
WINDOW, BATCH, TRIES = 1024, 32, 2
#: Bits of the filter of asked prompts for each of them, and at most in all (one megabyte).
BITS_PER_PROMPT, MOST_BITS, HASHES = 12, 1 << 23, 4


def prompt_key(kind: str, inputs: list[str]) -> Column:
    """A hash of the kind of a prompt and its inputs, by name; null differs from empty."""
    return F.sha2(F.to_json(F.struct(F.lit(kind).alias("__kind"), *(F.col(c).alias(c) for c in inputs)), {"ignoreNullFields": "false"}), 256)


def asked_once(rows: DataFrame, inputs: list[str], ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` joined with what ``ask`` adds to their different inputs (null matches null)."""
    keyed = rows.withColumn("__key", prompt_key("", inputs))
    answers = ask(keyed.select("__key", *inputs).dropDuplicates(["__key"]))
    return keyed.join(answers.drop(*inputs), "__key").drop("__key")


@dataclass(frozen=True)
class Provider:
    """A model behind named inputs and outputs.

    ``load`` is called once in each Python worker and returns what answers a list of inputs (dicts) with a list of
    outputs (dicts), in order. ``outputs``: their schema, as DDL; ``length``: what a row costs, so that a batch holds
    rows of about one length.
    """

    name: str
    inputs: tuple[str, ...]
    outputs: str
    load: Callable[[], Callable[[list[dict]], list[dict]]]
    length: Callable[[dict], int] = lambda row: sum(len(str(x)) for x in row.values())

    def __call__(self, rows: DataFrame, *, batch: int = BATCH, window: int = WINDOW, tries: int = TRIES) -> DataFrame:
        """``rows`` with the outputs and ``error``: null, or why a row has none. A failing batch is tried again, then row by row."""
        own = [c for c in rows.columns if c in self.inputs]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), self.outputs, "error string"])
        names = rows.sparkSession.createDataFrame([], self.outputs).columns

        def answered(model, part: list[dict]) -> list[dict]:
            for left in range(tries - 1, -1, -1):
                try:
                    out = model([{c: r[c] for c in own} for r in part])
                    if len(out) != len(part):
                        raise ValueError(f"{len(out)} answers to {len(part)} prompts")
                    return [{**{c: o.get(c) for c in names}, "error": None} for o in out]
                except Exception as e:  # noqa: BLE001 whatever a model raises belongs to its rows
                    why = f"{type(e).__name__}: {e}"
                    if not left and len(part) == 1:
                        return [{**dict.fromkeys(names), "error": why}]
            return [x for r in part for x in answered(model, [r])]

        def run(batches: Iterable):
            import pyarrow as pa

            model, waiting = None, []

            def flush():
                order = sorted(range(len(waiting)), key=lambda i: self.length({c: waiting[i][c] for c in own}))
                for at in range(0, len(order), batch):
                    part = [waiting[i] for i in order[at : at + batch]]
                    for row, out in zip(part, answered(model, part), strict=True):
                        row |= out
                return pa.RecordBatch.from_pylist(waiting, schema=types)

            for rows_ in batches:
                model = model or self.load()
                for row in rows_.to_pylist():
                    waiting.append(row)
                    if len(waiting) >= window:
                        yield flush()
                        waiting = []
            if waiting:
                yield flush()

        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
        return rows.mapInArrow(run, schema)


class ResponseCache:
    """Responses by prompt, in a table that only grows: kind, key, response (JSON).

    What was asked before is read, what wasn't is asked once and appended. The lookup reads the rows of its kind whose
    keys a Bloom filter of the asked prompts lets through, so a large cache isn't shuffled for a few prompts. Runs at the
    same time may append a prompt twice; one of the responses counts.
    """

    SCHEMA = "key string, response string, kind string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder) if exists(self.spark, self.folder) else self.spark.createDataFrame([], self.SCHEMA)

    @staticmethod
    def _bit(k: int, bits: int) -> Column:
        return F.pmod(F.xxhash64(F.col("key"), F.lit(k)), F.lit(bits))

    def _known(self, kind: str, prompts: DataFrame) -> DataFrame:
        """key, response of the kind's rows that may be among ``prompts`` (key)."""
        bits = 1 << 10
        while bits < MOST_BITS and bits < BITS_PER_PROMPT * prompts.count():
            bits *= 2
        places = prompts.select(F.explode(F.array(*(self._bit(k, bits) for k in range(HASHES)))).alias("bit"))
        words = places.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("x"))
        # One row of at most MOST_BITS bits.
        table = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "x"))).alias("set")).select(F.transform(F.sequence(F.lit(0), F.lit(bits // 64 - 1)), lambda i: F.coalesce(F.col("set")[i], F.lit(0))).alias("set"))
        held = F.lit(True)
        for k in range(HASHES):
            bit = self._bit(k, bits)
            held = held & (F.call_function("shiftright", F.get("set", F.floor(bit / 64).cast("int")), (bit % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return self.rows().where(F.col("kind") == kind).crossJoin(F.broadcast(table)).where(held).select("key", "response").dropDuplicates(["key"])

    def answered(self, rows: DataFrame, kind: str, inputs: list[str], ask: Callable[[DataFrame], DataFrame], outputs: str) -> DataFrame:
        """``rows`` with the outputs (DDL) that ``ask`` gives for their inputs, or has given before.

        ``ask`` gets the different unasked prompts (the inputs and ``key``) and adds the outputs; rows to which it adds
        an ``error`` that isn't null are not kept, so they are asked again the next time.
        """
        names = self.spark.createDataFrame([], outputs).columns
        keyed = written(rows.withColumn("key", prompt_key(kind, inputs)), "prompts")  # what made the rows isn't made again for each step
        prompts = keyed.select("key", *inputs).dropDuplicates(["key"])
        fresh = ask(prompts.join(self._known(kind, prompts.select("key")), "key", "left_anti"))
        response = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("response")
        if "error" in fresh.columns:  # written first: a condition on what a model says would ask it twice
            fresh = written(fresh.select("key", response, "error"), "responses").where("error is null").select("key", "response")
        else:
            fresh = fresh.select("key", response)
        fresh.withColumn("kind", F.lit(kind)).write.mode("append").partitionBy("kind").parquet(self.folder)
        known = self._known(kind, prompts.select("key")).withColumn("__out", F.from_json("response", outputs))
        return keyed.join(known, "key", "left").select(*rows.columns, *(F.col(f"__out.{c}").alias(c) for c in names))


def model_provider(name: str, key: str | None = None) -> str:
    """The kind of a model by its name: ``hosted`` (needs a key), ``local`` or ``stub``; an error for any other."""
    if name == "stub":
        return "stub"
    if name.startswith("hosted/"):
        if not key:
            raise ValueError("a hosted model needs a key")
        return "hosted"
    if name.startswith("local/"):
        return "local"
    raise ValueError(f"unknown model {name}")


def extracted_answer(context: Column) -> Column:
    """Stand-in generator: the first passage's first sentence, or that it doesn't know."""
    sentence = strip(F.regexp_extract(F.get(context, F.lit(0)), r"^([^.!?\n]*[.!?]?)", 1))
    return F.when((F.size(context) > 0) & (F.coalesce(sentence, F.lit("")) != ""), sentence).otherwise(UNKNOWN)


def question_of(section: Column, text: Column) -> Column:
    """Stand-in question for a chunk: its section and its longest word (the first in code-point order)."""
    longest = F.array_min(F.transform(tokens(text), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))["t"]
    return F.concat(F.lit("What does "), section, F.lit(" say about "), F.coalesce(longest, F.lit("it")), F.lit("?"))


def answer_of(text: Column) -> Column:
    """Stand-in answer for a chunk: its first sentence after the section."""
    return strip(F.regexp_extract(F.regexp_replace(text, r"^\[[^\]]*\] (\.\.\. )?", ""), r"^([^.!?\n]*[.!?]?)", 1))


def token_f1(gold: Column, predicted: Column) -> Column:
    """F1 of the different normalised tokens of two texts."""
    words = lambda c: F.array_distinct(F.filter(F.split(normalized(c), " "), lambda w: w != ""))
    g, p = words(gold), words(predicted)
    both = F.size(F.array_intersect(g, p))
    return F.when(F.size(g) + F.size(p) > 0, 2.0 * both / (F.size(g) + F.size(p))).otherwise(0.0)


def accepts(gold: Column, predicted: Column) -> Column:
    """Stand-in judge: enough tokens in common, or both unknown."""
    unknown = lambda c: normalized(c).contains("don t know")
    return (unknown(gold) & unknown(predicted)) | (token_f1(gold, predicted) >= ACCEPTED)
