"""Question sets: filters, samples, groups of similar questions, and splits that don't leak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import similarity_key, strip, title
from siltstone.operators.ordered import running

#: Rows of each split at most, seed of the deterministic order.
CAPS = {"train": 40, "dev": 30, "test": 30}
SEED = "42"


def valid_chunks(chunks: DataFrame, more_than: int = 100) -> DataFrame:
    return chunks.where(F.length("text") > more_than)


def valid_qa(pairs: DataFrame, more_than: int = 10) -> DataFrame:
    return pairs.where((F.length(strip(F.col("question"))) > more_than) & (F.length(strip(F.col("answer"))) > more_than))


def inferred_topic(section: Column, doc_id: Column) -> Column:
    """The section, or else the document's name in title case."""
    named = title(F.replace(F.coalesce(doc_id, F.lit("General")), F.lit("_"), F.lit(" ")))
    return F.when(section.isNull() | section.isin("", "General"), named).otherwise(section)


def sample(rows: DataFrame, key: Column, n: int, seed: str = SEED) -> DataFrame:
    """Exactly min(n, rows) rows, in an order fixed by the seed."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), key.cast("string"))), key).limit(n)


def with_topics(pairs: DataFrame) -> DataFrame:
    """Valid pairs with inferred_topic and similarity_key. pairs: pos and the columns of a pair."""
    return valid_qa(pairs).withColumn("inferred_topic", inferred_topic(F.col("section"), F.col("doc_id"))).withColumn("similarity_key", similarity_key(F.col("question")))


def groups(pairs: DataFrame) -> DataFrame:
    """similarity_key, n, members (positions in order) of with_topics rows."""
    return pairs.groupBy("similarity_key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("pos")).alias("members"))


def topic_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("inferred_topic").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def rare_topics(pairs: DataFrame) -> DataFrame:
    """The lower half of the topics by count; of equal counts those that appear first."""
    counts = topic_counts(pairs)
    place = F.row_number().over(Window.orderBy("n", "first_pos"))  # one row for each topic
    return counts.withColumn("place", place).crossJoin(F.broadcast(counts.agg(F.count("*").alias("topics")))).where(F.col("place") <= F.floor(F.col("topics") / 2)).select("inferred_topic", "n", "place")


def assigned(pairs: DataFrame, caps: dict[str, int] = CAPS, seed: str = SEED) -> DataFrame:
    """similarity_key, split, turn, order of the groups that a greedy filling gives to a split.

    Groups come in an order fixed by the seed. First those with a rare topic fill dev, then test, while these hold less
    than their caps; then all that are left fill train, dev and test. "Holds less before me" is the sum of the sizes
    before, so each step is a window; what a step doesn't place goes to the next. The sums need only as many groups as
    the caps (each group adds a row at least), so the window without partitions sees a bounded number of rows.
    """
    rare = rare_topics(pairs).select("inferred_topic", F.lit(True).alias("rare"))
    flagged = pairs.join(F.broadcast(rare), "inferred_topic", "left").groupBy("similarity_key").agg(F.count("*").alias("n"), F.max(F.coalesce("rare", F.lit(False))).alias("rare"))
    keyed = flagged.withColumn("order", F.md5(F.concat(F.lit(seed), F.col("similarity_key"))))
    need = sum(caps.values())
    first = lambda kind: keyed.where(kind).orderBy("order", "similarity_key").limit(need)
    # At most 2 * need groups: from here on a table of the driver, so that no step repeats the work before.
    bounded = pairs.sparkSession.createDataFrame(first("rare").unionByName(first("not rare")).collect(), keyed.schema).coalesce(1)
    order = Window.orderBy("order", "similarity_key").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda: F.coalesce(F.sum("n").over(order), F.lit(0))
    placed, left, held = [], bounded, {"dev": F.lit(0), "test": F.lit(0), "train": F.lit(0)}
    sums: dict[str, DataFrame] = {}
    for turn, split, rare_only in ((1, "dev", True), (1, "test", True), (2, "train", False), (2, "dev", False), (2, "test", False)):
        pool = left.where("rare") if rare_only else left
        if split in sums:
            pool = pool.crossJoin(F.broadcast(sums[split]))  # one row
        else:
            pool = pool.withColumn("had", F.lit(0).cast("long"))
        tried = pool.withColumn("before", before() + F.coalesce("had", F.lit(0)))
        mine = tried.where(F.col("before") < caps[split]).select("similarity_key", "n", F.lit(split).alias("split"), F.lit(turn).alias("turn"), "order")
        placed.append(mine)
        if split != "train":
            sums[split] = mine.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("had"))
        left = left.join(mine.select("similarity_key"), "similarity_key", "left_anti")
    out = placed[0]
    for x in placed[1:]:
        out = out.unionByName(x)
    return out


def split(pairs: DataFrame, caps: dict[str, int] = CAPS, seed: str = SEED) -> DataFrame:
    """The rows of each split in the order they came in, cut to the caps (which may cut a group)."""
    cap = F.lit(0)
    for name, n in caps.items():
        cap = F.when(F.col("split") == name, n).otherwise(cap)
    rows = pairs.join(assigned(pairs, caps, seed).drop("n"), "similarity_key")
    place = F.row_number().over(Window.partitionBy("split").orderBy("turn", "order", "similarity_key", "pos"))
    return rows.withColumn("place", place).where(F.col("place") <= cap)


def positional(pairs: DataFrame, train: int = 30, test_from: int = 50) -> DataFrame:
    """train: the first rows; test: those from a place on; the rows between are in neither. No two rows share a ``pos``."""
    placed = running(pairs, [F.col("pos")], {"place": F.lit(1)})
    return placed.withColumn("split", F.when(F.col("place") < train, "train").when(F.col("place") >= test_from, "test")).where("split is not null")
