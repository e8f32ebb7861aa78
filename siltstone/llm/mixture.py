"""Mixing sources to target weights by weighted fair queueing.

Every source queues its shuffled documents, and all of them again for each repeat. A document's virtual finish time is
how many words its source has sent by its end, over the source's target; at time 1 each source has sent its target. All
queues are sorted by finish time together, and the mix is what comes first within the budget of words. Both sums, a
source's own and the mix's, run over ranges, so that no source is one task's work however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import written
from siltstone.operators.ordered import running

#: Weights of the sources in their order, repeated; how often the mix takes a document at most.
WEIGHTS, REPEATS = (5, 2, 1), 3
#: A word's first character: one that isn't white space, after none.
WORD_START = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]"


def n_words(text: Column) -> Column:
    """Number of runs of anything but white space; 0 for null."""
    return F.coalesce(F.char_length(text) - F.char_length(F.regexp_replace(text, WORD_START, "")), F.lit(0)).cast("long")


def targets(sized: DataFrame, *, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, place, source_size, ahead, target of each source (one row each). sized: source, size.

    Sources are in code-point order, null last. A target is a share by weight of all words, at most ``repeats`` times the
    source's size; what is beyond goes to the others by weight until none is above. That is a level which the sources
    reach in the order of (limit / weight): a source's level, if all before it stop at their limits, is what these leave,
    over the weights from it on; the first source whose limit is at least its share of that level sets it. ``ahead``: the
    words of all repeats of the sources before.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running(sums, [F.col("source").asc_nulls_last()], {"place": F.lit(1), "ahead": F.col("source_size") * repeats})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    limited = placed.withColumn("weight", weight).withColumn("limit", F.col("source_size") * repeats)
    ordered = written(running(limited, [F.col("limit") / F.col("weight"), F.col("place")], {"turn": F.lit(1), "limits": F.col("limit"), "weights": F.col("weight")}), "sources")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    whole = ordered.agg(F.sum("source_size").alias("budget"), F.sum("weight").alias("of_all"))
    left = ordered.crossJoin(F.broadcast(whole)).withColumns({"rest": F.col("budget") - F.col("limits"), "open": F.col("of_all") - F.col("weights")})  # whole is one row
    level = left.where(wide("limit") * wide("open") >= wide("rest") * wide("weight")).agg(F.min_by(F.struct("rest", "open"), "turn").alias("level"))
    share = (F.col("level.rest") * F.col("weight")).cast("double") / F.col("level.open").cast("double")
    return ordered.crossJoin(F.broadcast(level)).select("source", "place", "source_size", "ahead", F.coalesce(F.least(F.col("limit").cast("double"), share), F.col("limit").cast("double")).alias("target"))  # level is one row


def mixed(docs: DataFrame, *, weights=WEIGHTS, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted.

    The budget is the words of all documents. A null or empty text has size 0 and is not taken; null sources are one
    source, the last. The shuffle is a hash of repeat and id, ties by id and size, so results don't depend on how rows
    are dealt; of equal rows, some may be taken once more than others. Sources without words have the target 0. The mix
    never exceeds the budget: it ends before the first document that doesn't fit. An empty table gives no row.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    sized = written(sized.withColumn("row", F.monotonically_increasing_id()), "sized")  # numbers stay: the table is written
    sources = written(targets(sized, weights=weights, repeats=repeats), "targets")
    # Whether the sources' few columns are sent to all tasks is Spark's choice by the size of the written table.
    met = sized.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("source", "__source")
    copies = met.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    key = F.md5(F.concat_ws(":", F.col("copy").cast("string"), F.col("doc_id").cast("string")))
    queued = copies.withColumn("shuffled", F.conv(F.substring(key, 1, 15), 16, 10).cast("long"))
    queue = [F.col(c) for c in ("copy", "shuffled", "doc_id", "size", "row")]
    sent = running(queued, [F.col("place"), *queue], {"sent": F.col("size")})
    timed = sent.withColumn("finish", (F.col("sent") - F.col("ahead") + F.col("size")).cast("double") / F.col("target")).drop("sent", "ahead")
    mix = running(timed, [F.col("finish"), F.col("place"), *queue], {"before": F.col("size")})
    budget = sources.agg(F.sum("source_size").alias("budget"))
    fits = F.col("before") + F.col("size") <= F.col("budget")
    taken = mix.crossJoin(F.broadcast(budget)).groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum(F.when(fits, F.col("size")).otherwise(0)).alias("taken"))  # budget is one row
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return taken.select(columns).unionByName(met.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))


#: The same in SQL, with one window for each running sum.
SQL = r"""
with sized as (select row_number() over () as row, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sums as (select source, sum(size)::bigint as source_size from sized group by source),
placed as (select *, row_number() over (order by source nulls last) - 1 as place from sums),
weighted as (select *, [5, 2, 1][(place % 3 + 1)::int]::bigint as weight, 3 * source_size as top from placed),
ordered as (select *, row_number() over w as turn, coalesce(sum(top) over (w rows between unbounded preceding and 1 preceding), 0) as tops, coalesce(sum(weight) over (w rows between unbounded preceding and 1 preceding), 0) as weights
  from weighted window w as (order by top / weight, place)),
opened as (select *, (select sum(source_size) from sums) - tops as rest, (select sum(weight) from weighted) - weights as open from ordered),
level as (select arg_min(rest, turn) as rest, arg_min(open, turn) as open from opened where top * open >= rest * weight),
targets as (select source, place, source_size, least(top::double, (rest * weight)::double / open::double) as target from (select o.source, o.place, o.source_size, o.top, o.weight, level.rest, level.open from ordered o, level)),
queued as (select s.*, place, source_size, target, copy, ('0x' || substr(md5(copy || ':' || doc_id), 1, 15))::bigint as shuffled
  from sized s join targets t on s.source is not distinct from t.source, (select unnest(range(3)) as copy) where size > 0),
timed as (select *, (sum(size) over (partition by place order by copy, shuffled, doc_id, size, row rows unbounded preceding))::double / target as finish from queued),
mix as (select *, sum(size) over (order by finish, place, copy, shuffled, doc_id, size, row rows unbounded preceding) as so_far from timed),
taken as (select row, sum(case when so_far <= (select sum(source_size) from sums) then size else 0 end)::bigint as taken from mix group by row)
select s.doc_id, s.size, t.source_size, t.target, coalesce(taken, 0)::bigint as taken
from sized s join targets t on s.source is not distinct from t.source left join taken using (row)
"""
