"""Places and running sums in one order over a whole table, without putting it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.shared import written


def running(rows: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``totals``: the sum of its values (longs, null counts 0) over all rows before.

    The rows are sorted by range; each range's sums, one row a partition, give what comes before it, and a window within
    the range adds the rest. The ranges are written first, so that they can't differ between the two readings. Rows that
    are equal in all of ``order`` share a range, so end it with a column that tells rows apart. An empty table stays one.
    """
    marked = rows.withColumns({f"__{name}": F.coalesce(value.cast("long"), F.lit(0)) for name, value in totals.items()})
    ranged = written(marked.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__range").agg(*(F.sum(f"__{name}").alias(f"__{name}") for name in totals))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sums.select("__range", *(F.coalesce(F.sum(f"__{name}").over(ahead), F.lit(0)).alias(f"__from_{name}") for name in totals))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumns({name: F.coalesce(F.sum(f"__{name}").over(within), F.lit(0)) for name in totals})
    placed = own.join(F.broadcast(starts), "__range").withColumns({name: (F.col(name) + F.col(f"__from_{name}")).cast("long") for name in totals})  # starts: one row a partition
    return placed.select(*rows.columns, *totals)
