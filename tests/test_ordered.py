"""Running sums over ranges against one plain loop."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from siltstone.operators import dataset
from siltstone.operators.ordered import running


def test_running(spark):
    rng = random.Random(5)
    data = [(i, rng.choice([None, "a", "a", "a", "b", "ü"]), rng.choice([None, 0, 1, 7])) for i in range(500)]
    rows = spark.createDataFrame(data, "id long, key string, n long").repartition(7)
    got = {r["id"]: (r["before"], r["place"]) for r in running(rows, [F.col("key").asc_nulls_last(), F.col("id").desc()], {"before": F.col("n"), "place": F.lit(1)}).collect()}
    total = 0
    for place, (i, _, n) in enumerate(sorted(data, key=lambda r: (r[1] is None, (r[1] or "").encode(), -r[0]))):
        assert got[i] == (total, place)
        total += n or 0
    assert len(got) == 500
    assert running(rows.where("id < 0"), [F.col("id")], {"before": F.col("n")}).count() == 0


def test_positional_has_no_window_over_all_rows(spark):
    rows = spark.range(0, 400).select(F.pmod(F.col("id") * 7, F.lit(400)).alias("pos")).repartition(5)
    placed = dataset.positional(rows, train=30, test_from=50)
    assert {r["pos"]: r["split"] for r in placed.collect()} == {p: "train" if p < 30 else "test" for p in range(400) if p < 30 or p >= 50}
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan.split("BroadcastExchange")[0]
