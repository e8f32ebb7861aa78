"""The mix against a plain queue, target by target."""

from __future__ import annotations

import hashlib
import re
from fractions import Fraction

import duckdb
import pytest

from siltstone.llm import mixture, queries

COLUMNS = "doc_id long, text string, source string, size string, target int, place double, copy int"


def plain_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, Fraction(0))
    rest, open_ = Fraction(sum(sizes.values())), set(names)
    while open_ and rest:
        share = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * share > repeats * sizes[s]}
        if not above:
            for s in open_:
                target[s] = weight[s] * share
            break
        for s in above:
            target[s] = Fraction(repeats * sizes[s])
            rest -= target[s]
        open_ -= above
    return names, target


def plain(rows):
    """Rows of (doc_id, size, source_size, target, taken) of (doc_id, text, source), with exact fractions."""
    sized = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    sizes = {}
    for _, n, s in sized:
        sizes[s] = sizes.get(s, 0) + n
    names, target = plain_targets(sizes)
    queue = []
    for place, s in enumerate(names):
        mine, sent = [(k, *x) for k, x in enumerate(sized) if x[2] == s and x[1]], 0
        copies = [(c, int(hashlib.md5(f"{c}:{i}".encode() if i is not None else str(c).encode()).hexdigest()[:15], 16), i is not None, i or 0, n, k) for c in range(3) for k, i, n, _ in mine]
        for c, h, _, i, n, k in sorted(copies):
            sent += n
            queue.append((sent / float(target[s]), place, c, h, i, n, k))
    taken, so_far, budget = [0] * len(rows), 0, sum(sizes.values())
    for *_, n, k in sorted(queue):
        so_far += n
        if so_far > budget:
            break
        taken[k] += n
    return [(i, n, sizes[s], float(target[s]), t) for (i, n, s), t in zip(sized, taken, strict=True)]


def got(df):
    return sorted(map(tuple, df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


def test_query_equals_plain_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = got(queries.op12_fair_queueing(spark, sf))
    want = sorted(plain(rows), key=str)
    assert [(r[0], r[1], r[2], r[4]) for r in out] == [(r[0], r[1], r[2], r[4]) for r in want]
    assert [r[3] for r in out] == pytest.approx([r[3] for r in want])
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert out == sorted(db.execute(f"select doc_id, size, source_size, target, taken from ({queries.ORACLE_SQL['op12_fair_queueing']})").fetchall(), key=str)


def test_a_third_in_one_source_and_odd_rows(spark):
    rows = [(i, " w" * (1 + i % 7), f"s{i % 9}") for i in range(400)] + [(1000 + i, "a b\tc\x0bd e", "hot") for i in range(200)] + [(1, " w" * 3, "hot")] * 4
    rows += [(5000, None, "s1"), (5001, "", "s1"), (5002, " \n ", "silent"), (5003, None, None), (5004, "x", None), (5005, "word " * 900, "\U0001f600"), (5006, "y", "￿")]
    df = spark.createDataFrame([(*r, "x", 1, 2.0, 3) for r in rows], COLUMNS)
    out, want = got(mixture.mixed(df.repartition(3))), sorted(plain(rows), key=str)
    assert [(r[0], r[1], r[2], r[4]) for r in out] == [(r[0], r[1], r[2], r[4]) for r in want]
    assert [r[3] for r in out] == pytest.approx([r[3] for r in want])
    assert out == got(mixture.mixed(df.repartition(8)))
    assert sum(r[4] for r in out) <= sum(r[1] for r in out) and all(r[4] <= 3 * r[1] for r in out)
    ids = df.where("doc_id > 5003").union(df.limit(1).selectExpr("cast(null as bigint)", "'q q'", "'s1'", "size", "target", "place", "copy"))
    assert got(mixture.mixed(ids)) == [(r[0], r[1], r[2], pytest.approx(r[3]), r[4]) for r in sorted(plain([(5004, "x", None), (5005, "word " * 900, "\U0001f600"), (5006, "y", "￿"), (None, "q q", "s1")]), key=str)]
    assert got(mixture.mixed(df.where("doc_id = 5002"))) == [(5002, 0, 0, 0.0, 0)]
    assert mixture.mixed(df.where("false")).count() == 0


def test_taken_words_come_near_the_targets(spark):
    df = spark.range(0, 3000).selectExpr("id as doc_id", "repeat('w ', cast(20 + id % 30 as int)) as text", "concat('s', cast(greatest(0, id % 40 - 20) as string)) as source")
    rows = mixture.mixed(df).groupBy("target", "source_size").sum("taken").collect()
    assert len(rows) > 3 and all(abs(r["sum(taken)"] - r["target"]) <= 150 for r in rows)
