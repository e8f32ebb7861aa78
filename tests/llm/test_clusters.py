"""Clusters against plain k-means in Python's whole numbers."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from siltstone.llm import clusters, queries

COLUMNS = "vec_id long, embedding array<float>, label int, distance double, cluster string"


def plain(rows, k=8, rounds=10, dims=64, scale=1024):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    z = [v for _, v in sorted(((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]]
    if not z:
        return []
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(z)), key=lambda j: (far(v, z[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        z = [[sum(x) // own.count(j) for x in zip(*(v for (_, v), o in zip(kept, own, strict=True) if o == j), strict=True)] if j in own else z[j] for j in range(len(z))]
    own = [(i, near(v), far(v, z[near(v)])) for i, v in kept]
    of = [sum(d for _, c, d in own if c == j) for j in range(len(z))]
    long = lambda x: x if x < 1 << 63 else None
    return [(i, c, long(d), long(of[c]), long(sum(of)), hashlib.sha256(",".join(map(str, z[c])).encode()).hexdigest()) for i, c, d in own]


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_plain(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    assert got(queries.op13_kd_filter(spark, f"/root/testdata/{sf}")) == sorted(plain(rows), key=str)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    near = [(i, [float(x) for x in np.float32(rng.normal(i % 5, 0.3, 4))]) for i in range(300)]
    copies = [(1000 + i, [0.5, 0.25, -1.0, 0.0]) for i in range(200)]
    odd = [(2000, None), (2001, [1.0, None, 2.0, 3.0]), (2002, [1.0, float("nan"), 0.0, 0.0]), (2003, [float("inf"), 0.0, 0.0, 0.0]), (2004, [1.0, 2.0]), (2005, []), (None, [1.0, 2.0, 3.0, 4.0]), (7, near[7][1]), (7, near[7][1])]
    rows = near + copies + odd
    df = spark.createDataFrame([(i, v, 0, 1.0, "x") for i, v in rows], COLUMNS)
    out = got(clusters.clustered(df.repartition(3), dims=4))
    assert out == sorted(plain(rows, dims=4), key=str) and len(out) == 503
    assert out == got(clusters.clustered(df.repartition(7), dims=4))
    few = df.where("vec_id < 3")
    assert got(clusters.clustered(few, dims=4)) == sorted(plain(near[:3], dims=4), key=str)
    assert clusters.clustered(df.where("vec_id >= 2000"), dims=4).count() == 0
    assert clusters.clustered(df.where("false")).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float(np.float32(x)) for x in (i * 1.5e4, -3e5 * (i % 3), 1e-3, 7.0)]) for i in range(60)] + [(100, [1e9, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, 1.0, "x") for i, v in rows], COLUMNS)
    out = got(clusters.clustered(df, dims=4, k=3, rounds=3))
    assert out == sorted(plain(rows, dims=4, k=3, rounds=3), key=str)


def test_trees_strike_out_and_keep_all(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-40, 40, (1000, 8)) + 5000 * c for c in range(6)])
    tree, order = clusters.Tree.of(points)
    again = clusters.Tree.unpacked(tree.packed())
    centroids = np.array([points[1000 * c] for c in range(6)] + [points[0], points[5]])
    owner, distance = again.assigned(centroids)
    every = ((points[order][:, None] - centroids) ** 2).sum(-1)
    assert (owner == every.argmin(1)).all() and (distance == every.min(1)).all()
    whole = sum(int((again.end[at] - again.begin[at]).sum()) for at, to in again.visits(centroids) if isinstance(to, int))
    assert whole >= 4900  # all but the group that holds several centroids go as whole nodes
    sums = again.gathered(centroids)
    for c in range(len(centroids)):
        mine = points[order][owner == c]
        assert sums[c] == [len(mine), int((mine**2).sum()), *mine.sum(0).tolist()]
