"""Vector search in coarse cells: a query probes the cells nearest to it, and in exact mode all that could hold a hit.

Centres are fitted on a bounded sample; every vector is stored with its cell, and a cell of many vectors in parts, so that
one direction that a third of them shares is no single task's work. A cell keeps the largest angle between its centre and
a member and the largest length of a member, so a query's inner products in it have a bound by the angles. The exact mode
takes the k-th score of the probed cells and then searches every other cell whose bound reaches it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.retrieval import ranked
from siltstone.sources.shared import written

#: Vectors that centres are fitted on at most (of the smallest hash), centres at most, vectors of a part on average.
FIT_VECTORS, MOST_CELLS, PART_VECTORS = 20_000, 1024, 8192
#: Cells that a query probes: a share of them all, but so many at least.
PROBES, LEAST_PROBES = 0.25, 4
#: Numbers of a matrix of vectors and cells that a worker makes at once.
AT_ONCE = 1_000_000
TABLES = ("cells", "vectors")


def fitted(sample: np.ndarray, many: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit length by k-means on directions; the first are spread over the sample."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centres = x[np.linspace(0, len(x) - 1, many).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.where(size > 1e-12, size, 1), centres)
    return centres


def _pieces(batches, rows: int):
    """The batches in slices of so many rows; empty ones are left out."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def build(vectors: DataFrame, folder: str) -> None:
    """Writes cells and vectors (chunk_id, vector; all of one length, null ones left out) to ``folder``."""
    spark, id_type = vectors.sparkSession, vectors.schema["chunk_id"].dataType.simpleString()
    rows = vectors.where("chunk_id is not null and vector is not null").select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    rows = written(rows, "vectors")  # what made the vectors, a model maybe, is asked once
    turned = rows.where(F.exists("vector", lambda v: v != 0))
    sample = [r["vector"] for r in turned.orderBy(F.xxhash64("chunk_id")).limit(FIT_VECTORS).collect()]  # bounded
    many = int(np.clip(np.sqrt(max(1, rows.count())), 1, min(MOST_CELLS, max(1, len(sample)))))
    centres = fitted(np.array(sample), many) if sample else np.zeros((1, 1))

    def placed(batches):
        import pyarrow as pa

        for batch in _pieces(batches, max(1, AT_ONCE // len(centres))):
            flat = batch.column(1)
            x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            size = np.linalg.norm(x, axis=1)
            near = (x @ centres.T if sample else np.zeros((len(x), 1))) / np.where(size > 0, size, 1)[:, None]
            own = near.argmax(1)
            angle = np.arccos(np.clip(near[np.arange(len(x)), own], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array(own.astype(np.int32)), pa.array(np.where(size > 0, angle, 0.0)), pa.array(size)], names=["chunk_id", "vector", "cell", "angle", "size"])

    held = written(rows.mapInArrow(placed, f"chunk_id {id_type}, vector array<double>, cell int, angle double, size double"), "placed")
    parts = F.ceil(F.count("*") / PART_VECTORS).cast("int").alias("parts")
    spans = held.groupBy("cell").agg(F.count("*").alias("n"), parts, F.max("angle").alias("angle"), F.max("size").alias("size"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")  # MOST_CELLS rows at most
    cells = written(known.join(spans, "cell"), "cells")
    dealt = held.join(F.broadcast(cells.select("cell", "parts")), "cell").select("cell", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int").alias("part"), "chunk_id", "vector")
    dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").parquet(f"{folder}/vectors")
    cells.coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}


def _probes(centres, parts, angles, sizes, probes: int, query_type: str, known: bool):
    """Cells for each query: the nearest, or (``known``: with the k-th score ``least``) the others that may reach it."""

    def run(batches):
        import pyarrow as pa

        # A query's vector goes to each part of each of its cells.
        for batch in _pieces(batches, max(1, AT_ONCE // max(1, int(parts.sum()) * centres.shape[1]))):
            q = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            size = np.linalg.norm(q, axis=1)
            near = np.clip(q @ centres.T / np.where(size > 0, size, 1)[:, None], -1, 1)
            first = np.zeros(near.shape, bool)
            first[np.arange(len(q))[:, None], np.argsort(-near, axis=1, kind="stable")[:, :probes]] = True
            if known:
                least = batch.column(2).to_numpy(zero_copy_only=False).astype(float)  # NaN: fewer than k found, so every cell
                bound = (np.maximum(np.cos(np.maximum(np.arccos(near) - angles, 0)), 0) + 1e-6) * sizes * size[:, None]
                first = ~first & ~(bound + 1e-9 < least[:, None])
            row, cell = np.nonzero(first)
            times = parts[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32))], names=["query_id", "vector", "place", "part"])

    return run, f"query_id {query_type}, vector array<double>, place int, part int"


def _best(k: int, exclude_self: bool):
    def run(rows, asked):
        import pyarrow as pa

        ids, query_ids = rows["chunk_id"].combine_chunks(), asked["query_id"].combine_chunks()
        whose, which, scores = [], [], []
        if len(ids) and len(query_ids):
            x, q = (t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (rows, asked))
            names = ids.to_pylist()
            for j, query_id in enumerate(query_ids.to_pylist()):
                score = x @ q[j]
                least = np.partition(score, -min(len(score), k + 1))[-min(len(score), k + 1)]
                near = np.flatnonzero(score >= least - 1e-8).tolist()
                best = sorted((round(-score[i], 9), names[i], i) for i in near if not (exclude_self and names[i] == query_id))[:k]
                whose += [j] * len(best)
                which += [i for *_, i in best]
                scores += [float(score[i]) for *_, i in best]
        return pa.table([query_ids.take(pa.array(whose, pa.int64())), ids.take(pa.array(which, pa.int64())), pa.array(scores, pa.float64())], names=["query_id", "chunk_id", "score"])

    return run


def topk(index: dict[str, DataFrame], queries: DataFrame, k: int, *, exact: bool = True, probes: int | None = None, exclude_self: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the ``k`` largest inner products for each query (query_id, vector) in the index.

    ``exact``: cells that aren't probed are searched too where their bound reaches the k-th score. Ties (to 9 digits) go
    to the smaller id. ``allowed``: chunk_id of the vectors that may be found, where not all may. Queries of a null id or vector ask nothing. Every query meets a cell in its parts of bounded size.
    """
    spark = queries.sparkSession
    id_type, query_type = (df.schema[c].dataType.simpleString() for df, c in ((index["vectors"], "chunk_id"), (queries, "query_id")))
    cells = index["cells"].orderBy("cell").collect()  # MOST_CELLS rows at most
    if not cells:
        return spark.createDataFrame([], f"query_id {query_type}, chunk_id {id_type}, score double, rank int")
    number = {r["cell"]: i for i, r in enumerate(cells)}
    centres, parts, angles, sizes = (np.array([r[c] for r in cells]) for c in ("centre", "parts", "angle", "size"))
    probes = probes or max(LEAST_PROBES, round(PROBES * len(cells)))
    places = spark.createDataFrame(list(number.items()), "cell int, place int")
    stored = index["vectors"].join(F.broadcast(places), "cell")  # as many rows as cells
    if allowed is not None:
        stored = stored.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    asked = queries.where("query_id is not null and vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    best = _best(k, exclude_self)

    def search(rows, known):
        run, schema = _probes(centres, parts, angles, sizes, probes, query_type, known)
        met = stored.groupBy("place", "part").cogroup(rows.mapInArrow(run, schema).groupBy("place", "part"))
        return met.applyInArrow(lambda left, right: best(left, right), f"query_id {query_type}, chunk_id {id_type}, score double")

    found = search(asked, False)
    if exact:
        found = written(found, "probed")
        kth = ranked(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        found = found.unionByName(search(asked.join(kth, "query_id", "left"), True))
    return ranked(found, k)
