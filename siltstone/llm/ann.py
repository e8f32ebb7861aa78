"""Nearest neighbours by score-aware (anisotropic) product quantisation.

A vector of unit length is cut into pairs of components; each pair is one of 16 codewords, so four bits. Codewords and
codes minimise a loss in which the residual's part along the vector weighs more than the part across it, as only the
former moves the large inner products. A search adds table entries for the codes (two codes of four bits to a byte),
takes the best of each chunk and reranks them by their exact cosine on the original vectors; then it reranks every other
vector whose code doesn't rule it out, so the result is exact. A code rules a vector out by angles: the query is no
nearer to the vector than to what the code stands for, less the angle between the two, which is kept beside the code.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import written

#: Vectors that the codewords are fitted on at most, those of the smallest hash; every vector is encoded.
FIT_VECTORS = 6_000
#: The cosine above which scores are to be exact; sets the weight of the residual along the vector.
TARGET = 0.2
CODES = 16
#: Chunks at least, vectors in a chunk and queries in a block at most on average, and candidates of each chunk reranked first.
LEAST_CHUNKS, CHUNK_VECTORS, BLOCK_QUERIES, RERANK = 64, 8192, 512, 32
#: What a bound is raised by for rounding (scans add single-precision numbers).
SLACK = 1e-4


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that very large or small components do no harm."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Quantiser:
    """Codewords for each pair of components (an odd last component gets a zero beside it)."""

    def __init__(self, dim: int, seed: int = 7):
        self.dim, self.pairs, self.seed = dim, (dim + 1) // 2, seed
        d = max(dim, 2)
        self.eta = max(1.0, (d - 1) * TARGET**2 / (1 - TARGET**2))
        self.words = np.zeros((self.pairs, CODES, 2))

    def _split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, 2 * self.pairs - self.dim))).reshape(len(x), self.pairs, 2)

    def fit(self, x: np.ndarray, rounds: int = 4) -> Quantiser:
        parts, rng = self._split(x), np.random.default_rng(self.seed)
        for m in range(self.pairs):  # plain k-means to begin with
            words = parts[rng.choice(len(x), CODES, replace=len(x) < CODES), m].copy()
            for _ in range(8):
                near = ((parts[:, m, None] - words) ** 2).sum(-1).argmin(1)
                n = np.bincount(near, minlength=CODES)
                for j in range(2):
                    words[:, j] = np.where(n, np.bincount(near, parts[:, m, j], CODES) / np.maximum(n, 1), words[:, j])
            self.words[m] = words
        for _ in range(rounds):
            self._update(parts, self.encode(x))
        return self

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, from the nearest codewords on."""
        parts = self._split(x)
        codes = np.empty((len(x), self.pairs), np.uint8)
        along = np.zeros(len(x))  # the residual's inner product with the vector
        errors = []
        for m in range(self.pairs):
            residual = parts[:, m, None] - self.words[m]
            errors.append(((residual**2).sum(-1), (residual * parts[:, m, None]).sum(-1)))
            codes[:, m] = errors[m][0].argmin(1)
            along += np.take_along_axis(errors[m][1], codes[:, m, None].astype(int), 1)[:, 0]
        for _ in range(sweeps):
            for m, (square, inner) in enumerate(errors):
                rest = along - np.take_along_axis(inner, codes[:, m, None].astype(int), 1)[:, 0]
                codes[:, m] = (square + (self.eta - 1) * (rest[:, None] + inner) ** 2).argmin(1)
                along = rest + np.take_along_axis(inner, codes[:, m, None].astype(int), 1)[:, 0]
        return codes

    def _update(self, parts: np.ndarray, codes: np.ndarray) -> None:
        """The codewords that minimise the loss for given codes: least squares over all of them together."""
        n, size = len(parts), self.pairs * CODES * 2
        a, b = np.zeros((size, size)), np.zeros(size)
        first = (np.arange(self.pairs) * CODES + codes) * 2  # place of each chosen codeword
        for j in range(2):
            a[np.diag_indices(size)] += np.bincount((first + j).ravel(), minlength=size)
            b += np.bincount((first + j).ravel(), parts[:, :, j].ravel(), size)
        for at in range(0, n, 1000):
            f, p = first[at : at + 1000], parts[at : at + 1000]
            v = np.zeros((len(f), size))
            rows = np.arange(len(f))[:, None]
            for j in range(2):
                v[rows, f + j] = p[:, :, j]
            a += (self.eta - 1) * v.T @ v
            b += (self.eta - 1) * v.T @ (p**2).sum((1, 2))
        a[np.diag_indices(size)] += 1e-6
        solved = np.linalg.solve(a, b).reshape(self.words.shape)
        used = np.bincount((first[:, :] // 2).ravel(), minlength=self.pairs * CODES).reshape(self.pairs, CODES) > 0
        self.words = np.where(used[:, :, None], solved, self.words)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """What the codes stand for, without the zero beside an odd last component."""
        return self.words[np.arange(self.pairs), codes].reshape(len(codes), -1)[:, : self.dim]

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte, one row for each pair of codes."""
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return np.ascontiguousarray((codes[:, ::2] * CODES + codes[:, 1::2]).T)

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For one query: the sum of two inner products for each byte that ``packed`` may hold."""
        scores = np.einsum("mcj,mj->mc", self.words, self._split(query[None])[0]).astype(np.float32)
        if len(scores) % 2:
            scores = np.vstack([scores, np.zeros((1, CODES), np.float32)])
        return (scores[::2, :, None] + scores[1::2, None, :]).reshape(len(scores) // 2, CODES * CODES)


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate inner products of one query with all encoded vectors."""
    total = tables[0].take(codes[0])
    for table, code in zip(tables[1:], codes[1:], strict=True):
        total += table.take(code)
    return total


class Bounds:
    """The largest cosine that a query can have with each vector, from what the vectors' codes stand for."""

    def __init__(self, x: np.ndarray, decoded: np.ndarray):
        self.length = np.linalg.norm(decoded, axis=1)
        # A code that stands for nothing rules nothing out: cosine -1 is an angle of half a turn.
        self.cos = np.where(self.length > 0, np.clip((x * decoded).sum(1) / np.where(self.length > 0, self.length, 1), -1, 1), -1)
        self.sin = np.sqrt(1 - self.cos**2)

    def of(self, rough: np.ndarray) -> np.ndarray:
        """``rough``: the query's inner products with what the codes stand for."""
        a = np.clip(rough / np.where(self.length > 0, self.length, 1), -1, 1)
        return np.where(a >= self.cos, 1.0, a * self.cos + np.sqrt(1 - a**2) * self.sin) + SLACK


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v of the rows that take part: not null, no null or non-finite component, not zero, of the most common length."""
    v = F.col("v")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists("v", lambda x: x != 0))
    dim = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (dim[0]["n"] if dim else 0))


def nearest(
    vectors: DataFrame, *, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, rerank: int = RERANK, fit_vectors: int = FIT_VECTORS
) -> DataFrame:
    """The ``k`` nearest rows found for each query row: query_id, rank, vec_id, score (exact cosine).

    ``is_query``: a condition on the column ``id``. Rows whose vector is null, zero, of another length than most, or
    holds null or non-finite components take no part, neither do rows of a null id. Equal vectors are searched as one,
    with its k + 1 smallest ids; ties go to the smaller id. Repeated rows of an id and a vector ask once,
    and a query doesn't find its own id. ``rerank`` vectors of each chunk are scored first; it changes the time and not
    the result. Fewer candidates than ``k`` give them all; an empty table gives no row.
    """
    spark = vectors.sparkSession
    # One row for each different vector; first by a salt of the id, as one vector may fill a third of the table.
    salted = usable(vectors, id_col, vector_col).groupBy("v", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    different = written(salted.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")), "vectors")
    queries = usable(vectors, id_col, vector_col).where(is_query).distinct()
    sample = [r["v"] for r in different.orderBy(F.xxhash64("v")).limit(fit_vectors).collect()]
    schema = "query_id long, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    quantiser = spark.sparkContext.broadcast(Quantiser(len(sample[0])).fit(unit(np.array(sample))))  # codewords: 2 * 16 numbers for each pair of components
    chunks = max(LEAST_CHUNKS, -(-different.count() // CHUNK_VECTORS))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    # Every chunk meets every block of the stated query set: copies of bounded groups, joined on both numbers.
    left = different.withColumns({"chunk": F.pmod(F.xxhash64("v"), F.lit(chunks)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = queries.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))})

    def best(rows, scores, ids, query_id):
        """(-score, id) of the k best; only vectors as good as the best k + 1, with all ties, are looked at."""
        if len(scores) > k + 1:
            keep = scores >= np.partition(scores, -(k + 1))[-(k + 1)]
            rows, scores = rows[keep], scores[keep]
        return sorted((-s, i) for s, j in zip(scores.tolist(), rows.tolist(), strict=True) for i in ids[j] if i != query_id)[:k]

    def search(data, asked):
        import pandas as pd

        out: list[tuple] = []
        if len(data) and len(asked):
            x, q = np.array(data["v"].tolist()), np.array(asked["v"].tolist())
            ux, uq, ids = unit(x), unit(q), data["ids"].tolist()
            plain = quantiser.value.encode(ux)
            codes, bounds = quantiser.value.packed(plain), Bounds(ux, quantiser.value.decode(plain))
            for query_id, vector in zip(asked["id"].tolist(), uq, strict=True):
                rough = scan(quantiser.value.tables(vector), codes)
                most = max(rerank, k + 1)
                first = np.argpartition(-rough, most)[:most] if len(rough) > most else np.arange(len(rough))
                # The k-th best so far; k + 1 vectors hold k ids besides the query's own.
                found = best(first, ux[first] @ vector, ids, query_id)
                if len(first) < len(rough):
                    take = np.flatnonzero(bounds.of(rough) >= -found[-1][0])
                    found = best(take, ux[take] @ vector, ids, query_id)
                out += [(query_id, i, -s) for s, i in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
