"""Hybrid retrieval on a stored index: vectors and BM25, rank fusion, reranking, and all queries of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import cells, inverted
from siltstone.operators.retrieval import K, embedding, expansions, fused, reranked
from siltstone.sources.tables import is_written

#: Goes up with every change of how an index is stored, and is part of where a kept one is looked for.
FORMAT = 2
#: An index is these tables, by name.
Index = dict[str, DataFrame]


def load_or_build(docs: DataFrame, folder: str, *, force: bool = False, stored: bool = False, parts: tuple[str, ...] = ("words", "vectors")) -> Index:
    """The index of chunk_id, text below ``folder``; what isn't there whole, or is forced, is built first.

    ``stored``: the passages are a table already, and are not copied beside the index. ``parts``: what is needed of it.
    """
    spark = docs.sparkSession
    if not stored and (force or not is_written(spark, f"{folder}/chunks")):
        docs.write.mode("overwrite").parquet(f"{folder}/chunks")
    chunks = docs if stored else spark.read.parquet(f"{folder}/chunks")
    if "words" in parts and (force or not inverted.is_whole(spark, folder)):
        inverted.build(chunks.select("chunk_id", "text"), folder)
    if "vectors" in parts and (force or not is_written(spark, f"{folder}/cells")):
        cells.build(chunks.select("chunk_id", embedding(F.col("text")).alias("vector")), folder)
    return load(spark, folder, chunks, parts)


def load(spark: SparkSession, folder: str, chunks: DataFrame | None = None, parts: tuple[str, ...] = ("words", "vectors")) -> Index:
    index = {"chunks": spark.read.parquet(f"{folder}/chunks") if chunks is None else chunks}
    if "words" in parts:
        index |= inverted.load(spark, folder)
    return index | cells.load(spark, folder) if "vectors" in parts else index


def vectors_topk(index: Index, queries: DataFrame, k: int, **options) -> DataFrame:
    """The ``k`` nearest passages by the embeddings of the queries' texts."""
    return cells.topk(index, queries.select("query_id", embedding(F.col("text")).alias("vector")), k, **options)


def hybrid(index: Index, queries: DataFrame, k: int = K, *, exact: bool = True, where: Column | None = None) -> DataFrame:
    """The fused candidates of vectors and BM25: 2k of each list, 3k together; of the passages that fulfil ``where``."""
    allowed = None if where is None else index["chunks"].where(where).select("chunk_id")
    return fused([vectors_topk(index, queries, 2 * k, exact=exact, allowed=allowed), inverted.topk(index, queries, 2 * k, allowed)], 3 * k)


def retrieve(index: Index, queries: DataFrame, k: int = K, k_asked: int | None = None, *, exact: bool = True, where: Column | None = None) -> DataFrame:
    """query_id, chunk_id, text, score, rank: the reranked passages; asking for more than ``k`` gives ``k``.

    ``where``: a condition on the passages' metadata (their columns in the index), applied before the lists are cut.
    """
    return reranked(hybrid(index, queries, k, exact=exact, where=where), queries, index["chunks"], min(k, k_asked if k_asked is not None else k))


def multi_query(index: Index, questions: DataFrame, k: int = K, queries: DataFrame | None = None, *, exact: bool = True) -> DataFrame:
    """question_id, query_pos, rank, chunk_id, text, score: every query of every question, in order.

    ``queries``: question_id, query_pos, text where a provider has expanded the questions; else the stand-ins do.
    """
    if queries is None:
        queries = questions.select("question_id", F.posexplode(expansions(F.col("text"))).alias("query_pos", "text"))
    keyed = queries.withColumn("query_id", F.concat_ws(":", F.col("question_id").cast("string"), F.col("query_pos").cast("string")))
    # The same text asked twice is retrieved once for each, as the order of the queries counts.
    found = retrieve(index, keyed.select("query_id", "text"), k, exact=exact)
    return found.join(keyed.select("query_id", "question_id", "query_pos"), "query_id").select("question_id", "query_pos", "rank", "chunk_id", "text", "score")
