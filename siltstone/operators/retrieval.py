"""Parts of retrieval for all queries at once: embeddings, term counts, rank fusion, reranking, context."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import normalized, tokens

#: Fixed values of the published formulas: BM25's k1 and b, the rank constant of reciprocal rank fusion.
K1, B, RRF = 1.5, 0.75, 60
#: Passages returned; the lists before fusion hold twice, the fused list three times as many.
K = 3
#: Components of the hashing stand-in for an embedding model; queries that meet a shard at once, on average.
DIM, QUERY_BLOCK = 64, 4096


def ranked(df: DataFrame, k: int, *, by: str = "query_id", id_col: str = "chunk_id", score: str = "score") -> DataFrame:
    """The ``k`` best rows of each query with ``rank`` from 1; equal scores (to 9 digits) by id."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), id_col)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _hashed(texts):
    """Unit vectors of an Arrow array of words joined by spaces, some rows at a time."""
    import hashlib

    import pyarrow as pa
    import pyarrow.compute as pc

    places, out = {}, [np.zeros((0, DIM))]
    for at in range(0, len(texts), 1000):
        split = pc.split_pattern(texts[at : at + 1000], " ")
        row, coded = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split).dictionary_encode()
        words = coded.dictionary.to_pylist()
        for w in words:
            if w not in places:
                places[w] = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % DIM if w else DIM  # a text without words is one empty word
        code = row.astype(np.int64) * (DIM + 1) + np.array([places[w] for w in words], np.int64)[coded.indices.to_numpy()]
        counts = np.bincount(code, minlength=len(split) * (DIM + 1)).reshape(-1, DIM + 1)[:, :DIM].astype(float)
        norm = np.sqrt((counts * counts).sum(1, keepdims=True))
        out.append(counts / np.where(norm > 0, norm, 1))
    whole = np.concatenate(out)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, whole.size + 1, DIM, dtype=np.int32)), pa.array(whole.ravel()))


def embedding(text: Column) -> Column:
    """Stand-in embedding: counts of tokens hashed into DIM places, of unit length (zeros without tokens).

    Batch-wise in Arrow, as an embedding model would be.
    """
    return F.arrow_udf(_hashed, "array<double>")(normalized(text))


def postings(docs: DataFrame) -> DataFrame:
    """chunk_id, term, tf, dl: how often each token occurs in a document, and the document's length."""
    split = docs.select("chunk_id", tokens(F.col("text")).alias("t"))
    return split.select("chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf")).select("chunk_id", "term", "tf", "dl")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """n and mean length over all documents with a text."""
    return docs.where("text is not null").agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col("text")))).alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: each query's different tokens."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def idf(post: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf of every term."""
    return post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # stats is one row


def fused(lists: list[DataFrame], k: int) -> DataFrame:
    """query_id, chunk_id, score, rank: reciprocal rank fusion of ranked lists, cut to ``k``; ranks count from 0."""
    rows = lists[0].select("query_id", "chunk_id", "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select("query_id", "chunk_id", "rank"))
    return ranked(rows.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (RRF + F.col("rank") - 1)).alias("score")), k)


def reranked(candidates: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, text, score, rank: candidates by the share of the query's different tokens they hold.

    The stand-in for a cross-encoder; any scorer of (query, passage) fits in its place.
    """
    pairs = candidates.select("query_id", "chunk_id").join(docs.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("q")), "query_id")
    share = F.size(F.array_intersect("q", tokens(F.col("text")))) / F.greatest(F.size("q"), F.lit(1))
    return ranked(pairs.withColumn("score", share.cast("double")), k).drop("q")


def expansions(question: Column, listed: Column | None = None, lines: Column | None = None) -> Column:
    """The question, its expansions (a list whole, or the first two filled lines of a text) and a hypothetical answer.

    Stand-ins where no model gives them: the question's different tokens, and these sorted; the hypothetical answer
    states the question's tokens.
    """
    from siltstone.functions.text import strip

    own = F.array_distinct(tokens(question))
    if listed is None and lines is None:
        lines = F.concat(F.array_join(own, " "), F.lit("\n"), F.array_join(F.array_sort(own), " "))
    more = listed if listed is not None else F.slice(F.filter(F.transform(F.split(lines, "\n"), strip), lambda x: x != ""), 1, 2)
    return F.concat(F.array(question), more, F.array(F.concat(F.lit("It is about "), F.array_join(own, ", "), F.lit("."))))


def distinct_context(found: DataFrame) -> DataFrame:
    """question_id, pos, chunk_id, text: each different text once, where it was first found."""
    first = Window.partitionBy("question_id", "text").orderBy("query_pos", "rank")
    order = Window.partitionBy("question_id").orderBy("query_pos", "rank")
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("pos", F.row_number().over(order)).select("question_id", "pos", "chunk_id", "text")


def context_window(context: DataFrame, k: int = K) -> DataFrame:
    """The first k + 2 passages of each question, for the generator."""
    return context.where(F.col("pos") <= k + 2)
