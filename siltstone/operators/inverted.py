"""A stored inverted index, and BM25 by block maxima on it: asking reads the buckets of the asked terms and no text.

Documents are dealt to shards by a hash of their id and numbered within them, terms to buckets by a hash. A row of the
postings is a bucket in a shard: its terms, and for each the documents' numbers with counts and lengths, and for each
block of documents the largest count and the smallest length, which bound every score in it whatever the statistics
become. A shard meets the queries in blocks; for each query it scores the blocks of the largest bounds first and after
them only those whose bound reaches the k-th score so far.

The index consists of segments: what is written at once is one, and a search reads them all, with their statistics
added up. So documents are added without touching what is there, and writing a segment again replaces it.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import normalized
from siltstone.operators.retrieval import K1, QUERY_BLOCK, B, query_terms, ranked
from siltstone.sources.shared import written
from siltstone.sources.tables import is_written

#: Documents to a shard on average, to a block of it, and blocks that a query scores before any is skipped.
SHARD_DOCS, BLOCK_DOCS, FIRST_BLOCKS = 2048, 64, 4
#: Buckets of terms, and buckets and shards that share a file.
BUCKETS, FILE_BUCKETS, FILE_SHARDS = 1024, 32, 32
#: Terms, in all blocks of queries, whose buckets are named in the scan; and up to which they are sent to all tasks.
NAMED, SENT = 1000, 100_000
#: Rows of postings, a bucket in a shard each, that are freed of other terms at once.
ONLY_ROWS = 256
#: Lists of a bucket in a shard: one entry for each term, for each block of each term, for each posting of each term.
PER_TERM, PER_BLOCK, PER_POSTING = ("n_blocks", "df"), ("blocks", "sizes", "max_tf", "min_dl"), ("locals", "tfs", "dls")
LISTS = PER_TERM + PER_BLOCK + PER_POSTING
_POSTINGS = ", ".join(["shard long", "bucket int", "terms array<string>", *(f"{c} array<int>" for c in LISTS)])
_DOCUMENTS = "chunk_id {}, shard long, local int, dl int"


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _shard_postings(table):
    """Of one shard (chunk_id, shard, words): a row for each document (without terms), and one for each bucket."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    table = table.take(pc.sort_indices(table["chunk_id"].combine_chunks()))
    shard, n = table["shard"][0].as_py(), table.num_rows
    split = pc.split_pattern(table["words"].combine_chunks(), " ")
    doc, coded = pc.list_parent_indices(split).to_numpy().astype(np.int64), pc.list_flatten(split).dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy()
    # Terms are numbered by bucket; Spark's hash of a string, seeded as Spark does.
    bucket = np.array([xxhash.xxh64_intdigest(w, 42) for w in words.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64) % BUCKETS
    by_bucket = np.argsort(bucket, kind="stable")
    number = np.empty(len(words), np.int64)
    number[by_bucket] = np.arange(len(words))
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[ids]  # a text without words is one empty word
    doc, ids = doc[filled], number[ids[filled]]
    dl = np.bincount(doc, minlength=n).astype(np.int32)
    code, tf = np.unique(ids * n + doc, return_counts=True)
    term, local = code // n, (code % n).astype(np.int32)
    first = lambda x: np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    spans = lambda starts, end: np.diff(np.r_[starts, end])
    of_term, of_block = first(term), first(term * (n // BLOCK_DOCS + 1) + local // BLOCK_DOCS)
    reduced = lambda f, x: f.reduceat(x, of_block) if len(of_block) else x
    flat = {
        "df": spans(of_term, len(term)), "blocks": local[of_block] // BLOCK_DOCS, "sizes": spans(of_block, len(term)), "max_tf": reduced(np.maximum, tf), "min_dl": reduced(np.minimum, dl[local]),
        "locals": local, "tfs": tf, "dls": dl[local],
    }
    at_block = np.searchsorted(of_block, of_term)
    flat["n_blocks"] = spans(at_block, len(of_block))
    used = by_bucket[term[of_term]]
    of_bucket = first(bucket[used])
    ends = {**dict.fromkeys(PER_TERM, (of_bucket, len(of_term))), **dict.fromkeys(PER_BLOCK, (at_block[of_bucket], len(of_block))), **dict.fromkeys(PER_POSTING, (of_term[of_bucket], len(term)))}
    offsets = lambda starts, end: pa.array(np.r_[starts, end].astype(np.int32))
    lists = {c: pa.ListArray.from_arrays(offsets(*ends[c]), pa.array(np.asarray(flat[c], np.int32))) for c in LISTS}
    named = pa.ListArray.from_arrays(offsets(of_bucket, len(of_term)), words.take(pa.array(used)))
    many, ids_of = len(of_bucket), table["chunk_id"].combine_chunks()
    docs = {"chunk_id": ids_of, "local": pa.array(np.arange(n, dtype=np.int32)), "dl": pa.array(dl), "shard": pa.array([shard] * n, pa.int64()), "bucket": pa.array([-1] * n, pa.int32()), "terms": pa.nulls(n, named.type), **{c: pa.nulls(n, x.type) for c, x in lists.items()}}
    own = {"chunk_id": pa.nulls(many, ids_of.type), "local": pa.nulls(many, pa.int32()), "dl": pa.nulls(many, pa.int32()), "shard": pa.array([shard] * many, pa.int64()), "bucket": pa.array(bucket[used][of_bucket].astype(np.int32)), "terms": named, **lists}
    return pa.concat_tables([pa.table(docs), pa.table(own)])


def build(docs: DataFrame, folder: str, segment: int = 0) -> None:
    """Writes chunk_id, text as a segment of the index in ``folder``. Ids are new to the index and tell documents apart; a
    null text is not indexed.
    """
    spark, id_type, at = docs.sparkSession, docs.schema["chunk_id"].dataType.simpleString(), f"segment={segment}"
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    dealt = docs.where("text is not null").select("chunk_id", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).alias("shard"), normalized(F.col("text")).alias("words"))
    made = dealt.groupBy("shard").applyInArrow(_shard_postings, f"chunk_id {id_type}, local int, dl int, {_POSTINGS}")
    # A file holds some buckets of some shards, in order, so that neither a common term nor a large corpus is one task's; documents are in files of their own.
    places = made.withColumn("file", F.floor(F.col("bucket") / FILE_BUCKETS).cast("int"))
    placed = places.repartition("file", F.floor(F.col("shard") / FILE_SHARDS)).sortWithinPartitions("file", "bucket", "shard")
    placed.write.mode("overwrite").partitionBy("file").parquet(f"{folder}/postings/{at}")
    held = spark.read.schema(f"{_DOCUMENTS.format(id_type)}, bucket int, terms array<string>, df array<int>, file int").parquet(f"{folder}/postings/{at}")
    counts = held.where("file >= 0").select("file", "bucket", F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("file", "bucket", F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    counts.repartition("file", F.pmod(F.xxhash64("term"), F.lit(FILE_BUCKETS))).sortWithinPartitions("file", "bucket", "term").write.mode("overwrite").partitionBy("file").parquet(f"{folder}/terms/{at}")
    sums = held.where("file = -1").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"), F.coalesce(F.max("shard") + 1, F.lit(0)).alias("shards"))
    # One row, last: a segment without it isn't searched.
    sums.withColumn("id_type", F.lit(id_type)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/statistics/{at}")


def is_whole(spark: SparkSession, folder: str, segment: int = 0) -> bool:
    return is_written(spark, f"{folder}/statistics/segment={segment}")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of all whole segments."""

    def read(name: str, columns: str, *by: str) -> DataFrame:
        return spark.read.schema(", ".join([columns, "segment long", *by])).parquet(f"{folder}/{name}")

    statistics = read("statistics", "n long, words long, shards long, id_type string")
    documents = read("postings", _DOCUMENTS.format(statistics.first()["id_type"]), "file int").where("file = -1").drop("file")
    return {"statistics": statistics, "documents": documents, "terms": read("terms", "bucket int, term string, df long", "file int"), "postings": read("postings", _POSTINGS, "file int").where("file >= 0")}


def _block_best(k: int, avgdl: float, filtered: bool = False):
    """The search of one shard for one block of queries, as a function of two Arrow tables."""

    def run(postings, asked):
        import pyarrow as pa
        import pyarrow.compute as pc

        out: list[tuple] = []
        if postings.num_rows and asked.num_rows:
            named = postings["terms"].is_valid()
            allowed = np.concatenate([np.zeros(0, int), *(x.as_py() for x in postings.filter(pc.invert(named))["locals"])]) if filtered else None
            postings = postings.filter(named)
            flat = {c: postings[c].combine_chunks().flatten() for c in ("terms", *LISTS)}
            weight = dict(chain.from_iterable(zip(t, w, strict=True) for t, w in zip(asked["terms"].to_pylist(), asked["idfs"].to_pylist(), strict=True)))
            # Rows follow one another, so a term's lists are a slice of all rows' lists.
            known = pc.is_in(flat["terms"], pa.array(list(weight), pa.string())).to_numpy(zero_copy_only=False)
            flat = {c: x.to_numpy(zero_copy_only=False) for c, x in flat.items()}
            block_ends, ends = (np.r_[0, np.cumsum(flat[c], dtype=np.int64)] for c in PER_TERM)
            part = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            rows = {}
            for i in np.flatnonzero(known).tolist():
                b, p, idf = slice(block_ends[i], block_ends[i + 1]), slice(ends[i], ends[i + 1]), weight[flat["terms"][i]]
                rows[flat["terms"][i]] = flat["blocks"][b], flat["sizes"][b], idf * part(flat["max_tf"][b], flat["min_dl"][b]), flat["locals"][p], idf * part(flat["tfs"][p], flat["dls"][p])
            n_docs = max((int(r[3][-1]) + 1 for r in rows.values()), default=0)
            n_blocks = -(-n_docs // BLOCK_DOCS)
            score, fits = np.zeros(n_docs), np.ones(n_docs, bool)
            if filtered:
                fits = np.zeros(n_docs, bool)
                fits[allowed[allowed < n_docs]] = True
            some = np.add.reduceat(fits, np.arange(0, n_docs, BLOCK_DOCS)) > 0 if n_docs else fits

            def add(mine, wanted):
                for blocks, sizes, _, docs, parts in mine:
                    keep = np.repeat(wanted[blocks], sizes)
                    keep &= fits[docs]
                    score[docs[keep]] += parts[keep]  # a document comes once in a term's list

            for query_id, terms in zip(asked["query_id"].to_pylist(), asked["terms"].to_pylist(), strict=True):
                mine = [rows[t] for t in terms if t in rows]
                if not mine:
                    continue
                bound = np.zeros(n_blocks)
                for blocks, _, most, _, _ in mine:
                    bound[blocks] += most
                bound[~some] = 0  # no document that may be found
                score[:] = 0
                wanted = np.zeros(n_blocks, bool)
                wanted[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
                add(mine, wanted)
                least = np.partition(score, -k)[-k] if n_docs >= k else 0.0
                more = ~wanted & (bound > 0) & (bound >= least - 1e-8)
                if more.any():
                    add(mine, more)
                least = np.partition(score, -k)[-k] if n_docs >= k else 0.0
                near = np.flatnonzero((score >= least - 1e-8) & (score > 0))
                best = sorted(zip((-np.round(score[near], 9)).tolist(), near.tolist(), strict=True))[:k]
                out += [(query_id, i, float(score[i])) for _, i in best]
        segment, shard = (asked[c][0].as_py() if asked.num_rows else 0 for c in ("segment", "shard"))
        return pa.table([pa.array([q for q, _, _ in out], asked.schema.field("query_id").type), pa.array([segment] * len(out), pa.int64()), pa.array([shard] * len(out), pa.int64()), pa.array([i for _, i, _ in out], pa.int32()), pa.array([s for _, _, s in out], pa.float64())], names=["query_id", "segment", "shard", "local", "score"])

    return run


def _only(asked: list[str]):
    """Rows of postings without the terms that no query has, so that these aren't shuffled; rows that keep none go."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        wanted = pa.array(asked, pa.string())
        for batch in (whole.slice(at, ONLY_ROWS) for whole in batches for at in range(0, len(whole), ONLY_ROWS)):
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            flat = {c: columns[c].flatten() for c in ("terms", *LISTS)}
            keep = pc.is_in(flat["terms"], wanted).to_numpy(zero_copy_only=False)
            n_blocks, df = (flat[c].to_numpy(zero_copy_only=False) for c in PER_TERM)
            row = np.repeat(np.arange(len(batch)), np.diff(columns["terms"].offsets.to_numpy()))
            masks = {c: (keep, row) for c in ("terms", *PER_TERM)} | {c: (np.repeat(keep, n_blocks), np.repeat(row, n_blocks)) for c in PER_BLOCK} | {c: (np.repeat(keep, df), np.repeat(row, df)) for c in PER_POSTING}

            def kept(c):
                mask, of = masks[c]
                ends = np.r_[0, np.cumsum(np.bincount(of[mask], minlength=len(batch)))].astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(ends), flat[c].filter(pa.array(mask)))

            out = pa.RecordBatch.from_arrays([kept(c) if c in masks else x for c, x in columns.items()], names=batch.schema.names)
            yield out.filter(pa.array(np.isin(np.arange(len(batch)), row[keep])))

    return run


def topk(index: dict[str, DataFrame], queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the ``k`` best documents of the index by BM25 for each query (query_id, text).

    ``allowed``: chunk_id of the documents that may be found, where not all may (weights still come from all of them).
    Queries of a null text and without any known term have no row. Ties (to 9 digits) go to the smaller id.
    """
    segments = [r for r in index["statistics"].collect() if r["n"]]  # one row a segment
    n = sum(r["n"] for r in segments)
    id_type, query_type = (df.schema[c].dataType.simpleString() for df, c in ((index["documents"], "chunk_id"), (queries, "query_id")))
    if not n:
        return queries.sparkSession.createDataFrame([], f"query_id {query_type}, chunk_id {id_type}, score double, rank int")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
    whole = F.col("segment").isin([r["segment"] for r in segments])
    terms, df = query_terms(queries).select("query_id", "term", bucket_of(F.col("term")).alias("bucket")), F.col("df")
    postings, known = index["postings"].where(whole), index["terms"].where(whole)
    few = terms.select("bucket", "term").distinct().limit(NAMED + 1).collect()  # bounded
    if len(few) <= NAMED:  # files and row groups without them aren't read
        here = sorted({r["bucket"] for r in few})
        files = F.col("file").isin(sorted({x // FILE_BUCKETS for x in here}))
        postings, known = (x.where(files & F.col("bucket").isin(here)) for x in (postings, known))
        known = known.where(F.col("term").isin(sorted(r["term"] for r in few)))
    idf = known.join(terms.select("bucket", "term").distinct(), ["bucket", "term"]).groupBy("term").agg(F.sum("df").alias("df")).select("term", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))
    weighted = written(terms.join(idf, "term"), "asked")
    buckets = weighted.select(block, "bucket").distinct()
    named = [r["term"] for r in weighted.select("term").distinct().limit(SENT + 1).collect()]  # bounded
    postings = postings.select("segment", "shard", "bucket", "terms", *LISTS)
    if len(named) <= SENT:
        postings = postings.mapInArrow(_only(named), postings.schema)
    hits = postings.join(F.broadcast(buckets) if buckets.count() <= SENT else buckets, "bucket").select("segment", "shard", "block", "terms", *LISTS)
    shards = queries.sparkSession.createDataFrame([(r["segment"], r["shards"]) for r in segments], "segment long, shards long")
    every = weighted.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idfs")).crossJoin(F.broadcast(shards))  # every query meets every shard, in blocks: one row a segment is sent
    every = every.select(block, "query_id", "terms", "idfs", "segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    search, by = _block_best(k, sum(r["words"] for r in segments) / n, allowed is not None), ("segment", "shard", "block")
    if allowed is not None:
        # A shard's allowed documents come as one more row of postings, without terms, for each block of queries.
        own = index["documents"].where(whole).join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("segment", "shard").agg(F.collect_list(F.col("local").cast("int")).alias("locals"))
        own = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast(f"array<{hits.schema['block'].dataType.simpleString()}>")))
        hits = hits.unionByName(own, allowMissingColumns=True)
    found = hits.groupBy(*by).cogroup(every.groupBy(*by)).applyInArrow(lambda left, right: search(left, right), f"query_id {query_type}, segment long, shard long, local int, score double")
    places = index["documents"].where(whole).select("segment", "shard", "local", "chunk_id")
    return ranked(found.join(places, ["segment", "shard", "local"]).select("query_id", "chunk_id", "score"), k)
