"""Steps of a corpus pipeline: each takes documents and returns what it keeps of them, with the same columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, jaccard, lines, packing, quality
from siltstone.llm.common import written


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__key``, a hash of id and text: rows that share an id but not a text are judged apart."""
    return docs.withColumn("__key", F.xxhash64("doc_id", "text"))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key isn't among ``keys`` (written first, so that its size decides how it is joined)."""
    gone = written(keys.select("__key").distinct(), "gone")
    return _keyed(docs).join(gone, "__key", "left_anti").select(docs.columns)


def trusted_style(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; those without text go."""
    return quality.judged(docs, _table(spark, sf_dir, "labels"), keep_text=True).where("keep").select(docs.columns)


def first_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that copy an earlier one; a document of which nothing is left goes."""
    out = lines.deduplicated(docs)
    left = F.col("__dropped").isNull() | F.col("text").rlike("\\S")
    return out.where(left).withColumn("n_chars", F.when(F.col("__dropped").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(docs.columns)


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id (null first, then by hash) of each group of near copies, one row of it."""
    keyed = _keyed(docs)
    groups = written(jaccard.near_groups(keyed, id_col="__key").select(F.col("doc_id").alias("__key"), "component_id"), "groups")
    # Only groups of several texts and rows that repeat are looked at again.
    alone = F.col("low") == F.col("high")
    several = groups.groupBy("component_id").agg(F.min("__key").alias("low"), F.max("__key").alias("high")).where(~alone).select("component_id")
    members = keyed.select("__key", "doc_id").distinct().join(groups.distinct().join(several, "component_id"), "__key")
    firsts = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "__key")).alias("first"))
    kept = _without(docs, members.join(firsts, "component_id").where(F.col("__key") != F.col("first.__key")))
    repeated = written(groups.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key"), "repeated")
    once = _keyed(kept).join(repeated, "__key", "left_semi").dropDuplicates(["__key"])
    return _keyed(kept).join(repeated, "__key", "left_anti").unionByName(once).select(docs.columns)


def unseen_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = decontaminate.contamination(_keyed(docs), _table(spark, sf_dir, "benchmark"), id_col="__key").where("contaminated")
    return _without(docs, found.select(F.col("doc_id").alias("__key")))


def sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), end_id=1)
