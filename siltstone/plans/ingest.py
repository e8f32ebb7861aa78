"""Pages to an index: chunks with metadata, an inverted index and vectors in cells as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators import chunk, search
from siltstone.sources.shared import shared_dir
from siltstone.sources.tables import stamp, table


def index(pages: DataFrame, folder: str, *, force: bool = False, source: str = "Knowledge Base") -> search.Index:
    """The index of the pages' chunks, read from ``folder`` or built there if missing or forced."""
    return search.load_or_build(chunk.corpus(pages, source=source), folder, force=force)


def documents_index(spark: SparkSession, sf_dir: str, *parts: str) -> search.Index:
    """The index of the table ``documents``, kept in the shared folder for as long as the table's files stay the same."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chunk_id")
    return search.load_or_build(docs, f"{shared_dir(spark).rstrip('/')}/index-format{search.FORMAT}-{stamp(spark, f'{sf_dir}/documents.parquet')}", stored=True, parts=parts or ("words", "vectors"))
