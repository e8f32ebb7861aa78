"""Incremental ingestion: chunks of pages as they arrive, and an index that grows with them.

An extension; the batch plans don't need it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions.html import parsed
from siltstone.operators import inverted
from siltstone.operators.chunk import chunked


def chunk_stream(pages: DataFrame, *, watermark: str = "1 hour") -> DataFrame:
    """page_id, ordinal, section, text from a stream of page_id, html, arrived; a page seen within the watermark is skipped."""
    fresh = pages.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["page_id"])
    return parsed(fresh.select("page_id", "html")).select("page_id", F.posexplode(chunked(F.col("blocks"))).alias("ordinal", "c")).select("page_id", "ordinal", "c.section", "c.text")


def index_stream(passages: DataFrame, folder: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Adds a stream of chunk_id, text to the inverted index in ``folder``, each micro-batch as a segment.

    A segment bears its batch's number, so a batch that comes again after a failure replaces what it wrote before; a
    search reads whole segments only and adds up their statistics. By default it ends when all that is there is read.
    """

    def add(batch: DataFrame, number: int) -> None:
        inverted.build(batch, folder, segment=number)

    return passages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
