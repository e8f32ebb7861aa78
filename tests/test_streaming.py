"""Pages that arrive: their chunks once each, and an index that grows by segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import inverted
from siltstone.streaming import pages


def test_chunks_of_pages_once(spark, tmp_path):
    page = lambda i, text: (i, f"<main><h2>T</h2><p>{text}</p></main>", "2024-01-01 00:00:00")
    for k, rows in enumerate(([page(1, "one"), page(2, "two")], [page(2, "two again"), page(3, "three")])):
        spark.createDataFrame(rows, "page_id long, html string, arrived string").withColumn("arrived", F.to_timestamp("arrived")).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("page_id long, html string, arrived timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = pages.chunk_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["page_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [i for i, _ in got] == [1, 2, 3] and got[0][1] == "[T] one"


def test_index_grows_by_segments(spark, tmp_path):
    texts = [(i, f"word{i % 7} word{i % 5} common") for i in range(300)]
    rows = spark.createDataFrame(texts, "chunk_id long, text string")
    for k in range(3):
        rows.where(F.col("chunk_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    index, state = str(tmp_path / "index"), str(tmp_path / "state")
    run = lambda: pages.index_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), index, state).awaitTermination()
    asked = spark.createDataFrame([(1, "word3 word4"), (2, "word6 common"), (3, "new")], "query_id int, text string")
    answers = lambda folder: sorted(map(tuple, inverted.topk(inverted.load(spark, folder), asked, 5).withColumn("score", F.round("score", 9)).collect()))
    inverted.build(rows, str(tmp_path / "batch"))
    run()
    assert inverted.load(spark, index)["statistics"].count() == 3 and answers(index) == answers(str(tmp_path / "batch"))
    spark.createDataFrame([(1000, "new word3")], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert [r[:2] for r in answers(index) if r[0] == 3] == [(3, 1000)]
    inverted.build(rows.where("chunk_id % 3 = 0"), index, segment=0)  # as a batch that comes again would
    assert inverted.load(spark, index)["documents"].count() == 301
