"""The stored index against scores of every pair, the blocks and cells that a search leaves out, and its upkeep."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from siltstone.operators import cells, inverted, search
from siltstone.plans import ingest
from siltstone.sources import tables


def words(text):
    return re.findall(r"[^\W]+", text.lower())


def bm25(docs, queries, k):
    lists = {i: words(t) for i, t in docs if t is not None}
    avg = sum(map(len, lists.values())) / len(lists)
    df = {}
    for ws in lists.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, text in queries:
        score = {}
        for i, ws in lists.items():
            for w in set(words(text)):
                if tf := ws.count(w):
                    score[i] = score.get(i, 0) + math.log(1 + (len(lists) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avg))
        out[q] = [(i, pytest.approx(s)) for s, i in sorted((-round(s, 9), i) for i, s in score.items())[:k] for s in [-s]]
    return {q: x for q, x in out.items() if x}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(vocabulary[: rng.choice([5, 40, 400])]) for _ in range(rng.randrange(1, 60)))) for i in range(3000)]
    docs += [(4000 + i, "one common page of twelve words that many hosts serve again today") for i in range(1500)]
    return docs + [(9000, None), (9001, ""), (9002, " ... "), (9003, "long " * 5000)]


def test_bm25_equals_every_pair(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "SHARD_DOCS", 700)
    inverted.build(spark.createDataFrame(corpus, "chunk_id long, text string").repartition(5), str(tmp_path))
    index = inverted.load(spark, str(tmp_path))
    assert index["documents"].select("shard").distinct().count() > 3
    rng = random.Random(12)
    queries = [(i, " ".join(f"W{rng.randrange(450)}" for _ in range(rng.randrange(1, 8)))) for i in range(60)] + [(100, "common page"), (101, "absent"), (102, ""), (103, None), (104, "long W3 common")]
    got = {}
    for r in inverted.topk(index, spark.createDataFrame(queries, "query_id int, text string"), 6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    assert got == bm25(corpus, [q for q in queries if q[1] is not None], 6)
    monkeypatch.setattr(inverted, "QUERY_BLOCK", 7)
    again = inverted.topk(index, spark.createDataFrame(queries, "query_id int, text string"), 6).collect()
    assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in again} == {(q, n, i) for q, x in got.items() for n, (i, _) in enumerate(x, 1)}


def test_asking_reads_no_text_and_skips_blocks(spark, tmp_path):
    texts = [(i, "rare word here" if i == 500 else "common words only " * (1 + i % 9)) for i in range(2000)]
    inverted.build(spark.createDataFrame(texts, "chunk_id long, text string"), str(tmp_path))
    index = inverted.load(spark, str(tmp_path))
    found = inverted.topk(index, spark.createDataFrame([(1, "rare common")], "query_id int, text string"), 1)
    assert [r["chunk_id"] for r in found.collect()] == [500]
    plan = found._jdf.queryExecution().executedPlan().toString()
    logical = found._jdf.queryExecution().optimizedPlan().toString()
    assert "text:" not in plan and "In(bucket" in plan and re.search(r"file#\d+ IN \(", logical)
    buckets = [r[0] for r in spark.createDataFrame([("rare",), ("common",)], "t string").select(inverted.bucket_of(inverted.F.col("t"))).collect()]
    rows = index["postings"].where(inverted.F.col("bucket").isin(buckets) & (inverted.F.col("shard") == 0)).toArrow()
    scored = []
    run = inverted._block_best(1, 15.0)
    original = np.repeat
    try:
        np.repeat = lambda a, n: scored.append(int(np.asarray(n)[np.asarray(a)].sum())) or original(a, n)
        run(rows, spark.createDataFrame([(1, ["rare", "common"], [7.0, 0.001], 0, 0)], "query_id int, terms array<string>, idfs array<double>, segment long, shard long").toArrow())
    finally:
        np.repeat = original
    assert 0 < sum(scored) < 1000  # postings scored, of 2,001


def test_segments_add_up(spark, corpus, tmp_path):
    rows = spark.createDataFrame(corpus, "chunk_id long, text string")
    for k, part in enumerate(("chunk_id % 3 = 0", "chunk_id % 3 = 1", "chunk_id % 3 = 2", "false")):
        inverted.build(rows.where(part), str(tmp_path), segment=k)
    inverted.build(rows.where("chunk_id % 3 = 1"), str(tmp_path), segment=1)  # a batch that comes again
    queries = [(i, f"w{i} w{2 * i} w3 page") for i in range(20)]
    got = {}
    for r in inverted.topk(inverted.load(spark, str(tmp_path)), spark.createDataFrame(queries, "query_id int, text string"), 6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    assert got == bm25(corpus, queries, 6)


def test_only_allowed_passages_are_found(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "SHARD_DOCS", 900)
    rows = spark.createDataFrame([(i, t, "even" if i % 2 == 0 else "odd") for i, t in corpus], "chunk_id long, text string, section string")
    index = search.load_or_build(rows, str(tmp_path))
    queries = [(i, f"w{i} w{2 * i} w3 page") for i in range(20)]
    want = {q: [i for i, _ in x if i % 2][:5] for q, x in bm25(corpus, queries, len(corpus)).items()}
    asked = spark.createDataFrame(queries, "query_id int, text string")
    got = {}
    for r in inverted.topk(index, asked, 5, rows.where("section = 'odd'")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == want
    found = search.hybrid(index, asked, 2, where=search.F.col("section") == "odd").collect()
    assert len(found) >= 60 and all(r["chunk_id"] % 2 for r in found)
    assert search.hybrid(index, asked, 2, where=search.F.col("section") == "none").count() == 0


def test_empty_index(spark, tmp_path):
    index = search.load_or_build(spark.createDataFrame([], "chunk_id long, text string"), str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "a b")], "query_id int, text string")
    assert search.retrieve(index, asked).count() == 0


@pytest.fixture(scope="module", params=[(4000, 64), (4000, 256)])
def near(request):
    many, dims = request.param
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(40, dims))
    x = centres[rng.integers(0, 40, many)] + 0.6 * rng.normal(size=(many, dims))
    x[: many // 3] = x[0]  # a third of all vectors are one
    x[-1] = 0
    return x


def test_vectors_in_cells(spark, near, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PART_VECTORS", 500)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)] + [(9999, None)], "chunk_id long, vector array<double>")
    cells.build(rows.repartition(4), str(tmp_path))
    index = cells.load(spark, str(tmp_path))
    assert index["vectors"].count() == len(near) and index["cells"].where("parts > 1").count() >= 1
    asked = list(range(1400, len(near), 60)) + [len(near) - 1]
    queries = spark.createDataFrame([(i, near[i].tolist()) for i in asked], "query_id long, vector array<double>")

    def by_query(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r["chunk_id"])
        return out

    want = {i: [j for _, j in sorted((-round(float(near[j] @ near[i]), 9), j) for j in range(len(near)) if j != i)[:6]] for i in asked}
    assert by_query(cells.topk(index, queries, 6, exclude_self=True)) == want
    found = by_query(cells.topk(index, queries, 6, exclude_self=True, exact=False))
    assert sum(len(set(found[i]) & set(want[i])) for i in asked if i in found) >= 0.9 * 6 * len(asked)


def test_index_follows_its_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "shared_dir", lambda spark: str(tmp_path / "shared"))
    path = str(tmp_path / "t" / "documents.parquet")
    ask = lambda: [r["chunk_id"] for r in inverted.topk(ingest.documents_index(spark, str(tmp_path / "t")), spark.createDataFrame([(1, "fox")], "query_id int, text string"), 3).collect()]
    spark.createDataFrame([(1, "a fox"), (2, "a hen")], "doc_id long, text string").write.parquet(path)
    first = tables.stamp(spark, path)
    assert ask() == [1]
    with monkeypatch.context() as m:
        m.setattr(inverted, "build", None)  # it is there
        assert ask() == [1]
    spark.createDataFrame([(3, "fox fox")], "doc_id long, text string").write.mode("append").parquet(path)
    assert tables.stamp(spark, path) != first and ask() == [3, 1]


def test_a_query_meets_its_cells_in_bounded_batches():
    import numpy as np
    import pyarrow as pa

    from siltstone.operators import cells

    n, many, dim = 300, 500, 64
    run, _ = cells._probes(np.eye(many, dim), np.full(many, 2), np.full(many, 3.0), np.ones(many), 125, "bigint", False)
    queries = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([[1.0] * dim] * n)], names=["query_id", "vector"])
    got = list(run([queries, queries.slice(0, 0)]))
    assert sum(map(len, got)) == n * 125 * 2 and max(map(len, got)) * dim <= max(cells.AT_ONCE, 125 * 2 * dim)
    assert [q for b in got for q in b.column("query_id").to_pylist()] == [q for q in range(n) for _ in range(250)]


def test_postings_are_freed_of_other_terms_in_bounded_batches():
    import pyarrow as pa

    from siltstone.operators import inverted

    n = 2 * inverted.ONLY_ROWS + 1
    lists = {**{c: [[1, 1]] * n for c in inverted.PER_TERM}, **{c: [[7, 8]] * n for c in inverted.PER_BLOCK + inverted.PER_POSTING}}
    rows = pa.RecordBatch.from_pydict({"shard": list(range(n)), "terms": [["a", "b"]] * n, **{c: pa.array(x, pa.list_(pa.int32())) for c, x in lists.items()}})
    got = list(inverted._only(["b"])([rows]))
    assert [len(b) for b in got] == [inverted.ONLY_ROWS, inverted.ONLY_ROWS, 1]
    assert [x for b in got for x in b.column("shard").to_pylist()] == list(range(n))
    assert all(b.column("tfs").to_pylist() == [[8]] * len(b) and b.column("terms").to_pylist() == [["b"]] * len(b) for b in got)
