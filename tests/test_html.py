from __future__ import annotations

from siltstone.functions.html import parse
from siltstone.functions.text import normalized, similarity_key, strip, title
from siltstone.operators.chunk import chunked, page_chunks


def texts(html):
    return [(b["tag"], b["text"]) for b in parse(html)[0]]


def test_nested_blocks_are_read_twice():
    assert texts("<li><p>x</p></li>") == [("li", "x"), ("p", "x")]


def test_an_unclosed_paragraph_holds_what_follows():
    assert texts("<p>a<p>b") == [("p", "a b"), ("p", "b")]


def test_small_headings_and_bare_text_are_no_blocks():
    assert texts("<h4>no</h4><div>no</div><p>yes</p>") == [("p", "yes")]


def test_main_content_and_junk():
    assert texts("<article><p>a</p></article><main><p>m</p></main>") == [("p", "m")]
    assert texts("<header><p>a</p></header><p>b</p><form><p>c</p></form><footer>d</footer>") == [("p", "b")]


def test_links_come_from_the_whole_page():
    assert parse('<nav><a href="/a">x</a></nav><p><a>y</a><a href="b">z</a></p>')[2] == ["/a", "b"]


def sequential(blocks, size=800, overlap=150):
    out, section, cur = [], "General", ""
    for tag, text in blocks:
        if tag.startswith("h"):
            if cur:
                out.append((cur.strip(), text))
            section, cur = text, ""
        else:
            cur = (cur or f"[{section}] ") + text + " "
            if len(cur) > size:
                out.append((cur.strip(), section))
                cur = f"[{section}] ... " + (cur[-overlap:] if len(cur) > overlap else "")
    return [*out, (cur.strip(), section)] if cur else out


def test_the_fold_equals_the_sequential_rule(spark):
    import random

    from pyspark.sql import functions as F

    random.seed(3)
    rows = [(i, [("h2" if random.random() < 0.2 else "p", "é" * random.randint(1, 700)) for _ in range(random.randint(0, 12))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, b array<struct<tag:string,text:string>>").select("i", chunked(F.col("b")).alias("c"))
    got = {r["i"]: [(c["text"], c["section"]) for c in r["c"]] for r in df.collect()}
    assert got == {i: sequential(b) for i, b in rows}


def test_a_chunk_bears_the_heading_that_closed_it(spark):
    pages = spark.createDataFrame([(1, "<h2>A</h2><p>x</p><h2>B</h2><p>y</p>"), (2, None)], "page_id int, html string")
    assert [(r["text"], r["section"], r["section_of_text"]) for r in page_chunks(pages).orderBy("ordinal").collect()] == [("[A] x", "B", "A"), ("[B] y", "B", "B")]


def test_text_functions(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("É a_b, x!", "　 a \x1c", "a1b cD")], "q string, s string, t string").select(similarity_key(F.col("q")).alias("k"), normalized(F.lit(None).cast("string")).alias("n"), strip(F.col("s")).alias("s"), title(F.col("t")).alias("t")).first()
    assert (row.k, row.n, row.s, row.t) == ("a_b x é", "", "a", "A1B Cd")


def test_a_page_of_many_blocks_takes_linear_time():
    from time import process_time

    from siltstone.operators.chunk import _fold

    def took(n):
        began = process_time()
        assert len(_fold(["p"] * n, ["the text of a block"] * n, 800, 150, "General")) > n / 50
        return process_time() - began

    took(1000)
    assert took(400_000) < 40 * max(took(40_000), 0.01) and took(100_000) < 5


def test_references_without_a_semicolon():
    html = "<h1>a&amp</h1><p>&copy;&quot;b&quot &am &#65; &#66 &zzz; &</p>"
    assert texts(html) == [("h1", "a&"), ("p", '©"b" &am A B &zzz; &')]
    assert [b["text"] for b in parse(html, bare_references=False)[0]] == ["a&amp", '©"b&quot &am A &#66 &zzz; &']
    assert parse('<a href="/x?a=1&b=2&amp;c=3">', bare_references=False)[2] == ["/x?a=1&b=2&c=3"]


def test_queries_of_pages_read_references_as_their_sql_does(spark, tmp_path):
    import duckdb

    from siltstone.plans.queries import QUERIES, SQL

    html = "<html><body><article><h1>Alpha &am</h1><p>Beta &amp; gamma&amp</p><p>" + "delta &quot;" * 10 + " &quot</p></article></body></html>"
    spark.createDataFrame([(1, "http://h.example/a", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("html_blocks", "structure_chunks", "marked_text", "page_clean_text", "chunk_metadata", "chunks_per_doc", "valid_chunks", "index_documents"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and want, name


def test_pages_are_read_in_pieces():
    import numpy as np
    import pyarrow as pa

    from siltstone.functions.html import PIECE_BYTES, _reader
    from siltstone.functions.pieces import spans

    assert list(spans(np.array([3, 3, 9, 1, 0, 1]), 6)) == [(0, 2), (2, 3), (3, 6)] and list(spans(np.array([], int), 6)) == []
    html = [f"<p>{i} " + "x" * 2000 + "</p>" for i in range(4000)] + [None, "<p>" + "y" * 2 * PIECE_BYTES + "</p>", "<p>z</p>"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(html))), pa.array(html, pa.string())], names=["page_id", "__html"])
    got = list(_reader(["page_id"], True)([batch]))
    assert sum(len(b) for b in got) == len(html) and max(len(b) for b in got) <= PIECE_BYTES / 2000
    assert [x for b in got for x in b.column("page_id").to_pylist()] == list(range(len(html)))
    assert [bool(x) for b in got for x in b.column("error").to_pylist()] == [h is None for h in html]
