from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import crawl


def test_breadth_first_search(spark):
    pages = spark.createDataFrame([(u, "x") for u in ("s", "a", "b", "c", "d", "e")], "url string, html string")
    edges = spark.createDataFrame([("s", 0, "a"), ("s", 1, "gone"), ("s", 2, "b"), ("a", 0, "c"), ("b", 0, "c"), ("c", 0, "s"), ("c", 1, "d"), ("d", 0, "e")], "url string, pos int, target string")
    seeds = spark.createDataFrame([("s", 0)], "url string, pos int")
    go = lambda **o: [(r["url"], r["depth"]) for r in crawl.crawl(seeds, edges, pages, F.lit(True), **o).orderBy("fetch_order").collect()]
    assert go() == [("s", 0), ("a", 1), ("b", 1), ("c", 2), ("d", 3)]
    assert go(max_pages=2) == [("s", 0), ("a", 1)]
    assert go(max_depth=1) == [("s", 0), ("a", 1), ("b", 1)]


def test_admission_and_names(spark):
    urls = ["http://h/p/x", "http://h/p/X.PDF", "http://g/p/x", "http://h/q", "http://h:80/p", "http://h/p/a/b/?q#f"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(crawl.admitted(F.col("url"), "h", "/p")).collect()] == [True, False, False, False, False, True]
    assert df.select(crawl.file_name(F.col("url"))).collect()[-1][0] == "p_a_b.html"


def test_a_crawl_of_pages_goes_on_from_its_tables(spark, tmp_path):
    page = lambda *hrefs: "<html><body><main>" + "".join(f'<a href="{h}">x</a>' for h in hrefs) + "</main></body></html>"
    site = {"/en/": page("a", "/en/b#top", "http://other.example/x"), "/en/a": page("b", "c.pdf", "/de/z"), "/en/b": page("/en/c", "/en/"), "/en/c": page("d"), "/de/z": page("/en/lost"), "/en/d": page("/en/e")}
    pages = spark.createDataFrame([(i, f"http://h{p}", h) for i, (p, h) in enumerate(site.items())], "page_id long, url string, html string")
    edges = crawl.resolved_links(pages).select("url", "pos", "target")
    seeds = spark.createDataFrame([("http://h/en/", 0)], "url string, pos int")
    admit, folder = crawl.admitted(F.col("url"), "h", "/en"), str(tmp_path / "crawl")
    go = lambda e=edges, **o: [(r["url"].removeprefix("http://h"), r["depth"]) for r in crawl.crawl(seeds, e, pages, admit, folder=folder, **o).orderBy("fetch_order").collect()]
    assert go(max_depth=1) == [("/en/", 0), ("/en/a", 1), ("/en/b", 1)]
    # The levels that are there aren't made again: without the first page's links the crawl still goes on from the second level.
    later = edges.where("url <> 'http://h/en/'")
    assert go(later) == [("/en/", 0), ("/en/a", 1), ("/en/b", 1), ("/en/c", 2), ("/en/d", 3)]
    plan = crawl.crawl(seeds, edges, pages, admit)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0  # it reads what the levels have written
