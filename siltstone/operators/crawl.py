"""Crawling over a table of pages: links, admission of URLs, bounded breadth-first search, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.html import parsed, resolved
from siltstone.functions.text import url_part
from siltstone.sources.shared import new_folder
from siltstone.sources.tables import is_written

#: Path endings that are never fetched.
SKIPPED = (".pdf", ".zip", ".jpg", ".png", ".mp4")
MAX_DEPTH, MAX_PAGES = 3, 50


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href of every link, in document order."""
    return parsed(pages.select("page_id", "url", "html")).select("page_id", "url", F.posexplode("links").alias("pos", "href"))


def resolved_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, target: links as absolute URLs without fragments."""
    return links(pages).select("page_id", "url", "pos", resolved(F.col("url"), F.col("href")).alias("target"))


def admitted(url: Column, host: str, prefix: str) -> Column:
    """Same host, path below the prefix, and no skipped ending."""
    path = url_part(url, "path")
    ends = F.lit(False)
    for e in SKIPPED:
        ends = ends | F.lower(path).endswith(e)
    return (url_part(url, "authority") == host) & path.startswith(prefix) & ~ends


def fetched(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """url, page_id, html, found: the page behind each URL, as a lookup; the last page of a URL counts."""
    last = pages.groupBy("url").agg(F.max_by(F.struct("page_id", "html"), "page_id").alias("p")).select("url", "p.page_id", "p.html")
    return urls.join(last, "url", "left").withColumn("found", F.col("page_id").isNotNull())


def file_name(url: Column) -> Column:
    """The name under which a page is saved: its path with underscores."""
    return F.concat(F.replace(F.regexp_replace(url_part(url, "path"), "^/+|/+$", ""), F.lit("/"), F.lit("_")), F.lit(".html"))


def saved_pages(pages: DataFrame) -> DataFrame:
    """name, page_id, n_pages, html: pages of one name overwrite each other in the order of their ids."""
    return pages.groupBy(file_name(F.col("url")).alias("name")).agg(F.max("page_id").alias("page_id"), F.count("*").alias("n_pages"), F.max_by("html", "page_id").alias("html"))


QUEUED = "url string, order struct<parent:bigint,pos:bigint>, depth int"


def crawl(
    seeds: DataFrame, edges: DataFrame, pages: DataFrame, admit: Column, *, max_depth: int = MAX_DEPTH, max_pages: int = MAX_PAGES, folder: str | None = None
) -> DataFrame:
    """url, depth, fetch_order of the pages a breadth-first search saves.

    seeds: url, pos. edges: url, pos, target. admit: a condition on ``url``, not asked of seeds. A URL is queued once,
    when first seen; one that isn't in ``pages`` fails, is not retried and doesn't count. Each level is one join, so
    the loop runs ``max_depth`` times at most.

    Each level's queue and saved pages are written below ``folder`` (new, unless given) before the next is made, so plans
    don't nest; a crawl that is called again with its folder goes on after the last whole level.
    """
    spark = seeds.sparkSession
    folder = folder or new_folder(spark, "crawl")
    best = Window.partitionBy("url").orderBy("order")
    first = lambda df: df.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    place = lambda parent, pos: F.struct(parent.cast("long").alias("parent"), pos.cast("long").alias("pos")).alias("order")

    def level(kind: str, depth: int, schema: str, make) -> DataFrame:
        path = f"{folder}/{kind}/depth={depth}"
        if not is_written(spark, path):
            make().write.mode("overwrite").parquet(path)
        return spark.read.schema(schema).parquet(path)

    queue = "url string, order struct<parent:bigint,pos:bigint>"
    frontier = level("queued", 0, queue, lambda: first(seeds.select("url", place(F.lit(0), F.col("pos")))))
    for depth in range(max_depth + 1):
        # The queue's order within a level: by the parent's place, then by the place of the link. The cut is made in each
        # task first; max_pages rows get to the window.
        there = lambda q=frontier: q.join(pages.select("url").distinct(), "url", "left_semi").orderBy("order").limit(max_pages).withColumn("place", F.row_number().over(Window.orderBy("order")))
        saved = level("saved", depth, f"{queue}, place int", there)
        if depth == max_depth or not saved.take(1):
            break
        seen = spark.read.schema(QUEUED).parquet(f"{folder}/queued").where(F.col("depth") <= depth).select("url")
        found = saved.join(edges, "url").select(F.col("target").alias("url"), place(F.col("place"), F.col("pos"))).where(admit)
        frontier = level("queued", depth + 1, queue, lambda found=found, seen=seen: first(found).join(seen, "url", "left_anti"))
    out = spark.read.schema(f"{queue}, place int, depth int").parquet(f"{folder}/saved")
    # At most max_pages rows of each level get here.
    return out.withColumn("fetch_order", F.row_number().over(Window.orderBy("depth", "place"))).where(F.col("fetch_order") <= max_pages).select("url", "depth", "fetch_order")
