"""Crawling a captured link graph, breadth first, and choosing where a plan comes from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.operators.toc import first_seen, numbered
from notemill.session import staged

#: Levels of a crawl that are kept as tables of their own; more are put together.
LEVELS = 16


def bfs(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """edges: src, dst, pos (place of the link in its page); starts: node, seq. Gives node, depth, crawl (number in the
    order of a first-in first-out queue), from 0.

    One job a level: the frontier meets its links, what was seen goes, the first link to a page counts. Order within a
    level is that of the page that links and then of the link; only the frontier of a level is numbered at a time, by
    ranges, so no task holds it all. A level is written once, and again only with LEVELS others; the crawl ends where a
    level finds nothing new."""
    now = staged(first_seen(starts, ["node"], ["seq"]).select("node", F.lit(0).alias("depth"), F.col("seq").cast("long").alias("ord")), "crawl")
    seen, at = [now], 0
    whole = lambda: reduce(DataFrame.union, seen)
    while depth is None or at < depth:
        at += 1
        met = now.select(F.col("node").alias("src"), "ord").join(edges, "src").join(whole().select(F.col("node").alias("dst")), "dst", "left_anti")
        # of all links to a page the first counts: a minimum, which combines before its shuffle
        first = met.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("ord", "pos")).alias("k"))
        now = staged(numbered(first, "k").select("node", F.lit(at).alias("depth"), F.col("n").alias("ord")), "crawl")
        if now.isEmpty():
            break
        seen.append(now)
        if len(seen) > LEVELS:
            seen = [staged(whole(), "crawl")]
    return numbered(whole().withColumn("k", F.struct("depth", "ord")), "k").select("node", "depth", (F.col("n") - 1).alias("crawl"))


def plan_source(toc_pages: Column, sitemap_pages: Column, depth: Column) -> Column:
    """A published table of contents with a page, else a sitemap where no depth is asked for, else the links."""
    return F.when(toc_pages > 0, "toc").when((sitemap_pages > 0) & depth.isNull(), "sitemap").otherwise("crawl")
