"""Scans of files, listings and maps that a capture has left."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.functions import text as tx
from notemill.functions import urls
from notemill.operators.crawl import bfs
from notemill.operators.toc import first_seen
from notemill.session import staged

_SKIPPED_DIRS = r"(^|/)(\.|node_modules/|venv/|__pycache__/)"


def repo_files(files: DataFrame, include: str | None = None, assets: str | None = None, path: str = "path") -> DataFrame:
    """Notes (.md, .ipynb) outside hidden and installed folders, whose path has include; files whose name has assets. Adds asset."""
    p, name = F.col(path), F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    note = F.lower(name).rlike(r"\.(md|ipynb)$")
    if include:
        note = note & p.rlike(tx.rxi(include))
    asset = ~note & name.rlike(tx.rxi(assets)) if assets else F.lit(False)
    return files.where(~p.rlike(_SKIPPED_DIRS) & (note | asset)).withColumn("asset", asset)


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path (within the folder), content (bytes) of all files below it that hold any; Spark's reader passes over empty ones."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.escape(re.sub(r"^[a-z]+:/+", "/", folder).rstrip("/"))
    return found.select(F.regexp_replace("path", rf"^.*?{root}/", "").alias("path"), "content", "length")


@F.pandas_udf(T.ArrayType(T.StringType()))
def sitemap_locs(xml: pd.Series) -> pd.Series:
    """The text of all elements whose tag ends in `loc`; null for what isn't XML."""

    def one(x: str | None) -> list[str] | None:
        if x is None:
            return None
        try:
            return [e.text.strip() for e in ET.fromstring(x).iter() if isinstance(e.tag, str) and e.tag.endswith("loc") and e.text]
        except ET.ParseError:
            return None

    return pd.Series([one(x) for x in xml], dtype=object)


def sitemap_starts(robots: Column, url: Column) -> Column:
    """The addresses that a robots text gives as site maps, in order; the usual one of the address' host where it gives none."""
    lines = F.regexp_extract_all(F.coalesce(robots, F.lit("")), F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), 1)
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.concat(root, F.lit("/sitemap.xml"))))


def sitemap_pages(maps: DataFrame, start_maps: list[str], netloc: str, prefix: str, exclude: str | None = None, limit: int | None = 20000, most_maps: int | None = 50) -> DataFrame:
    """maps: url, xml, as captured. Gives m (number of the map), pos, url: pages in scope in the order of their maps, each once.

    Maps form a graph that is crawled from the first ones, in the order of a queue; those of other hosts aren't followed.
    Capture policy: most_maps are read, and none once the maps before it have given limit pages; None lifts either."""
    loc, is_map = F.col("loc"), F.col("loc").rlike(r"\.xml(\.gz)?$")
    each = staged(maps.select("url", F.posexplode(sitemap_locs(F.col("xml"))).alias("pos", "loc")), "sitemap")
    follow = each.where(is_map & (urls.netloc(loc) == netloc)).select(F.col("url").alias("src"), loc.alias("dst"), "pos")
    starts = maps.sparkSession.createDataFrame(list(enumerate(start_maps)), "seq long, node string")
    order = bfs(follow, starts).select(F.col("node").alias("url"), (F.col("crawl") + 1).alias("m"))
    if most_maps is not None:
        order = order.where(F.col("m") <= most_maps)
    link = urls.normalize(loc)
    pages = staged(each.where(~is_map & urls.in_scope(link, prefix, exclude)).join(order, "url").select("m", "pos", link.alias("url")), "listed")
    if limit is not None:
        # a row a map that gives pages
        given = pages.groupBy(F.col("m").alias("k")).count().withColumn("before", F.sum("count").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)))
        pages = pages.join(given, F.col("m") == F.col("k")).where(F.coalesce("before", F.lit(0)) < limit).select("m", "pos", "url")
    return first_seen(pages, ["url"], ["m", "pos"])


def paged(pages: DataFrame, first: str) -> DataFrame:
    """pages: url, next_page, items (array). Gives page (number), pos, item, following next_page from first.

    Steps are doubled: a round joins what is numbered with where its pages lead after 2, 4, 8 ... steps, so n pages take
    log2(n) rounds; a listing that leads back to itself ends there. Of pages with one address the first by next_page counts."""
    own = pages.groupBy(F.col("url").alias("at")).agg(F.min("next_page").alias("to"))
    there = own.select(F.col("at").alias("to"))
    jump, span = staged(own.join(there, "to", "left_semi").select("at", "to"), "jump"), 1
    known = staged(own.where(F.col("at") == first).select("at", F.lit(0).cast("long").alias("page")), "numbered")
    while not jump.isEmpty():
        more = known.join(jump, "at").select(F.col("to").alias("at"), (F.col("page") + span).alias("page"))
        now = staged(known.union(more).groupBy("at").agg(F.min("page").alias("page")), "numbered")
        if now.count() == known.count():
            break
        known = now
        jump, span = staged(jump.join(jump.select(F.col("at").alias("to"), F.col("to").alias("then")), "to").select("at", F.col("then").alias("to")), "jump"), span * 2
    return pages.join(known, F.col("url") == F.col("at")).select("page", F.posexplode("items").alias("pos", "item"))


def toc_addresses(url: Column, html_meta: Column) -> Column:
    """Where a site publishes its table of contents: what its meta tag says, and a known name on one host. Nulls left out."""
    known = F.when(urls.host(url) == "docs.aws.amazon.com", F.concat(urls.default_prefix(url), F.lit("toc-contents.json")))
    return F.array_compact(F.array(F.when(html_meta.isNotNull(), urls.join(url, html_meta)), known))


def deliverables(meta: DataFrame, content: DataFrame) -> DataFrame:
    """meta: id, status, product_url, deliverable_product, product_name, deliverable_url, asked, version, asked_version; content: id,
    title, version. Gives id, title, product, path, version by their chains of fallbacks; empty strings count as none."""
    or_none = lambda c: F.nullif(c, F.lit(""))
    c = content.select("id", F.col("title").alias("c_title"), F.col("version").alias("c_version"))
    met = meta.where("status = 'OK'").join(c, "id")
    title = F.coalesce(or_none(F.col("c_title")), or_none(F.col("product_name")), F.col("asked"))
    product = F.coalesce(or_none(F.col("product_url")), or_none(F.col("deliverable_product")), F.col("asked_product"))
    version = F.coalesce(or_none(F.col("c_version")), or_none(F.col("version")), F.col("asked_version"))
    return met.select("id", title.alias("title"), product.alias("product"), F.concat(product, F.lit("/"), F.coalesce(or_none(F.col("deliverable_url")), F.col("asked"))).alias("path"), version.alias("version"))


#: First bytes of pictures.
MAGIC = (b"\x89PNG", b"\xff\xd8\xff\xe0", b"\xff\xd8\xff\xe1", b"GIF8", b"RIFF", b"<svg", b"<?xm")


def is_image(data: Column) -> Column:
    return (F.octet_length(data) >= 100) & F.substring(data, 1, 4).isin(*(F.lit(m) for m in MAGIC))
