"""What the query modules share: tables, and pieces of SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AT = "2026-01-02T03:04:05+00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_slug(x: str, limit: int = 70) -> str:
    s = f"regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    cut = f"CASE WHEN length({s}) <= {limit} THEN {s} WHEN contains(substr(substr({s}, 1, {limit + 1}), {limit // 2 + 1}), '-') THEN regexp_replace(substr({s}, 1, {limit + 1}), '-[^-]*$', '') ELSE substr({s}, 1, {limit}) END"
    return f"coalesce(nullif(regexp_replace({cut}, '-+$', ''), ''), 'sem-titulo')"


def sql_normal(url: str) -> str:
    return f"regexp_replace({url}, '(?s)[?#].*$', '')"


def sql_netloc(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def sql_host(url: str) -> str:
    return f"lower(regexp_replace(regexp_replace({sql_netloc(url)}, '^.*@', ''), ':[0-9]*$', ''))"


def sql_path(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def sql_query(url: str) -> str:
    return f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


H1 = "trim(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1))"
TITLE = "trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1))"


def sql_text(x: str) -> str:
    """Text of markup: no tags, the entities that the pages have, white space collapsed."""
    bare = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for a, b in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = f"replace({bare}, '{a}', '{b}')"
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'))"
