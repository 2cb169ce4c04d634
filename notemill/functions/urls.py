"""Column functions on URLs. Parts are cut by patterns, as parse_url() gives null for hosts outside ASCII."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import rxi

# Endings of files that aren't pages.
SKIPPED = "png|jpe?g|gif|svg|webp|ico|pdf|zip|gz|tgz|ipynb|py|json|xml|txt|csv|mp4|css|js"
_LOGIN = "login|signin|sign-in|sso|saml|oauth|auth|idp|accounts"


def normalize(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)[?#].*$", "")


def default_prefix(url: Column) -> Column:
    """The folder of a start page; `scheme://` for an address without a path, which holds every page of the scheme."""
    clean = normalize(url)
    return F.when(clean.endswith("/"), clean).otherwise(F.concat(F.regexp_replace(clean, r"(?s)/[^/]*$", ""), F.lit("/")))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower case, without port and user."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":[0-9]*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def in_scope(url: Column, prefix: str, exclude: str | None = None) -> Column:
    """Begins with the prefix, is no file, and exclude isn't found in it."""
    inside = url.startswith(prefix) & ~path(url).rlike(rxi(rf"\.({SKIPPED})$"))
    return inside & ~url.rlike(rxi(exclude)) if exclude else inside


def join_from_root(base: Column, link: Column) -> Column:
    """The join of a link that begins with one slash: no UDF is needed."""
    return F.concat(scheme(base), F.lit("://"), netloc(base), link)


@F.pandas_udf(T.StringType())
def join(base: pd.Series, link: pd.Series) -> pd.Series:
    """Any link, by RFC 3986."""
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(base, link)], dtype=object)


def markdown_url(url: Column, template: str) -> Column:
    return F.replace(F.lit(template), F.lit("{url}"), F.regexp_replace(url, "/+$", ""))


def command_for(url: Column) -> Column:
    """Which command takes an address; the first rule that fits."""
    has = url.contains
    return (
        F.when(has("://help.sap.com/docs/") | has("://help.sap.com/viewer/"), "help")
        .when(has("://github.com/"), "repo")
        .when(F.lower(path(url)).endswith(".pdf"), "pdf")
        .when(has("://learn.microsoft.com/") | has("://learning.sap.com/live-sessions/"), "page")
        .otherwise("extract")
    )


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def course_name(title: Column, url: Column) -> Column:
    """The title, or the last part of the path, the host, a fixed name."""
    last = F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (title, last, host(url))), F.lit("curso"))


def parent_name(crumbs: Column, url: Column) -> Column:
    """The last crumb but one, or that part of the path as words; null where there is neither."""
    s = segments(url)
    return F.coalesce(F.when(F.size(crumbs) >= 2, F.try_element_at(crumbs, F.lit(-2))), F.when(F.size(s) >= 2, F.replace(F.try_element_at(s, F.lit(-2)), F.lit("-"), F.lit(" "))))


def login_redirect(asked: Column, landed: Column) -> Column:
    return (host(asked) != host(landed)) & F.concat(host(landed), path(landed)).rlike(rxi(_LOGIN))


def unquote(col: Column) -> Column:
    """Percent-decoding that leaves plus signs alone."""
    return F.url_decode(F.replace(col, F.lit("+"), F.lit("%2B")))


def _param(url: Column, name: str, default: str) -> Column:
    found = F.regexp_extract(query(url), rf"(?:^|&){name}=([^&]+)", 1)
    return F.when(found != "", F.url_decode(found)).otherwise(default)


def help_parts(url: Column) -> Column:
    """struct(product, deliverable, topic, version, locale) of a help-portal address, or null if it isn't one.

    /docs/<product>/<deliverable>[/<topic>], /docs/r/<id>/<version>/<locale>/<topic> and /viewer/..., which means the same."""
    s = F.transform(segments(url), unquote)
    s = F.when((F.element_at(F.concat(s, F.array(F.lit(""))), 1) == "viewer") & (F.size(s) >= 5), F.concat(F.array(F.lit("docs"), F.lit("r")), F.slice(s, 2, 1000))).otherwise(s)
    at = lambda k: F.try_element_at(s, F.lit(k))
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\.html$", "")
    raw = (at(2) == "r") & (F.size(s) >= 6)
    out = F.struct(
        at(2).alias("product"),
        at(3).alias("deliverable"),
        F.when(raw, bare(at(6))).otherwise(bare(at(4))).alias("topic"),
        F.when(raw, at(4)).otherwise(_param(url, "version", "LATEST")).alias("version"),
        F.when(raw, at(5)).otherwise(_param(url, "locale", "en-US")).alias("locale"),
    )
    return F.when((host(url) == "help.sap.com") & (F.size(s) >= 3) & (at(1) == "docs"), out)


def blob_url(repo: Column, branch: Column, file: Column) -> Column:
    return F.concat(F.regexp_replace(repo, "/+$", ""), F.lit("/blob/"), branch, F.lit("/"), file)
