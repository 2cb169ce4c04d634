"""URL filters with redirect equivalence.

Rules block or allow a host, with its subdomains, under a path; the longest that fits decides. Pages that redirect to
each other, or name each other as canonical, are one thing under several addresses: connected components over those
edges carry a block to every alias. A page that a rule allows stays allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

# The rules of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules up to which they are one expression; more are a table that is joined.
IN_PLAN = 200

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?\s*canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return common.lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def judged_by_rules(df: DataFrame, host: str, path: str, rules, into: tuple[str, str]) -> DataFrame:
    """Adds the rule (host and path) and its verdict; both null where none fits. Of rules of equal text the first counts."""
    best = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    if len(best) <= IN_PLAN:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for kind, rule_host, rule_path in reversed(best):
            fits = _fits(F.col(host), F.col(path), rule_host, rule_path)
            rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
            verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
        return df.withColumns({into[0]: rule, into[1]: verdict})
    # distinct host and path first, so that a frequent host isn't joined row by row; a host fits by each of its suffixes
    given = df.sparkSession.createDataFrame([(k, h, p, n) for n, (k, h, p) in enumerate(best)], "kind string, rule_host string, rule_path string, n int")
    given = F.broadcast(given) if sum(len(h) + len(p) for _, h, p in best) < common.BROADCAST_BYTES else given
    each = df.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = each.withColumn("suffix", F.explode(suffixes)).join(given, (F.col("suffix") == F.col("rule_host")) & F.col("p").startswith(F.col("rule_path")))
    won = met.groupBy("h", "p").agg(F.min(F.struct("n", F.concat("rule_host", "rule_path").alias("rule"), "kind")).alias("won"))
    out = df.join(won, (F.col(host) == F.col("h")) & (F.col(path) == F.col("p")), "left")
    return out.withColumns({into[0]: F.col("won.rule"), into[1]: F.col("won.kind")}).drop("h", "p", "won")


def node_of(url: Column) -> Column:
    """What a url addresses, in one spelling (RFC 3986): without a fragment, scheme and host in lower case, without the
    scheme's own port, dot segments resolved, a path of `/` where there is none. What has no :// stays but for the fragment."""
    whole = F.regexp_replace(url, "(?s)#.*$", "")
    root = common.lower_ascii(F.regexp_extract(whole, r"(?s)^([^/?#]*?://[^/?#]*)", 1))
    root = F.regexp_replace(root, r"(?s)^(http://.*):80$|^(https://.*):443$", "$1$2")
    path, query = F.regexp_extract(whole, _URL, 2), F.regexp_extract(whole, r"(?s)^[^?]*(\?.*)$", 1)
    dotted = path.rlike(r"/\.\.?(/|$)")
    step = lambda done, x: F.when(x == "..", F.regexp_replace(done, "(?s)/[^/]*$", "")).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x))
    parts = F.split(path, "/")
    plain = F.concat(F.aggregate(F.slice(parts, 2, F.size(parts)), F.lit(""), step), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    path = F.coalesce(F.nullif(F.when(dotted, plain).otherwise(path), F.lit("")), F.lit("/"))
    return F.when(root != "", F.concat(root, path, query)).otherwise(whole)


def _resolved(base: Column, link: Column) -> Column:
    """link as seen from the page base: absolute, without scheme, from the root, a query of the page, or beside the page."""
    scheme, root = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    whole = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*)", 1)
    beside = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*/|.*?://[^/?#]*)", 1)
    beside = F.when(beside.endswith("/"), beside).otherwise(F.concat(beside, F.lit("/")))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(whole, link)).otherwise(F.concat(beside, link))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """a, b: each page's address and those that its canonical links and its refreshes redirect to."""
    links = F.concat(*(F.regexp_extract_all(F.col(html_col), F.lit(p), 1) for p in (_CANONICAL, _REFRESH)))
    near = pages.where(F.col(html_col).rlike(r"(?i)canonical|http-equiv")).select(F.col(url_col).alias("u"), F.explode(links).alias("link"))
    link = F.replace("link", F.lit("&amp;"), F.lit("&"))
    return near.where("u LIKE '%://%'").select(node_of(F.col("u")).alias("a"), node_of(_resolved(F.col("u"), link)).alias("b")).where("a <> b").distinct()


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, alias (whether the verdict is a block that an alias has).

    redirects: more edges, two columns of urls. A null url, or one without ://, has no host, path or rule and is allowed,
    unless redirects name it. Repeated rows give repeated rows; empty tables give no rows; other columns aren't read."""
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col(redirects.columns[0])), node_of(F.col(redirects.columns[1]))))
    own = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), node_of(F.col(url_col)).alias("url"))
    own = judged_by_rules(own, "host", "path", rules, ("rule", "told"))
    groups = components(edges)
    known = judged_by_rules(groups.withColumns({"h": host_of(F.col("node")), "q": path_of(F.col("node"))}).withColumnsRenamed({"h": "host", "q": "path"}), "host", "path", rules, ("rule", "told"))
    bad = known.where("told = 'block'").select("component").distinct()
    reached = common.staged(groups.join(bad, "component", "left_semi").select(F.col("node").alias("reached")).distinct(), "reached")
    out = own.join(common.sized(reached), F.col("url") == F.col("reached"), "left")
    verdict = F.coalesce("told", F.when(F.col("reached").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), (F.col("told").isNull() & F.col("reached").isNotNull()).alias("alias"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))


# The rules of the query, its links and what blocks reach, as DuckDB has them.
def _sql_node(url: str) -> str:
    whole = f"regexp_replace({url}, '(?s)#.*$', '')"
    root = f"regexp_replace(lower(regexp_extract({whole}, '(?s)^([^/?#]*?://[^/?#]*)', 1)), '(?s)^(http://.*):80$|^(https://.*):443$', '\\1\\2')"
    path = f"regexp_extract({whole}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    parts = f"string_split({path}, '/')"
    plain = f"list_reduce(list_concat([''], {parts}[2:]), lambda a, x: CASE x WHEN '..' THEN regexp_replace(a, '(?s)/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || x END) || CASE WHEN {parts}[-1] IN ('.', '..') THEN '/' ELSE '' END"
    path = f"coalesce(nullif(CASE WHEN regexp_matches({path}, '/\\.\\.?(/|$)') THEN {plain} ELSE {path} END, ''), '/')"
    return f"CASE WHEN {root} <> '' THEN {root} || {path} || regexp_extract({whole}, '(?s)^[^?]*(\\?.*)$', 1) ELSE {whole} END"


ORACLE = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, {_sql_node('url')} AS node, html FROM pages),
l AS (SELECT url, unnest(list_concat(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?\s*canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1), list_concat(regexp_extract_all(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?\s*canonical\b', 1),
  regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?\s*refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS link FROM p WHERE url LIKE '%://%' AND regexp_matches(html, '(?i)canonical|http-equiv')),
r AS (SELECT url, replace(link, '&amp;', '&') AS link, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS root, regexp_extract(url, '(?s)^(.*?://[^?#]*)', 1) AS whole FROM l WHERE link <> ''),
t AS (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '/') THEN root || link WHEN starts_with(link, '?') THEN whole || link
  WHEN length(whole) > length(root) THEN regexp_replace(whole, '[^/]*$', '') || link ELSE root || '/' || link END AS link FROM r),
e AS (SELECT {_sql_node('url')} AS a, {_sql_node('link')} AS b FROM t),
way AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
n AS (SELECT node FROM p UNION SELECT a FROM way),
j AS (SELECT node, lower(regexp_extract(coalesce(node, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(node, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM n),
o AS (SELECT page_id, node, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
v AS (SELECT node, host, path, {{rule}} AS rule FROM j), w AS (SELECT page_id, node, host, path, {{rule}} AS rule FROM o),
x AS (SELECT node FROM v WHERE rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') AND node IN (SELECT a FROM way) UNION SELECT b FROM x JOIN way ON a = node)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN node IN (SELECT node FROM x) THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(rule IS NULL AND node IN (SELECT node FROM x), false) AS alias
FROM w
""".replace("{rule}", """CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END""")
