"""Queries on hierarchies, crawls and robots rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notemill.functions import html, urls
from notemill.functions import text as tx
from notemill.operators import crawl, robots, scoring, toc
from notemill.sources import files

from .common import H1, sql_host, sql_normal, sql_path, sql_query, sql_slug, table
from .url_queries import headings

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def dotted(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ".")


# --- numbering of addresses

_PARTS = f"""u AS (SELECT page_id AS seq, {sql_normal('url')} AS url, {H1} AS h1 FROM pages),
 p AS (SELECT seq, h1, string_split(CASE WHEN r = '' THEN 'index' ELSE r END, '/') AS parts FROM (SELECT *, regexp_replace(regexp_replace(url, '^https?:', ''), '^/+|/+$', '', 'g') AS r FROM u)),
 l AS (SELECT seq, unnest(range(1, len(parts) + 1)) AS d, parts FROM p),
 f AS (SELECT array_to_string(parts[1:d - 1], '/') AS parent, parts[d] AS part, d, min(seq) AS first FROM l GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY d, parent ORDER BY first, part) AS n FROM f),
 x AS (SELECT l.seq, l.d, k.n, CASE WHEN regexp_replace(k.part, '\\.(html?|aspx|md)$', '') = '' THEN 'index' ELSE regexp_replace(k.part, '\\.(html?|aspx|md)$', '') END AS name, l.d = len(l.parts) AS leaf
       FROM l JOIN k ON k.d = l.d AND k.parent = array_to_string(l.parts[1:l.d - 1], '/') AND k.part = l.parts[l.d])"""


def numbered_pages(spark, d):
    pages = headings(spark, d).select(F.col("page_id").alias("seq"), "h1", F.regexp_replace(urls.normalize(F.col("url")), "^https?:", "").alias("url"))
    return toc.url_tree(pages, F.lit(""), title="h1")


@query(f"WITH {_PARTS} SELECT x.seq, string_agg(CAST(n AS VARCHAR), '.' ORDER BY d) AS positions, string_agg(CASE WHEN leaf THEN h1 ELSE name END, ' › ' ORDER BY d) AS path FROM x JOIN p ON x.seq = p.seq GROUP BY x.seq")
def url_tree_numbering(spark, d):
    return numbered_pages(spark, d).select("seq", dotted("positions").alias("positions"), tx.path_text("titles").alias("path"))


@query(f"WITH {_PARTS} SELECT x.seq, string_agg(printf('%02d', n) || '-' || {sql_slug('CASE WHEN leaf THEN h1 ELSE name END', 60)}, '/' ORDER BY d) || '.md' AS file FROM x JOIN p ON x.seq = p.seq GROUP BY x.seq")
def output_paths(spark, d):
    return numbered_pages(spark, d).select("seq", toc.output_path(F.col("titles"), F.col("positions")).alias("file"))


# --- tables of contents: region, nation, customer


def world(spark, d):
    """titles, positions, file: three levels, numbered in key order."""
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    r = r.withColumn("rn", F.row_number().over(Window.orderBy("r_regionkey")).cast("int"))  # five rows
    n = n.withColumn("nn", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).cast("int"))
    c = c.withColumn("cn", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("int"))
    rn = r.join(n, r.r_regionkey == n.n_regionkey)
    rnc = rn.join(c, rn.n_nationkey == c.c_nationkey)
    one = r.select(F.array("r_name").alias("titles"), F.array("rn").alias("positions"), F.concat(F.lit("r"), "r_regionkey").alias("file"))
    two = rn.select(F.array("r_name", "n_name"), F.array("rn", "nn"), F.concat(F.lit("n"), "n_nationkey"))
    return one.union(two).union(rnc.select(F.array("r_name", "n_name", "c_name"), F.array("rn", "nn", "cn"), F.concat(F.lit("c"), "c_custkey")))


_WORLD = """r AS (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS rn FROM region),
 n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nn FROM nation),
 c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS cn FROM customer),
 w AS (SELECT r_name AS path, CAST(rn AS VARCHAR) AS positions, [rn] AS p, 'r' || r_regionkey AS file, r_name AS last FROM r
  UNION ALL SELECT r_name || ' › ' || n_name, rn || '.' || nn, [rn, nn], 'n' || n_nationkey, n_name FROM r JOIN n ON r_regionkey = n_regionkey
  UNION ALL SELECT r_name || ' › ' || n_name || ' › ' || c_name, rn || '.' || nn || '.' || cn, [rn, nn, cn], 'c' || c_custkey, c_name FROM r JOIN n ON r_regionkey = n_regionkey JOIN c ON n_nationkey = c_nationkey)"""


@query(f"WITH {_WORLD} SELECT path, positions, file, EXISTS (SELECT 1 FROM w v WHERE len(v.p) = len(w.p) + 1 AND v.p[1:len(w.p)] = w.p) AS has_children FROM w")
def toc_tree(spark, d):
    return toc.with_children(world(spark, d)).select(tx.path_text("titles").alias("path"), dotted("positions").alias("positions"), "file", "has_children")


_KEEP = "(file LIKE 'c%' AND CAST(substr(file, 2) AS BIGINT) % 7 = 0) OR (file LIKE 'n%' AND CAST(substr(file, 2) AS BIGINT) % 5 = 0)"


@query(f"""WITH {_WORLD}, k AS (SELECT * FROM w WHERE EXISTS (SELECT 1 FROM w v WHERE ({_KEEP.replace('file', 'v.file')}) AND v.p[1:len(w.p)] = w.p)),
 m AS (SELECT path, file, p, row_number() OVER (PARTITION BY p[1:len(p) - 1] ORDER BY p) AS n FROM k)
 SELECT a.path, a.file, string_agg(CAST(b.n AS VARCHAR), '.' ORDER BY len(b.p)) AS positions FROM m a JOIN m b ON a.p[1:len(b.p)] = b.p GROUP BY a.path, a.file""")
def toc_prune(spark, d):
    kept = toc.renumber(toc.prune(world(spark, d), F.expr(_KEEP)))
    return kept.select(tx.path_text("titles").alias("path"), "file", dotted("positions").alias("positions"))


def _nested(spark, d, node, below):
    """One JSON text of regions, nations and customers. node: from key and name columns, a node's own fields; below: the key of its children."""
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))

    def under(rows, by, key, columns):
        return rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.struct(*columns).alias("node")))), lambda x: x["node"]).alias("_below"))

    leaves = under(c, "c_nationkey", "c_custkey", node("c", "c_custkey", "c_name"))
    n = n.join(leaves, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    inner = under(n, "n_regionkey", "n_nationkey", [*node("n", "n_nationkey", "n_name"), F.col("_below").alias(below[1])])
    r = r.join(inner, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    whole = under(r.withColumn("one", F.lit(1)), "one", "r_regionkey", [*node("r", "r_regionkey", "r_name"), F.col("_below").alias(below[0])])
    return whole.select(F.lit(1).alias("toc_id"), F.to_json(F.struct(F.col("_below").alias(below[2]))).alias("body"))


@query(f"""WITH {_WORLD}, k AS (SELECT * FROM w WHERE EXISTS (SELECT 1 FROM w v WHERE ({_KEEP.replace('file', 'v.file')}) AND v.p[1:len(w.p)] = w.p)),
 m AS (SELECT path, file, p, row_number() OVER (PARTITION BY p[1:len(p) - 1] ORDER BY p) AS n FROM k)
 SELECT a.path, CASE WHEN {_KEEP.replace('file', 'a.file')} THEN 'https://x.org/guide/' || a.file || '.html' ELSE '' END AS url, string_agg(CAST(b.n AS VARCHAR), '.' ORDER BY len(b.p)) AS positions, bool_or(EXISTS (SELECT 1 FROM m x WHERE len(x.p) = len(a.p) + 1 AND x.p[1:len(a.p)] = a.p)) AS has_children
 FROM m a JOIN m b ON a.p[1:len(b.p)] = b.p GROUP BY a.path, a.file""")
def json_toc(spark, d):
    """A published table of contents with several names of keys; pages of another site keep their title only."""
    def node(kind, key, name):
        file = F.concat(F.lit(kind), F.col(key).cast("string"))
        page = F.expr(_KEEP.replace("file", f"concat('{kind}', {key})"))
        return [F.col(name).alias({"r": "name", "n": "title", "c": "toc_title"}[kind]), F.when(page, F.concat(file, F.lit(".html"))).when(F.lit(kind == "c"), F.concat(F.lit("https://other.org/"), file)).alias("href")]

    toc_text = _nested(spark, d, node, ("contents", "items", "children")).withColumn("base", F.lit("https://x.org/guide/toc.json"))
    return toc.json_toc(toc_text, "https://x.org/guide/").select(tx.path_text("titles").alias("path"), "url", dotted("positions").alias("positions"), "has_children")


@query(f"""WITH {_WORLD} SELECT path, positions, CASE WHEN right(file, 1) = '3' THEN '' ELSE file END AS file, EXISTS (SELECT 1 FROM w v WHERE len(v.p) = len(w.p) + 1 AND v.p[1:len(w.p)] = w.p) AS has_children FROM w""")
def help_toc(spark, d):
    """A portal's table of contents; nodes without a file are numbered too."""
    def node(kind, key, name):
        file = F.concat(F.lit(kind), F.col(key).cast("string"))
        return [F.col(name).alias("t"), F.when(~file.endswith("3"), file).alias("u")]

    return toc.help_toc(_nested(spark, d, node, ("c", "c", "c"))).select(tx.path_text("titles").alias("path"), dotted("positions").alias("positions"), "file", "has_children")


@query(f"WITH {_WORLD} SELECT path, positions, file FROM w WHERE p[1] = (SELECT p[1] FROM w WHERE file = 'n3') AND p[2] = (SELECT p[2] FROM w WHERE file = 'n3')")
def subtree(spark, d):
    return toc.subtree(world(spark, d), "n3").select(tx.path_text("titles").alias("path"), dotted("positions").alias("positions"), "file")


@query(f"""WITH {_WORLD}, t AS (SELECT file, path, positions, last, CASE WHEN right(file, 1) IN ('1', '4') THEN '' ELSE file END AS page, CASE WHEN right(file, 1) = '2' THEN '   ' ELSE 'text' END AS body FROM w)
 SELECT file, path, positions, CASE WHEN trim(body) = '' THEN 'error' ELSE 'ok' END AS status FROM t WHERE page <> '' AND (regexp_matches(lower(path), 'a') OR file LIKE 'n%')""")
def title_only_rows(spark, d):
    w = world(spark, d).select("file", tx.path_text("titles").alias("path"), dotted("positions").alias("positions"))
    page = F.when(F.substring("file", -1, 1).isin("1", "4"), "").otherwise(F.col("file"))
    body = F.when(F.substring("file", -1, 1) == "2", "   ").otherwise("text")
    kept = w.where((page != "") & (F.col("path").rlike(tx.rxi("a")) | F.col("file").rlike("^n")))
    return kept.select("file", "path", "positions", F.when(tx.strip(body) == "", "error").otherwise("ok").alias("status"))


@query("""WITH t AS (SELECT p_type AS ty, min(p_partkey) AS s FROM part GROUP BY 1), b AS (SELECT p_type AS ty, p_brand AS br, min(p_partkey) AS s FROM part GROUP BY 1, 2),
 tn AS (SELECT *, row_number() OVER (ORDER BY s) AS n FROM t), bn AS (SELECT *, row_number() OVER (PARTITION BY ty ORDER BY s) AS n FROM b), pn AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS n FROM part)
 SELECT 't' || ty AS id, ty AS path, CAST(n AS VARCHAR) AS positions, true AS is_group FROM tn
 UNION ALL SELECT 'b' || bn.ty || br, bn.ty || ' › ' || br, tn.n || '.' || bn.n, true FROM bn JOIN tn ON bn.ty = tn.ty
 UNION ALL SELECT 'p' || p_partkey, p_type || ' › ' || p_brand || ' › ' || p_name, tn.n || '.' || bn.n || '.' || pn.n, false FROM pn JOIN tn ON p_type = tn.ty JOIN bn ON p_type = bn.ty AND p_brand = br""")
def menu_paths(spark, d):
    return toc.menu_paths(_menu(spark, d)).select("id", tx.path_text("path").alias("path"), dotted("positions").alias("positions"), "is_group")


def _menu(spark, d):
    """Types, brands and parts as a menu's entries."""
    part = table(spark, d, "part")
    tid, bid = F.concat(F.lit("t"), "p_type"), F.concat(F.lit("b"), "p_type", "p_brand")
    nav = part.groupBy("p_type").agg(F.min("p_partkey").alias("seq")).select(tid.alias("id"), F.lit(None).cast("string").alias("parent"), "seq", F.col("p_type").alias("title"))
    nav = nav.union(part.groupBy("p_type", "p_brand").agg(F.min("p_partkey").alias("seq")).select(bid, tid, "seq", "p_brand"))
    return nav.union(part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), bid, "p_partkey", "p_name"))


@query(f"""WITH t AS (SELECT p_type AS ty, min(p_partkey) AS s FROM part GROUP BY 1), b AS (SELECT p_type AS ty, p_brand AS br, min(p_partkey) AS s FROM part GROUP BY 1, 2),
 tn AS (SELECT *, row_number() OVER (ORDER BY s) AS n FROM t), bn AS (SELECT *, row_number() OVER (PARTITION BY ty ORDER BY s) AS n FROM b), pn AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 6 <> 5),
 x AS (SELECT 't' || ty AS id, [n, 0, 0] AS p, printf('%02d', n) || '-' || {sql_slug('ty', 60)} || '/00-' || {sql_slug('ty', 60)} || '.md' AS file FROM tn
 UNION ALL SELECT 'b' || bn.ty || br, [tn.n, bn.n, 0], printf('%02d', tn.n) || '-' || {sql_slug('bn.ty', 60)} || '/' || printf('%02d', bn.n) || '-' || {sql_slug('br', 60)} || CASE WHEN EXISTS (SELECT 1 FROM pn WHERE p_type = bn.ty AND p_brand = br) THEN '/00-' || {sql_slug('br', 60)} ELSE '' END || '.md' FROM bn JOIN tn ON bn.ty = tn.ty
 UNION ALL SELECT 'p' || p_partkey, [tn.n, bn.n, pn.n], printf('%02d', tn.n) || '-' || {sql_slug('p_type', 60)} || '/' || printf('%02d', bn.n) || '-' || {sql_slug('p_brand', 60)} || '/' || printf('%02d', pn.n) || '-' || {sql_slug('p_name', 60)} || '.md' FROM pn JOIN tn ON p_type = tn.ty JOIN bn ON p_type = bn.ty AND p_brand = br)
 SELECT id, row_number() OVER (ORDER BY p) - 1 AS at, file FROM x""")
def menu_visits(spark, d):
    """The menu's entries as they are visited; every sixth part is an anchor within a page."""
    return toc.menu_entries(_menu(spark, d).withColumn("anchor", F.col("id").startswith("p") & (F.col("seq") % 6 == 5)), "anchor").select("id", "at", "file")


@query("""WITH i AS (SELECT p_partkey, p_size AS scope, CASE WHEN p_partkey % 11 = 0 THEN 'Next' WHEN p_partkey % 13 = 0 THEN 'x' WHEN p_partkey % 17 = 0 THEN repeat('ab', 71) ELSE p_name || ' ' || (p_partkey % 3) END AS title FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0)
 SELECT scope, min(p_partkey) AS p_partkey, title FROM i WHERE length(title) BETWEEN 2 AND 140 AND title <> 'Next' GROUP BY scope, title""")
def menu_item_filter(spark, d):
    """Hidden ones, wrappers, controls, titles too short or too long and repeated titles are no entries."""
    k = F.col("p_partkey")
    title = F.when(k % 11 == 0, "Next").when(k % 13 == 0, "x").when(k % 17 == 0, "ab" * 71).otherwise(F.concat("p_name", F.lit(" "), (k % 3).cast("string")))
    items = table(spark, d, "part").select(F.col("p_size").alias("scope"), k.alias("seq"), title.alias("title"), (k % 5 != 0).alias("visible"), (k % 7 == 0).alias("wrapper"))
    return scoring.menu_items(items, html.NOISE_TEXTS).select("scope", F.col("seq").alias("p_partkey"), "title")


_EDGES = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, n_nationkey AS pos FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, s_suppkey FROM supplier
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, -1 FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || (s_suppkey % 25), 0 FROM supplier)"""


@query(f"""WITH RECURSIVE {_EDGES}, n0 AS (SELECT 'r1' AS node), l1 AS (SELECT dst AS node, min(pos) AS pos FROM e WHERE src = 'r1' AND dst <> 'r1' GROUP BY dst),
 o1 AS (SELECT node, row_number() OVER (ORDER BY pos) AS o FROM l1), l2 AS (SELECT dst AS node, min(o * 1000000 + pos + 1) AS k FROM e JOIN o1 ON e.src = o1.node WHERE dst <> 'r1' AND dst NOT IN (SELECT node FROM o1) GROUP BY dst)
 SELECT 'r1' AS node, 0 AS depth, 0::BIGINT AS crawl UNION ALL SELECT node, 1, o FROM o1 UNION ALL SELECT node, 2, (SELECT count(*) FROM o1) + row_number() OVER (ORDER BY k) FROM l2""")
def bfs_crawl(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    edges = n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"), F.col("n_nationkey").cast("long").alias("pos"))
    edges = edges.union(s.select(name("n", "s_nationkey"), name("s", "s_suppkey"), F.col("s_suppkey")))
    edges = edges.union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey"), F.lit(-1).cast("long")))
    edges = edges.union(s.select(name("s", "s_suppkey"), F.concat(F.lit("n"), (F.col("s_suppkey") % 25).cast("string")), F.lit(0).cast("long")))
    return crawl.bfs(edges, spark.createDataFrame([("r1", 0)], "node string, seq long"), depth=2)


# --- robots

_TEXTS = (
    ("com", "User-agent: *\nDisallow: /en/1\nAllow: /en/12\nCrawl-delay: 5\n\nUser-agent: other\nDisallow: /"),
    ("net", "# all\nUser-Agent: notemill\nUser-agent: x\nDisallow: /*?page=\nDisallow: /fr/*.html$\ncrawl-delay: 2.5\nCrawl-delay: x\n\nUser-agent: *\nDisallow: /"),
    ("org", "Disallow: /lost\nUser-agent: *\nDisallow:\nAllow: /es/\nDisallow: /es/\nDisallow: /de # comment"),
)


def rules_of(spark):
    return robots.parse(spark.createDataFrame(_TEXTS, "host string, text string"))


_RULES = """(VALUES ('com', false, '/en/1', '^/en/1'), ('com', true, '/en/12', '^/en/12'), ('net', false, '/*?page=', '^/.*\\?page='), ('net', false, '/fr/*.html$', '^/fr/.*\\.html$'),
 ('org', true, '/es/', '^/es/'), ('org', false, '/es/', '^/es/'), ('org', false, '/de', '^/de')) AS r(host, allow, pattern, regex)"""


@query(f"SELECT host, CASE WHEN allow THEN 'allow' ELSE 'disallow' END AS kind, pattern, '(?s)' || regex AS regex, -1.0::DOUBLE AS crawl_delay FROM {_RULES} UNION ALL SELECT * FROM (VALUES ('com', 'delay', '', '', 5.0::DOUBLE), ('net', 'delay', '', '', 2.5::DOUBLE), ('org', 'delay', '', '', 0.0::DOUBLE)) AS d(a, b, c, e, f)")
def robots_parse(spark, d):
    kind = F.when(F.col("pattern").isNull(), "delay").when(F.col("allow"), "allow").otherwise("disallow")
    return rules_of(spark).select("host", kind.alias("kind"), F.coalesce("pattern", F.lit("")).alias("pattern"), F.coalesce("regex", F.lit("")).alias("regex"), F.coalesce("crawl_delay", F.lit(-1.0)).alias("crawl_delay"))


def evaluated(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url").withColumn("host", F.element_at(F.split(urls.host(F.col("url")), r"\."), -1))
    return robots.evaluate(pages, rules_of(spark))


_EVAL = f"""t AS (SELECT page_id, url, string_split({sql_host('url')}, '.')[-1] AS host, CASE WHEN {sql_path('url')} = '' THEN '/' ELSE {sql_path('url')} END || CASE WHEN {sql_query('url')} <> '' THEN '?' || {sql_query('url')} ELSE '' END AS target FROM pages),
 v AS (SELECT page_id, allow, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, allow DESC) AS n FROM t JOIN {_RULES} ON t.host = r.host AND regexp_matches(t.target, r.regex)),
 a AS (SELECT t.page_id, t.url, t.host, coalesce(v.allow, true) AS allowed FROM t LEFT JOIN v ON t.page_id = v.page_id AND v.n = 1)"""


@query(f"WITH {_EVAL} SELECT page_id, allowed FROM a")
def robots_eval(spark, d):
    return evaluated(spark, d).select("page_id", "allowed")


@query(f"WITH {_EVAL} SELECT page_id FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://localhost/x' ELSE url END AS url, CASE WHEN page_id % 3 = 0 AND host <> 'com' THEN true ELSE allowed END AS allowed FROM a) WHERE allowed OR {sql_host('url')} = 'localhost' OR {sql_host('url')} LIKE 'www.%'")
def robots_gate(spark, d):
    """A third of the hosts answer with an error or a page in place of rules, a quarter of the pages are local, www hosts are authorized."""
    seen = evaluated(spark, d)
    usable = robots.usable_text(F.when((F.col("page_id") % 3 == 0) & (F.col("host") == "org"), 503).otherwise(200), F.when((F.col("page_id") % 3 == 0) & (F.col("host") == "net"), " <!DOCTYPE html>").otherwise("User-agent: *"))
    seen = seen.withColumn("allowed", F.when(usable == "", True).otherwise(F.col("allowed"))).withColumn("url", F.when(F.col("page_id") % 4 == 0, "http://localhost/x").otherwise(F.col("url")))
    return robots.gate(seen, urls.host(F.col("url")).like("www.%")).select("page_id")


@query(f"""SELECT page_id, greatest(CASE WHEN page_id % 2 = 0 THEN 1.0 + (page_id % 100) / 100.0 * 2.0 ELSE 1.5 + (page_id % 100) / 100.0 * 2.5 END, CASE string_split({sql_host('url')}, '.')[-1] WHEN 'com' THEN 5.0 WHEN 'net' THEN 2.5 ELSE 0.0 END)::DOUBLE AS wait FROM pages""")
def crawl_delay_floor(spark, d):
    delays = rules_of(spark).where("pattern IS NULL").select("host", F.col("crawl_delay").alias("floor"))
    pages = table(spark, d, "pages").select("page_id", F.element_at(F.split(urls.host(F.col("url")), r"\."), -1).alias("host")).join(F.broadcast(delays), "host")
    delay = F.when(F.col("page_id") % 2 == 0, 2.0)
    return pages.select("page_id", robots.wait(F.lit(1.5), F.lit(4.0), (F.col("page_id") % 100) / 100.0, delay, F.col("floor")).alias("wait"))


# --- categories, sections, articles


@query(f"""WITH s AS (SELECT r_regionkey AS cat, r_name, n_nationkey AS sec, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE regexp_matches(lower(n_name), '[aeio]')),
 c AS (SELECT cat, row_number() OVER (ORDER BY min(sec)) AS cn FROM s GROUP BY cat), n AS (SELECT *, row_number() OVER (ORDER BY sec) AS sn FROM s),
 a AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_suppkey * 7) % 10, s_suppkey) AS an FROM supplier)
 SELECT s_suppkey, printf('%02d', cn) || '-' || {sql_slug('r_name', 60)} || '/' || printf('%02d', sn) || '-' || {sql_slug('n_name', 60)} || '/' || printf('%02d', an) || '-' || {sql_slug('s_name', 60)} || '.md' AS file FROM a JOIN n ON s_nationkey = sec JOIN c ON n.cat = c.cat""")
def zendesk_tree(spark, d):
    """Regions as categories, nations as sections, suppliers as articles; categories by first appearance, sections through all chosen."""
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    sec = n.where(F.col("n_name").rlike(tx.rxi("[aeio]"))).join(r, n.n_regionkey == r.r_regionkey, "left").withColumn("r_name", F.coalesce("r_name", F.lit("geral")))
    cats = toc.numbered(sec.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k")), "k").select("n_regionkey", F.col("n").cast("int").alias("cn"))
    sec = toc.numbered(sec, "n_nationkey").withColumn("sn", F.col("n").cast("int")).drop("n").join(cats, "n_regionkey")
    art = s.withColumn("an", F.row_number().over(Window.partitionBy("s_nationkey").orderBy((F.col("s_suppkey") * 7) % 10, "s_suppkey")).cast("int"))
    met = art.join(sec, art.s_nationkey == sec.n_nationkey)
    return met.select("s_suppkey", toc.output_path(F.array("r_name", "n_name", "s_name"), F.array("cn", "sn", "an")).alias("file"))


@query("SELECT s_suppkey, s_suppkey // 10 - (SELECT min(s_suppkey // 10) FROM supplier) AS page FROM supplier")
def paged_listing(spark, d):
    s = table(spark, d, "supplier").withColumn("p", F.floor(F.col("s_suppkey") / 10))
    pages = s.groupBy("p").agg(F.sort_array(F.collect_list("s_suppkey")).alias("items"))
    last = pages.agg(F.max("p")).first()[0]
    first = pages.agg(F.min("p")).first()[0]
    url = lambda c: F.concat(F.lit("https://x.org/api?page="), c.cast("string"))
    pages = pages.select(url(F.col("p")).alias("url"), F.when(F.col("p") < last, url(F.col("p") + 1)).alias("next_page"), "items")
    return files.paged(pages, f"https://x.org/api?page={first}").select(F.col("item").alias("s_suppkey"), F.col("page").cast("long").alias("page"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'D' || c_custkey END AS title,
 CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'P' END AS product, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'P' END || '/' || CASE WHEN c_custkey % 5 = 0 THEN 'D' || c_custkey ELSE 'doc' || c_custkey END AS path,
 CASE WHEN c_custkey % 4 = 0 THEN 'CLOUD' WHEN c_custkey % 4 = 1 THEN '2608' ELSE 'LATEST' END AS version FROM customer WHERE c_custkey % 10 <> 9""")
def deliverable_lookup(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    key = k.cast("string")
    meta = c.select(
        k.alias("id"), F.when(k % 10 == 9, "ERROR").otherwise("OK").alias("status"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("product_url"), F.lit(None).cast("string").alias("deliverable_product"),
        F.when(k % 3 == 1, F.col("c_mktsegment")).alias("product_name"), F.when(k % 5 != 0, F.concat(F.lit("doc"), key)).otherwise("").alias("deliverable_url"), F.concat(F.lit("D"), key).alias("asked"), F.lit("P").alias("asked_product"),
        F.when(k % 4 == 1, "2608").otherwise("").alias("version"), F.lit("LATEST").alias("asked_version"),
    )
    content = c.select(k.alias("id"), F.when(k % 3 == 0, F.col("c_name")).otherwise("").alias("title"), F.when(k % 4 == 0, "CLOUD").alias("version"))
    return files.deliverables(meta, content)


@query(f"""SELECT file, asset FROM (SELECT p_type || '/' || p_brand || '/' || p_name || '-' || p_partkey || x AS file, x = '.png' AS asset, x FROM part, (VALUES ('.md'), ('.IPYNB'), ('.png'), ('.py')) AS t(x)
 UNION ALL SELECT 'node_modules/' || p_partkey || '.md', false, '.md' FROM part UNION ALL SELECT 'a/.git/' || p_partkey || '.md', false, '.md' FROM part)
 WHERE NOT regexp_matches(file, '(^|/)(\\.|node_modules/)') AND ((x IN ('.md', '.IPYNB') AND regexp_matches(lower(file), 'brand#1')) OR asset)""")
def repo_file_filter(spark, d):
    part, key = table(spark, d, "part"), F.col("p_partkey").cast("string")
    ends = part.select(F.concat("p_type", F.lit("/"), "p_brand", F.lit("/"), "p_name", F.lit("-"), key).alias("base"), F.explode(F.array(*map(F.lit, (".md", ".IPYNB", ".png", ".py")))).alias("x"))
    paths = ends.select(F.concat("base", "x").alias("path")).union(part.select(F.concat(F.lit("node_modules/"), key, F.lit(".md")))).union(part.select(F.concat(F.lit("a/.git/"), key, F.lit(".md"))))
    return files.repo_files(paths, include="brand#1", assets=r"\.png$").select(F.col("path").alias("file"), "asset")


@query(f"""SELECT host, CASE WHEN t > 0 THEN 'toc' WHEN s > 0 AND d IS NULL THEN 'sitemap' ELSE 'crawl' END AS source, CASE WHEN t > 0 THEN 'toc title' ELSE 'page title' END AS titles FROM
 (SELECT {sql_host('url')} AS host, count(*) FILTER (page_id % 7 = 0) AS t, count(*) FILTER (page_id % 2 = 0) AS s, CASE WHEN length({sql_host('url')}) % 2 = 0 THEN 2 END AS d FROM pages GROUP BY 1, 4)""")
def plan_choice(spark, d):
    pages = table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    seen = pages.groupBy("host").agg(F.count_if(F.col("page_id") % 7 == 0).alias("t"), F.count_if(F.col("page_id") % 2 == 0).alias("s"))
    plan = crawl.plan_source(F.col("t"), F.col("s"), F.when(F.length("host") % 2 == 0, 2))
    return seen.select("host", plan.alias("source"), F.when(plan == "toc", "toc title").otherwise("page title").alias("titles"))


@query("""SELECT p_partkey, p_partkey IN (SELECT p_partkey - 1 FROM part WHERE p_partkey % 10 = 4) AS promoted, CASE WHEN p_partkey IN (SELECT p_partkey - 1 FROM part WHERE p_partkey % 10 = 4) THEN p_partkey || '/00.md' ELSE p_partkey || '.md' END AS file FROM part""")
def group_promotion(spark, d):
    """A leaf of the first snapshot under which the second one shows an item becomes a group, and its file its folder's own page."""
    part = table(spark, d, "part").select("p_partkey")
    second = part.where(F.col("p_partkey") % 10 == 4).select((F.col("p_partkey") - 1).alias("parent")).distinct()
    met = part.join(second.withColumn("promoted", F.lit(True)), part.p_partkey == F.col("parent"), "left").withColumn("promoted", F.coalesce("promoted", F.lit(False)))
    key = F.col("p_partkey").cast("string")
    return met.select("p_partkey", "promoted", F.when(F.col("promoted"), F.concat(key, F.lit("/00.md"))).otherwise(F.concat(key, F.lit(".md"))).alias("file"))


@query("""WITH i AS (SELECT p_partkey, p_size AS scope, p_partkey * 10 AS lo, p_partkey * 10 + 2 AS hi FROM part), g AS (SELECT p_size AS scope, p_partkey AS panel, p_partkey * 10 - p_partkey % 40 AS lo, p_partkey * 10 + 5 + p_partkey % 30 AS hi FROM part WHERE p_partkey % 2 = 0),
 m AS (SELECT i.p_partkey, g.panel, row_number() OVER (PARTITION BY i.p_partkey ORDER BY g.hi - g.lo, g.panel) AS n, min(g.hi - g.lo) OVER (PARTITION BY i.p_partkey) AS w FROM i LEFT JOIN g ON i.scope = g.scope AND g.lo < i.lo AND g.hi > i.hi)
 SELECT p_partkey, coalesce(w, -1) AS width, CASE WHEN p_partkey % 4 = 0 THEN 'inner' WHEN p_partkey % 4 = 1 THEN 'middle' ELSE 'outer' END AS container FROM m WHERE n = 1""")
def menu_narrowing(spark, d):
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    items = part.select(F.col("p_size").alias("scope"), k.alias("item"), (k * 10).alias("lo"), (k * 10 + 2).alias("hi"))
    panels = part.where(k % 2 == 0).select(F.col("p_size").alias("scope"), k.alias("panel"), (k * 10 - k % 40).alias("lo"), (k * 10 + 5 + k % 30).alias("hi"))
    parents = scoring.innermost(items, panels)
    width = parents.join(panels.select("panel", (F.col("hi") - F.col("lo")).alias("width")), F.col("parent") == F.col("panel"), "left").select(F.col("item").alias("menu"), "width")
    row = lambda c, inner, out, buttons: F.struct(F.lit(c).alias("container"), F.lit(inner).cast("string").alias("inner"), out.alias("left_out"), buttons.alias("buttons"))
    chain = part.select(k.alias("menu"), F.explode(F.array(row("outer", "middle", F.lit(1), F.when(k % 4 < 2, 1).otherwise(0)), row("middle", "inner", F.lit(2), F.when(k % 4 == 0, 2).otherwise(1)), row("inner", None, F.lit(0), F.lit(0)))).alias("x")).select("menu", "x.*")
    return width.join(scoring.narrowed(chain), "menu").select(F.col("menu").alias("p_partkey"), F.coalesce("width", F.lit(-1)).alias("width"), "container")
