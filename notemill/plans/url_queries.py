"""Queries on addresses and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.functions import html, urls
from notemill.functions import text as tx
from notemill.operators import batch

from .common import AT, H1, TITLE, sql_host, sql_netloc, sql_normal, sql_path, sql_query, sql_slug, sql_strip, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def url():
    return F.col("url")


@query(f"SELECT page_id, {sql_normal('url')} AS url FROM pages")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalize(url()).alias("url"))


@query(f"SELECT page_id, CASE WHEN n LIKE '%/' THEN n ELSE regexp_replace(n, '/[^/]*$', '') || '/' END AS prefix FROM (SELECT page_id, {sql_normal('url')} AS n FROM pages)")
def url_default_prefix(spark, d):
    return table(spark, d, "pages").select("page_id", urls.default_prefix(url()).alias("prefix"))


@query(f"SELECT page_id, url FROM pages WHERE starts_with(url, 'https://') AND NOT regexp_matches(lower({sql_path('url')}), '\\.(png|jpe?g|gif|svg|webp|ico|pdf|zip|gz|tgz|ipynb|py|json|xml|txt|csv|mp4|css|js)$') AND NOT contains(lower(url), '/es/')")
def url_scope_filter(spark, d):
    return table(spark, d, "pages").select("page_id", "url").where(urls.in_scope(url(), "https://", "/es/"))


@query(f"SELECT page_id, {sql_host('url')} AS host, {sql_netloc('url')} AS netloc, {sql_path('url')} AS path, {sql_query('url')} AS query FROM pages")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", urls.host(url()).alias("host"), urls.netloc(url()).alias("netloc"), urls.path(url()).alias("path"), urls.query(url()).alias("query"))


_KINDS = ("https://help.sap.com/docs/", "https://help.sap.com/viewer/", "https://github.com/", "https://learn.microsoft.com/", "https://learning.sap.com/live-sessions/", "https://x.org/")


@query(f"""SELECT page_id, k, CASE WHEN contains(u, '://help.sap.com/docs/') OR contains(u, '://help.sap.com/viewer/') THEN 'help' WHEN contains(u, '://github.com/') THEN 'repo'
  WHEN lower({sql_path('u')}) LIKE '%.pdf' THEN 'pdf' WHEN contains(u, '://learn.microsoft.com/') OR contains(u, '://learning.sap.com/live-sessions/') THEN 'page' ELSE 'extract' END AS command
FROM (SELECT page_id, k, base || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '.PDF?x=1' ELSE '' END AS u FROM pages,
  (VALUES {', '.join(f"({n}, '{b}')" for n, b in enumerate(_KINDS))}) AS t(k, base)
  UNION ALL SELECT page_id, -1, url FROM pages)""")
def source_kind(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    made = pages.select("page_id", F.posexplode(F.array(*map(F.lit, _KINDS))).alias("k", "base"))
    made = made.select("page_id", "k", F.concat("base", F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".PDF?x=1").otherwise("")).alias("u"))
    both = made.union(pages.select("page_id", F.lit(-1), "url"))
    return both.select("page_id", "k", urls.command_for(F.col("u")).alias("command"))


@query(f"""SELECT page_id, k, {sql_host('url')} <> {sql_host('landed')} AND regexp_matches({sql_host('landed')} || {sql_path('landed')}, '(?i)login|signin|sign-in|sso|saml|oauth|auth|idp|accounts') AS expired
FROM (SELECT page_id, url, k, CASE k WHEN 0 THEN url WHEN 1 THEN 'https://accounts.example.com/x' WHEN 2 THEN 'https://id.example.net/SSO/start' ELSE 'https://other.example.net/docs' END AS landed FROM pages, (VALUES (0), (1), (2), (3)) AS t(k))""")
def login_redirect_flag(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    landed = F.when(F.col("k") == 0, url()).when(F.col("k") == 1, "https://accounts.example.com/x").when(F.col("k") == 2, "https://id.example.net/SSO/start").otherwise("https://other.example.net/docs")
    return pages.withColumn("landed", landed).select("page_id", "k", urls.login_redirect(url(), F.col("landed")).alias("expired"))


def headings(spark, d):
    """page_id, url, tab (title), h1: by patterns, as every captured page has exactly one of each."""
    pages = table(spark, d, "pages")
    cut = lambda tag: F.trim(F.regexp_extract("html", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    return pages.select("page_id", "url", cut("title").alias("tab"), cut("h1").alias("h1"))


@query(f"SELECT page_id, {sql_slug(H1)} AS slug, {sql_slug(H1, 50)} AS slug50 FROM pages")
def title_slug(spark, d):
    return headings(spark, d).select("page_id", tx.slugify(F.col("h1")).alias("slug"), tx.slugify(F.col("h1"), 50).alias("slug50"))


@query(rf"SELECT doc_id, md5(lower(trim(regexp_replace(strip_accents(text), '\s+', ' ', 'g')))) AS plain FROM documents")
def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.plain(F.col("text"))).alias("plain"))


@query(rf"""SELECT page_id, CASE WHEN h <> '' AND (t = '' OR (length(h) > length(t) AND starts_with(lower(h), lower(regexp_replace(t, '[…. ]+$', ''))))) THEN h ELSE t END AS title
FROM (SELECT page_id, {sql_strip("split_part(tab, ' | ', 1)")} AS t, trim(regexp_replace(h1, '\s+', ' ', 'g')) AS h FROM
  (SELECT page_id, CASE page_id % 3 WHEN 0 THEN {TITLE} WHEN 1 THEN left({TITLE}, 40) ELSE '' END AS tab, {H1} AS h1 FROM pages))""")
def pick_title(spark, d):
    tab = F.when(F.col("page_id") % 3 == 0, F.col("tab")).when(F.col("page_id") % 3 == 1, F.substring("tab", 1, 40)).otherwise("")
    return headings(spark, d).select("page_id", tx.pick_title(tab, F.col("h1")).alias("title"))


_FRONT_SQL = f"""'---' || chr(10) || 'title: "' || replace({H1}, '"', '''') || '"' || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'module: "' || {sql_host('url')} || '"' || chr(10) ELSE '' END || 'source: ' || url || chr(10) || 'extracted_at: {AT}' || chr(10) || '---' || chr(10) || chr(10)"""


def fronted(spark, d):
    return headings(spark, d).withColumn("front", tx.front_matter(F.col("h1"), url(), F.lit(AT), F.when(F.col("page_id") % 2 == 0, urls.host(url())).otherwise("")))


@query(f"SELECT page_id, {_FRONT_SQL} || CASE WHEN page_id % 3 = 0 THEN '# Own' ELSE '# ' || {H1} || chr(10) || chr(10) || 'Text ' || page_id END AS note FROM pages")
def front_matter(spark, d):
    body = F.when(F.col("page_id") % 3 == 0, F.lit("# Own")).otherwise(F.concat(F.lit("Text "), F.col("page_id").cast("string")))
    return fronted(spark, d).select("page_id", F.concat("front", tx.with_title(F.col("h1"), body)).alias("note"))


@query(f"SELECT page_id, length(f) AS front_chars, replace({H1}, '\"', '''') AS title, 'Text ' || page_id || chr(10) || '---' AS body FROM (SELECT *, {_FRONT_SQL} AS f FROM pages)")
def front_matter_split(spark, d):
    note = fronted(spark, d).select("page_id", F.concat("front", F.lit("Text "), F.col("page_id").cast("string"), F.lit("\n---")).alias("note"))
    n = F.col("note")
    return note.select("page_id", F.char_length(tx.front_of(n)).cast("long").alias("front_chars"), tx.front_title(n, F.lit("?")).alias("title"), tx.body_of(n).alias("body"))


@query("SELECT doc_id, sha1(text) AS fingerprint FROM documents")
def text_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1("text").alias("fingerprint"))


_TEMPLATES = ("{url}?accept=text/markdown", "{url}.md")


@query("SELECT page_id, k, replace(t, '{url}', regexp_replace(url, '/+$', '')) AS markdown FROM pages, (VALUES (0, '{url}?accept=text/markdown'), (1, '{url}.md')) AS v(k, t)")
def markdown_variant_url(spark, d):
    pages = table(spark, d, "pages")
    both = [pages.select("page_id", F.lit(k).alias("k"), urls.markdown_url(url(), t).alias("markdown")) for k, t in enumerate(_TEMPLATES)]
    return both[0].union(both[1])


@query(rf"""SELECT page_id, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN {H1} ELSE '' END, ''), nullif(regexp_extract(regexp_replace({sql_path('url')}, '/+$', ''), '([^/]*)$', 1), ''), {sql_host('url')}) AS course,
  CASE WHEN page_id % 4 = 0 THEN 'Crumb' WHEN len(s) >= 2 THEN replace(s[len(s) - 1], '-', ' ') END AS parent FROM (SELECT *, list_filter(string_split({sql_path('url')}, '/'), lambda x: x <> '') AS s FROM pages)""")
def name_fallback(spark, d):
    title = F.when(F.col("page_id") % 3 == 0, F.col("h1")).otherwise("")
    crumbs = F.when(F.col("page_id") % 4 == 0, F.array(F.lit("Home"), F.lit("Crumb"), F.lit("Here"))).otherwise(F.array(F.lit("Home")))
    return headings(spark, d).select("page_id", urls.course_name(title, url()).alias("course"), urls.parent_name(crumbs, url()).alias("parent"))


@query(r"""SELECT page_id, seq, href, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS link FROM (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS seq FROM
 (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM pages))""")
def page_links(spark, d):
    links = table(spark, d, "pages").select("page_id", "url", F.posexplode(html.hrefs(F.col("html"))).alias("seq", "href"))
    return links.select("page_id", F.col("seq").cast("long").alias("seq"), "href", urls.join(url(), F.col("href")).alias("link"))


@query(r"""SELECT link, page_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, seq) AS n FROM (SELECT page_id, seq, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS link FROM
 (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS seq FROM (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM pages)))) WHERE n = 1""")
def link_graph_dedupe(spark, d):
    # the first link to an address is a minimum, so links combine before the shuffle
    return page_links(spark, d).groupBy("link").agg(F.min(F.struct("page_id", "seq")).alias("k")).select("link", "k.page_id", "k.seq")


@query("""SELECT DISTINCT p.page_id, h.href, regexp_extract(p.url, '^([a-z]+://[^/?#]*)', 1) || h.href AS link FROM pages p JOIN
 (SELECT page_id % 50 AS m, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) h ON p.page_id % 50 = h.m""")
def joined_links(spark, d):
    pages = table(spark, d, "pages")
    links = pages.select((F.col("page_id") % 50).alias("m"), F.explode(html.hrefs(F.col("html"))).alias("href")).distinct()
    met = pages.select("page_id", "url", (F.col("page_id") % 50).alias("m")).join(links, "m")
    return met.select("page_id", "href", urls.join_from_root(url(), F.col("href")).alias("link"))


_HELP = """CASE p_partkey % 4 WHEN 0 THEN 'https://help.sap.com/docs/P%20' || p_size || '/D' || p_partkey || '/t' || p_partkey || '.html?version=V' || p_size || '&locale=pt-BR'
 WHEN 1 THEN 'https://help.sap.com/docs/r/d' || p_partkey || '/CLOUD/en-US/t+' || p_size || '.html' WHEN 2 THEN 'https://help.sap.com/viewer/d' || p_partkey || '/2.0/de-DE/t' || p_size || '.html'
 ELSE CASE WHEN p_size % 2 = 0 THEN 'https://help.sap.com/docs/P/D' || p_partkey ELSE 'https://example.com/docs/P/D' END END"""


@query(f"""SELECT p_partkey, CASE k WHEN 0 THEN 'P ' || p_size WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 'P' END ELSE 'r' END AS product,
 CASE k WHEN 0 THEN 'D' || p_partkey WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 'D' || p_partkey END ELSE 'd' || p_partkey END AS deliverable,
 CASE k WHEN 0 THEN 't' || p_partkey WHEN 1 THEN 't+' || p_size WHEN 2 THEN 't' || p_size ELSE CASE WHEN p_size % 2 = 0 THEN '' END END AS topic,
 CASE k WHEN 0 THEN 'V' || p_size WHEN 1 THEN 'CLOUD' WHEN 2 THEN '2.0' ELSE CASE WHEN p_size % 2 = 0 THEN 'LATEST' END END AS version,
 CASE k WHEN 0 THEN 'pt-BR' WHEN 1 THEN 'en-US' WHEN 2 THEN 'de-DE' ELSE CASE WHEN p_size % 2 = 0 THEN 'en-US' END END AS locale FROM (SELECT *, p_partkey % 4 AS k FROM part)""")
def help_url_parse(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.expr(_HELP).alias("url"))
    h = urls.help_parts(url())
    return parts.select("p_partkey", h.alias("h")).select("p_partkey", "h.*")


@query("""SELECT p_partkey, 'https://github.com/o/' || p_brand || '/blob/main/' || p_type || '/' || p_name || '.md' AS blob, p_type || ' › ' || p_name AS path,
 '/docs/' || p_brand || '/' || CASE WHEN p_partkey % 2 = 0 THEN 'topic-' || p_partkey ELSE 'loio' || p_partkey END || '?version=LATEST' AS topic FROM part""")
def source_url(spark, d):
    part = table(spark, d, "part")
    readable = F.create_map(F.concat(F.lit("loio"), F.col("p_partkey").cast("string")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("topic-"), F.col("p_partkey").cast("string"))))
    loio = F.concat(F.lit("loio"), F.col("p_partkey").cast("string"))
    topic = F.concat(F.lit("/docs/"), "p_brand", F.lit("/"), F.coalesce(F.try_element_at(readable, loio), loio), F.lit("?version=LATEST"))
    blob = urls.blob_url(F.concat(F.lit("https://github.com/o/"), F.col("p_brand"), F.lit("/")), F.lit("main"), F.concat(F.col("p_type"), F.lit("/"), F.col("p_name"), F.lit(".md")))
    return part.select("p_partkey", blob.alias("blob"), tx.path_text(F.array("p_type", "p_name")).alias("path"), topic.alias("topic"))


_HEADS = ("# **{}** `x_y`", "text\n## __{}__", "### {}", "#{}")


@query("""SELECT p_partkey, k, CASE k WHEN 0 THEN p_name || ' x_y' WHEN 1 THEN p_name ELSE 'fallback ' || p_partkey END AS title FROM part, (VALUES (0), (1), (2), (3)) AS t(k)""")
def first_heading_title(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", F.posexplode(F.array(*map(F.lit, _HEADS))).alias("k", "t"))
    md = F.replace("t", F.lit("{}"), F.col("p_name"))
    return part.select("p_partkey", "k", tx.first_heading(md, F.concat(F.lit("fallback "), F.col("p_partkey").cast("string"))).alias("title"))


@query(rf"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Doc ' || doc_id WHEN 1 THEN 'Head ' || doc_id ELSE 'Head ' || doc_id END AS title,
 md5({sql_strip("CASE doc_id % 3 WHEN 0 THEN '# Head ' || doc_id || chr(10) || t ELSE '# Head ' || doc_id || chr(10) || t END")} || chr(10)) AS body
FROM (SELECT doc_id, array_to_string(string_split(text, chr(10)), chr(10)) AS t FROM documents)""")
def clean_markdown(spark, d):
    docs = table(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    head = F.concat(F.lit("# Head "), i, F.lit(" [[a-"), i, F.lit("]]\n"), F.col("text"))
    front = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\ntitle: 'Doc "), i, F.lit("'\nx: 1\n---\n"))).when(F.col("doc_id") % 3 == 1, F.lit("> ## Documentation Index\n> see https://x.y/llms.txt\n\n")).otherwise(F.lit("\n\n"))
    c = tx.clean_markdown(F.concat(front, head))
    return docs.select("doc_id", c.alias("c")).select("doc_id", F.col("c.title").alias("title"), F.md5("c.body").alias("body"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'site' ELSE 'extract' END AS command, CASE WHEN o_orderkey % 5 = 0 THEN 'site --delay 1' ELSE '' END AS args,
 CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 100 ELSE -1 END AS ok, CASE WHEN o_orderkey % 7 <> 0 THEN 100 ELSE -1 END AS total, CASE WHEN o_orderkey % 7 <> 0 THEN 'out/' || o_orderkey END AS folder FROM orders""")
def result_line_parse(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey").cast("string")
    rest = F.when(F.col("o_orderkey") % 5 == 0, F.lit(" site --delay 1 — feito")).otherwise(F.lit(" — feito"))
    log = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("INFO início\nOK: "), (F.col("o_orderkey") % 100).cast("string"), F.lit("/100 item(ns) extraído(s) em out/"), k, F.lit("\nfim"))).otherwise("saída 3")
    args = tx.line_args(rest)
    return o.select("o_orderkey", batch.command(F.lit("https://x.org/a"), args).alias("command"), args.alias("args"), batch.result_of(log).alias("r")).select("o_orderkey", "command", "args", F.coalesce(F.col("r.ok").cast("long"), F.lit(-1)).alias("ok"), F.coalesce("r.total", F.lit(-1)).alias("total"), "r.folder")


@query("SELECT 'page' AS kind, page_id AS id, true AS html FROM pages UNION ALL SELECT 'document', doc_id, false FROM documents UNION ALL SELECT 'odd', page_id, true FROM pages")
def html_sniff(spark, d):
    pages, docs = table(spark, d, "pages"), table(spark, d, "documents")
    one = pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("t")).union(docs.select(F.lit("document"), "doc_id", "text"))
    one = one.union(pages.select(F.lit("odd"), "page_id", F.concat(F.lit("\n <HTML>"), F.col("html"))))
    return one.select("kind", "id", tx.is_html(F.col("t")).alias("html"))


@query(r"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN 'site' WHEN l_linenumber % 4 = 1 THEN 'extract' WHEN l_linenumber % 4 = 2 THEN 'pdf' ELSE 'extract' END AS command,
 CASE WHEN l_linenumber % 4 = 0 THEN 'site|--only|a ' || l_orderkey || '|--limit|5' WHEN l_linenumber % 4 = 1 THEN '--only|it''s "b"|x y' WHEN l_linenumber % 4 = 2 THEN 'pdf|c\d|' || l_orderkey ELSE '' END AS words FROM lineitem""")
def argument_words(spark, d):
    """Quotes of both kinds, escapes, quotes inside quotes, nothing; a quote that isn't closed gives no words."""
    n, key = F.col("l_linenumber") % 4, F.col("l_orderkey").cast("string")
    line = F.when(n == 0, F.concat(F.lit("site  --only 'a "), key, F.lit("' --limit 5"))).when(n == 1, F.lit('--only "it\'s \\"b\\"" x\\ y')).when(n == 2, F.concat(F.lit("pdf 'c\\d' \""), key, F.lit('"'))).otherwise(F.lit("--only 'open"))
    words = F.coalesce(F.array_join(batch.arguments(line), "|"), F.lit(""))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", batch.command(F.lit("https://x.org/a"), line).alias("command"), words.alias("words"))
