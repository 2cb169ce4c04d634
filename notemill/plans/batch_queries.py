"""Queries on runs, queues and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.functions import urls
from notemill.functions import text as tx
from notemill.operators import batch, notes

from .common import sql_host, sql_slug, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'error' ELSE 'pending' END"


def orders(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").withColumn("status", F.when(s == "F", "ok").when(s == "P", "error").otherwise("pending"))


@query(f"SELECT o_custkey, ok, total, CASE WHEN ok = total THEN 0 ELSE 2 END AS exit_code, ok = total OR (total - ok > 0 AND total - ok <= greatest(5, total // 100)) AS done FROM (SELECT o_custkey, count(*) FILTER ({_STATUS} = 'ok') AS ok, count(*) AS total FROM orders GROUP BY 1)")
def manifest_summary(spark, d):
    s = batch.run_summary(orders(spark, d), ["o_custkey"])
    return s.withColumn("done", batch.tolerated(F.col("ok"), F.col("total"), F.col("exit_code")))


@query(f"SELECT url, max(run_id) AS run_id FROM (SELECT 'https://x.org/' || o_custkey AS url, strftime(date_trunc('month', o_orderdate), '%Y%m%d-%H%M%S') AS run_id, bool_and({_STATUS} = 'ok') AS ok FROM orders GROUP BY 1, 2) WHERE ok GROUP BY url")
def latest_complete_run(spark, d):
    url = F.concat(F.lit("https://x.org/"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "/").otherwise(""))
    items = orders(spark, d).select(url.alias("url"), F.date_format(F.date_trunc("month", "o_orderdate"), "yyyyMMdd-HHmmss").alias("run_id"), "status")
    return batch.latest_complete(items)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0)")
def resume_antijoin(spark, d):
    o = orders(spark, d)
    return batch.resume(o.select("o_orderkey"), o.where("o_orderkey % 3 <> 0"), key="o_orderkey")


def queue(spark, d):
    """queue (a user), seq, line: purchases head a group, other events are items of its host."""
    e = table(spark, d, "events")
    k = F.col("event_id").cast("string")
    url = F.concat(F.lit("https://h"), (F.col("event_id") % 9).cast("string"), F.lit(".org/"), k)
    mark = F.element_at(F.array(*map(F.lit, (" ", "x", "!", ">", "~", "-"))), (F.col("event_id") % 6 + 1).cast("int"))
    tail = F.when(F.col("event_id") % 6 == 3, F.concat(F.lit(" — em andamento (pid "), (F.col("event_id") % 50).cast("string"), F.lit(")"))).when(F.col("event_id") % 12 == 2, " site --delay 1 — 3/5 lições").otherwise(" — nota")
    head = F.concat(F.lit("## Group "), (F.col("event_id") % 40).cast("string"), F.when(F.col("event_id") % 2 == 0, batch.DONE).otherwise(""))
    line = F.when(F.col("event_type") == "purchase", head).otherwise(F.concat(F.lit("- ["), mark, F.lit("] "), url, tail))
    return e.select(F.col("user_id").alias("queue"), F.col("event_id").alias("seq"), line.alias("line"))


_QUEUE = """s AS (SELECT user_id AS queue, event_id AS seq, event_type, event_id % 6 AS m, 'https://h' || (event_id % 9) || '.org/' || event_id AS url, event_id % 50 AS pid, event_id % 12 AS q,
   last_value(CASE WHEN event_type = 'purchase' THEN 'Group ' || (event_id % 40) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM events)"""


@query(f"WITH {_QUEUE} SELECT queue, seq, grp, url, CASE WHEN q = 2 THEN 'site --delay 1' ELSE '' END AS args FROM s WHERE event_type <> 'purchase' AND grp IS NOT NULL AND (m = 0 OR (m = 2 AND q <> 2) OR (m = 3 AND pid >= 25)) AND contains(grp, '1')")
def queue_parse(spark, d):
    live = spark.range(25).select(F.col("id").alias("pid"))
    return batch.pending(batch.queue_state(queue(spark, d)), live, groups="group.*1").select("queue", "seq", "grp", "url", "args")


@query(f"WITH {_QUEUE} SELECT queue, seq, pid, pid < 25 AS alive FROM s WHERE event_type <> 'purchase' AND m = 3")
def claim_reclaim(spark, d):
    live = spark.range(25).select(F.col("id").alias("pid"), F.lit(True).alias("alive"))
    claims = batch.queue_state(queue(spark, d)).where("mark = '>' AND pid IS NOT NULL")
    return claims.join(F.broadcast(live), "pid", "left").select("queue", "seq", "pid", F.coalesce("alive", F.lit(False)).alias("alive"))


@query("""SELECT o_custkey, month, bool_or(m = 'x') AND bool_and(m IN ('x', '-')) AS done FROM (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, CASE o_orderstatus WHEN 'F' THEN 'x' WHEN 'O' THEN '-' ELSE ' ' END AS m FROM orders) GROUP BY 1, 2""")
def group_completion(spark, d):
    mark = F.when(F.col("o_orderstatus") == "F", "x").when(F.col("o_orderstatus") == "O", "-").otherwise(" ")
    return batch.group_done(orders(spark, d).select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), mark.alias("mark")), ["o_custkey", "month"])


@query(f"SELECT page_id, {sql_host('url')} AS host, row_number() OVER (PARTITION BY {sql_host('url')} ORDER BY page_id) AS wave FROM pages")
def host_waves(spark, d):
    own = table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return batch.host_waves(own, seq="page_id").withColumn("wave", F.col("wave").cast("long"))


@query("""WITH c AS (SELECT o_custkey, max(o_orderpriority) AS grp FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
 SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'run' WHEN grp IS NULL THEN 'run' WHEN grp = o_orderpriority THEN 'already' ELSE 'copy' END AS action FROM orders LEFT JOIN c ON orders.o_custkey = c.o_custkey""")
def copy_or_run(spark, d):
    o = orders(spark, d)
    done = o.where("status = 'ok'").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("grp"))
    met = o.join(done, "o_custkey", "left")
    args = F.when(F.col("o_orderkey") % 10 == 0, "--delay 1").otherwise("")
    return met.select("o_orderkey", batch.copy_or_run(args, F.col("grp"), F.col("o_orderpriority")).alias("action"))


@query("""(SELECT 'mark' AS kind, event_type AS name, count(*) AS n FROM events GROUP BY event_type) UNION ALL (SELECT 'last', CAST(event_id AS VARCHAR), 1 FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 5)""")
def status_dashboard(spark, d):
    e = table(spark, d, "events")
    last = e.where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(5)
    return e.groupBy("event_type").count().select(F.lit("mark").alias("kind"), F.col("event_type").alias("name"), F.col("count").alias("n")).union(last.select(F.lit("last"), F.col("event_id").cast("string"), F.lit(1).cast("long")))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'geral' ELSE r_name END AS category FROM nation JOIN region ON n_regionkey = r_regionkey")
def category_lookup(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region").where("r_regionkey <> 2")
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", F.coalesce("r_name", F.lit("geral")).alias("category"))


@query("""SELECT l_orderkey, max(l_linenumber) AS attempts, CASE WHEN bool_or(l_returnflag = 'N') THEN 'ok' ELSE 'error' END AS status, coalesce(arg_max('error ' || l_linenumber, l_linenumber) FILTER (l_returnflag <> 'N'), '') AS error FROM lineitem
 WHERE l_linenumber <= coalesce((SELECT min(l_linenumber) FROM lineitem i WHERE i.l_orderkey = lineitem.l_orderkey AND i.l_returnflag = 'N'), 99) GROUP BY l_orderkey""")
def retry_outcome(spark, d):
    """Attempts end with the first that is ok; the error of the one before it stays."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("ok"))
    end = rows.groupBy("l_orderkey").agg(F.coalesce(F.min(F.when(F.col("ok"), F.col("l_linenumber"))), F.max("l_linenumber")).alias("attempts"), F.bool_or("ok").alias("ok"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("l_linenumber")))).alias("bad"))
    # an order's attempts are a few
    last = F.array_max(F.filter("bad", lambda n: n <= F.col("attempts")))
    return end.select("l_orderkey", "attempts", F.when(F.col("ok"), "ok").otherwise("error").alias("status"), F.coalesce(F.concat(F.lit("error "), last.cast("string")), F.lit("")).alias("error"))


@query("SELECT o_custkey, max(run_id) AS run_id FROM (SELECT o_custkey, strftime(o_orderdate, '%Y%m%d-%H%M%S') || CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE '' END AS run_id FROM orders) WHERE regexp_full_match(run_id, '[0-9]{8}-[0-9]{6}') GROUP BY 1")
def latest_run(spark, d):
    run = F.concat(F.date_format("o_orderdate", "yyyyMMdd-HHmmss"), F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(""))
    return batch.latest_run(orders(spark, d).select("o_custkey", run.alias("run_id")), ["o_custkey"])


@query(f"""SELECT o_custkey, '{{"items":[' || string_agg('{{"o_orderkey":' || o_orderkey || ',"status":"' || {_STATUS} || '","o_orderpriority":"' || o_orderpriority || '"}}', ',' ORDER BY o_orderkey) || ']}}' AS manifest FROM orders GROUP BY 1""")
def manifest_json(spark, d):
    return notes.manifests(orders(spark, d), ["o_custkey"], "o_orderkey", ["o_orderkey", "status", "o_orderpriority"])


@query(f"""WITH c AS (SELECT c_custkey, c_nationkey, {sql_slug("split_part(c_name, '#', 1) || ' ' || (c_custkey % 97)", 80)} AS slug, 'https://x.org/' || (c_custkey % 89) AS url FROM customer),
 f AS (SELECT *, least(min(c_custkey) OVER (PARTITION BY c_nationkey, slug), min(c_custkey) OVER (PARTITION BY c_nationkey, url)) AS first FROM c)
 SELECT c_custkey, c_nationkey, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY first) - 1 AS number FROM f""")
def run_numbering(spark, d):
    c = table(spark, d, "customer")
    slug = tx.slugify(F.concat(F.substring_index("c_name", "#", 1), F.lit(" "), (F.col("c_custkey") % 97).cast("string")), 80)
    url = F.concat(F.lit("https://x.org/"), (F.col("c_custkey") % 89).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "/").otherwise(""))
    own = c.select("c_custkey", "c_nationkey", slug.alias("slug"), url.alias("url"))
    return batch.numbered_folders(own, "c_nationkey", "c_custkey", "slug", "url").select("c_custkey", "c_nationkey", F.col("number").cast("long").alias("number"))


@query("SELECT o_orderkey, 'out/' || o_orderpriority || '/' || strftime(o_orderdate, '%Y%m%d') AS output FROM orders WHERE o_orderkey % 2 = 0 AND NOT (o_orderkey % 6 = 0) UNION ALL SELECT o_orderkey, 'old/' || o_orderkey FROM orders WHERE o_orderkey % 6 = 0")
def copy_run(spark, d):
    """Runs copied to their group with output patched, unless they are there."""
    o = orders(spark, d).where("o_orderkey % 2 = 0").withColumn("output", F.concat(F.lit("old/"), F.col("o_orderkey").cast("string")))
    there = o.where("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("k"), F.lit(True).alias("exists"))
    met = o.join(there, o.o_orderkey == there.k, "left")
    target = F.concat_ws("/", F.lit("out"), "o_orderpriority", F.date_format("o_orderdate", "yyyyMMdd"))
    return met.select("o_orderkey", F.when(F.col("exists").isNull(), target).otherwise(F.col("output")).alias("output"))


@query("SELECT event_id AS seq, CASE WHEN event_id = (SELECT min(event_id) FROM events WHERE event_type = 'view') THEN 'done' ELSE event_type END AS line FROM events")
def status_rewrite(spark, d):
    return batch.rewritten(table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("line")), "view", "done")


@query(f"""WITH p AS (SELECT page_id, {sql_host('url')} AS host, url, row_number() OVER (PARTITION BY {sql_host('url')} ORDER BY page_id) AS n FROM pages), o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS k FROM p WHERE regexp_matches(lower(host || ' ' || url), 'en/|fr/') AND page_id % 5 <> 0)
 SELECT page_id, n AS number FROM o WHERE k <= 3""")
def limit_only_filters(spark, d):
    """Numbers first, then the filter, what is done, and the limit of new items a host."""
    pages = table(spark, d, "pages").select("page_id", "url", urls.host(F.col("url")).alias("host"))
    n = batch.host_waves(pages, seq="page_id").withColumnRenamed("wave", "number")
    kept = batch.resume(n.where(F.concat("host", F.lit(" "), "url").rlike(tx.rxi("EN/|fr/"))), n.where("page_id % 5 = 0").select("page_id", F.lit("ok").alias("status")), key="page_id")
    return batch.host_waves(kept, seq="page_id").where("wave <= 3").select("page_id", F.col("number").cast("long").alias("number"))


@query(f"SELECT page_id, n AS number FROM (SELECT page_id, row_number() OVER (PARTITION BY {sql_host('url')} ORDER BY page_id) AS n FROM pages WHERE NOT regexp_matches(lower(url), '/es/|utm_')) WHERE n <= 5")
def url_exclude_and_caps(spark, d):
    pages = table(spark, d, "pages").where(urls.in_scope(F.col("url"), "http", "/ES/|utm_")).select("page_id", urls.host(F.col("url")).alias("host"))
    return batch.host_waves(pages, seq="page_id").where("wave <= 5").select("page_id", F.col("wave").cast("long").alias("number"))
