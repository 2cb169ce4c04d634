"""Queries that choose the best of several, and those on readings in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notemill.functions import html, urls
from notemill.operators import scoring
from notemill.session import shared_dir
from notemill.streaming import stability

from .common import sql_host, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]*)</a>', 1)) AS t FROM pages),
 n AS (SELECT page_id, {sql_host('url')} AS host, count(*) AS items, sum(length(t)) AS chars FROM l WHERE length(t) BETWEEN 2 AND 140 GROUP BY 1, 2),
 s AS (SELECT *, items * least(1.0::DOUBLE, 1.5::DOUBLE * chars / greatest(chars * (1 + page_id % 3), 1)) * CASE WHEN chars / items <= 80 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM n WHERE items >= 2)
 SELECT host, page_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) AS k FROM s) WHERE k = 1""")
def menu_score(spark, d):
    """The best navigation of each host; two pages of three have more text around it."""
    titles = F.regexp_extract_all(F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1), F.lit("<a [^>]*>([^<]*)</a>"), 1)
    t = table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), F.explode(titles).alias("title")).where(F.char_length("title").between(2, 140))
    n = t.groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("items"), F.sum(F.char_length("title")).alias("chars"))
    s = n.withColumn("score", scoring.menu_score(F.col("items"), F.col("chars"), F.col("chars") * (1 + F.col("page_id") % 3)))
    return scoring.best(s, ["host"], "score", "page_id").select("host", "page_id", F.round("score", 6).alias("score"))


_CUT = "(?s)<article[^>]*>(.*)</article>"


@query(f"""WITH c AS (SELECT page_id, 0 AS seq, 'article' AS kind, length(regexp_extract(html, '{_CUT}', 1))::DOUBLE AS s FROM pages
 UNION ALL SELECT page_id, 1, 'body', (length(html) - length(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1))) * 0.6::DOUBLE * 0.6::DOUBLE FROM pages UNION ALL SELECT page_id, 2, 'footer', length(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1))::DOUBLE FROM pages)
 SELECT page_id, kind, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY s DESC, seq) AS k FROM c) WHERE k = 1""")
def content_score(spark, d):
    pages = table(spark, d, "pages")
    size = lambda p: F.char_length(F.regexp_extract("html", p, 1))
    row = lambda seq, kind, n, nav, wraps, body: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), scoring.content_score(n, nav, F.lit(wraps), F.lit(body)).cast("double").alias("score"))
    nav = size("(?s)<nav>(.*?)</nav>")
    rows = pages.select("page_id", F.explode(F.array(row(0, "article", size(_CUT), F.lit(0), False, False), row(1, "body", F.char_length("html"), nav, True, True), row(2, "footer", size("(?s)<footer>(.*?)</footer>"), F.lit(0), False, False))).alias("x")).select("page_id", "x.*")
    return scoring.best(rows, ["page_id"], "score", "seq").select("page_id", "kind", F.round("score", 4).alias("score"))


@query("SELECT p_brand, min(p_partkey) AS p_partkey, p_size FROM part WHERE (p_brand, p_size) IN (SELECT (p_brand, max(p_size)) FROM part GROUP BY p_brand) GROUP BY p_brand, p_size")
def best_frame(spark, d):
    return scoring.best(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", "p_partkey")


READINGS = ("ts", "event_id")


def readings(spark, d):
    return table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", (F.col("event_type") == "error").alias("loading"))


@query("""WITH r AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events WHERE event_type <> 'error'), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM r WHERE b = event_type)
, t AS (SELECT user_id, event_id, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b, event_type, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), u AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM t WHERE a = b AND b = event_type)
 SELECT 'two' AS rule, user_id, event_id, event_type FROM o WHERE k = 1 UNION ALL SELECT 'three', user_id, event_id, event_type FROM u WHERE k = 1""")
def content_stability(spark, d):
    r = readings(spark, d)
    two = scoring.stable_at(r, "user_id", list(READINGS), "event_type", "loading").select(F.lit("two").alias("rule"), "user_id", "event_id", "event_type")
    three = scoring.three_alike(r, "user_id", list(READINGS), ["event_type"]).select(F.lit("three").alias("rule"), "user_id", "event_id", "event_type")
    return two.union(three)


@query("""WITH r AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), t AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'signup' THEN 'tab' WHEN event_type = 'purchase' THEN 'url' WHEN b IS NOT NULL AND b <> event_type AND event_type <> 'error' THEN 'content' END AS kind FROM r)
 SELECT user_id, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM t WHERE kind IS NOT NULL) WHERE k = 1""")
def transition_first(spark, d):
    by = Window.partitionBy("user_id").orderBy(*READINGS)
    e, t = readings(spark, d), F.col("event_type")
    before = e.withColumn("b", F.lag("event_type").over(by))
    kind = scoring.transition(t == "signup", t == "purchase", ~F.col("loading"), F.coalesce(F.col("b") != t, F.lit(False)))
    seen = before.withColumn("kind", kind).where("kind IS NOT NULL")
    return seen.groupBy("user_id").agg(F.min(F.struct(*READINGS, "kind")).alias("k")).select("user_id", "k.event_id", "k.kind")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
 SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k""")
def dom_quiet_sessions(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("began"), F.count(F.lit(1)).alias("n")).select("user_id", "began", "n")


@query("""SELECT f, o, x, s, m, c, CASE WHEN f = 0 THEN 'missing' WHEN o = 1 THEN 'open' WHEN o = 2 THEN 'closed' WHEN x = 1 THEN 'open' WHEN x = 2 THEN 'closed' WHEN s IN (1, 2) THEN 'open' WHEN s IN (3, 4) THEN 'closed'
   WHEN m = 1 THEN 'open' WHEN m = 2 THEN 'closed' WHEN c = 1 THEN 'closed' WHEN c = 2 THEN 'open' ELSE 'unknown' END AS state, x > 0 OR m > 0 OR s > 0 OR c > 0 AS grp
 FROM range(2) a(f), range(3) b(o), range(3) d(x), range(5) e(s), range(3) g(m), range(4) h(c)""")
def group_state(spark, d):
    rows = spark.range(2).withColumnRenamed("id", "f")
    for c, n in (("o", 3), ("x", 3), ("s", 5), ("m", 3), ("c", 4)):
        rows = rows.withColumn(c, F.explode(F.array(*(F.lit(k).cast("long") for k in range(n)))))
    told = lambda c, *values: F.try_element_at(F.array(*map(F.lit, values)), F.when(F.col(c) > 0, F.col(c).cast("int")))
    expanded, state, classes = told("x", "true", "false"), told("s", "open", "expanded", "closed", "collapsed"), told("c", "a collapsed", "is-expanded b", "expanded-not collapsed")
    got = scoring.group_state(F.col("f") == 1, told("o", True, False), expanded, state, told("m", True, False), F.when(F.col("c") == 3, None).otherwise(classes))
    group = scoring.is_group(expanded, F.col("m") > 0, state, F.lit("false"), classes, F.lit(False), F.lit(None).cast("boolean"))
    return rows.select("f", "o", "x", "s", "m", "c", got.alias("state"), group.alias("grp"))


@query("""WITH r AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events WHERE event_type <> 'error'), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM r WHERE b = event_type)
 SELECT user_id, event_id, event_type, true AS settled FROM o WHERE k = 1""")
def stability_stream(spark, d):
    """Readings as a stream, all that is there; the rows as the stream leaves them."""
    import uuid

    folder = f"{shared_dir(spark)}/notemill-stream-{uuid.uuid4().hex[:12]}"
    table(spark, d, "events").write.parquet(f"{folder}/in")
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{folder}/in")
    r = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", (F.col("event_type") == "error").alias("loading"))
    out = stability.settled(r, "user_id", "ts", "event_id", "event_type", "loading", timeout_ms=None)
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select(F.col("item").alias("user_id"), "event_id", F.col("value").alias("event_type"), "settled")
