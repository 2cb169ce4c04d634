"""robots.txt: parsing, evaluation and the gate before anything is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions import text as tx
from notemill.functions import urls

AGENT = "notemill"
_LOCAL = r"^(localhost|127\.0\.0\.1|::1)$|\.(localhost|test)$"


def usable_text(status: Column, text: Column) -> Column:
    """The rules that a response holds: none for anything but success, nor for a page in place of the file."""
    return F.when(status.between(200, 299) & ~tx.is_html(text), text).otherwise("")


def pattern_of(value: Column) -> Column:
    """A rule's path as a regular expression, anchored at the start; * is anything, a last $ the end."""
    body = F.regexp_replace(value, r"\$$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"([\\.^$|?+()\[\]{}])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("(?s)^"), body, F.when(value.endswith("$"), F.lit("$")).otherwise(""))


def parse(robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """robots: host, text. Gives host, allow, pattern, regex, crawl_delay: a row a rule of the groups that bind the agent,
    and a row with null pattern for the crawl delay (0 where none is told).

    A user-agent line after any directive begins a group; an agent that is part of ours (an empty one too) beats *."""
    line = F.split("text", "\r\n|\r|\n")
    cut = robots.select("host", F.posexplode(line).alias("n", "raw")).select("host", "n", tx.strip(F.regexp_replace("raw", "#.*$", "")).alias("line")).where(F.col("line").contains(":"))
    key = F.lower(tx.strip(F.substring_index("line", ":", 1)))
    value = tx.strip(F.expr("substr(line, instr(line, ':') + 1)"))
    row = cut.select("host", "n", key.alias("key"), value.alias("value")).where(F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay"))
    by = Window.partitionBy("host").orderBy("n")
    is_agent = F.col("key") == "user-agent"
    # directives before any agent bind nobody
    row = row.withColumn("agents", F.sum(is_agent.cast("int")).over(by)).where("agents > 0")
    begins = is_agent & (F.coalesce(F.lag("key").over(by), F.lit("")) != "user-agent")
    row = row.withColumn("grp", F.sum(begins.cast("int")).over(by))
    named = is_agent & (F.col("value") != "*") & F.lit(agent.lower()).contains(F.lower("value"))
    group = row.groupBy("host", "grp").agg(F.max(named.cast("int")).alias("mine"), F.max((is_agent & (F.col("value") == "*")).cast("int")).alias("star"))
    group = group.withColumn("any_mine", F.max("mine").over(Window.partitionBy("host")))
    chosen = group.where("mine = 1 OR (any_mine = 0 AND star = 1)").select("host", "grp")
    bound = row.where(~is_agent).join(chosen, ["host", "grp"])
    delay = bound.groupBy("host").agg(F.max(F.when(F.col("key") == "crawl-delay", F.expr("try_cast(value AS double)"))).alias("d"))
    delays = robots.select("host").distinct().join(delay, "host", "left").select("host", F.greatest(F.coalesce("d", F.lit(0.0)), F.lit(0.0)).alias("crawl_delay"))
    rules = bound.where("key <> 'crawl-delay' AND value <> ''").select("host", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"), pattern_of(F.col("value")).alias("regex"))
    return rules.withColumn("crawl_delay", F.lit(None).cast("double")).unionByName(delays.select("host", F.lit(None).cast("boolean").alias("allow"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("regex"), "crawl_delay"))


def evaluate(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", on: str = "host") -> DataFrame:
    """pages with a column allowed: that of the longest rule that fits, allow before disallow, or true.

    The rules of a host are gathered in one row (a robots file is bounded), so pages meet them in one join and none is multiplied."""
    own = rules.where("pattern IS NOT NULL").groupBy(F.col(on).alias("of")).agg(F.array_sort(F.collect_list(F.struct((-F.char_length("pattern")).alias("n"), (~F.col("allow")).alias("deny"), "regex"))).alias("own"))
    q = urls.query(F.col(url))
    target = F.concat(F.coalesce(F.nullif(urls.path(F.col(url)), F.lit("")), F.lit("/")), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    met = pages.withColumn("target", target).join(own, F.col(on) == F.col("of"), "left")
    fits = F.expr("filter(own, r -> target RLIKE r.regex)")
    return met.withColumn("allowed", F.coalesce(~F.try_element_at(fits, F.lit(1))["deny"], F.lit(True))).drop("of", "own", "target")


def gate(pages: DataFrame, authorized: list[str] | Column, allowed: str = "allowed", url: str = "url") -> DataFrame:
    """Pages that may be read: allowed, or of an authorized or a local host. authorized: hosts, or a condition."""
    h = urls.host(F.col(url))
    own = h.isin(authorized) if isinstance(authorized, list) else authorized
    return pages.where(F.col(allowed) | own | h.rlike(_LOCAL))


def wait(low: Column, high: Column, share: Column, delay: Column, floor: Column) -> Column:
    """The pause before a page: within delay's half and one and a half, or low and high, never under the crawl delay. share: 0 to 1 of the way."""
    a, b = F.coalesce(delay * 0.5, low), F.coalesce(delay * 1.5, high)
    return F.greatest(a + share * (b - a), floor)
