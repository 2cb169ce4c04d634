"""Runs, queues and schedules."""

from __future__ import annotations

import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.functions import text as tx
from notemill.functions import urls
from notemill.operators.toc import carried

DONE = " — concluído"
RUN = r"^[0-9]{8}-[0-9]{6}$"
_ITEM = r"^- \[( |x|!)\] (\S+)(.*)$"
_CLAIM = r"^- \[>\] (\S+)(.*) — em andamento \(pid ([0-9]+)\)$"
_RESULT = r"(?m)([0-9]+)/([0-9]+) item\(ns\) extraído\(s\) em (.+)$"


def run_summary(items: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """ok, total and the exit code: 0 if all are ok, else 2."""
    out = items.groupBy(*by).agg(F.count_if(F.col(status) == "ok").alias("ok"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("exit_code", F.when(F.col("ok") == F.col("total"), 0).otherwise(2))


def tolerated(ok: Column, total: Column, code: Column) -> Column:
    """A run that failed counts as done if few are missing: 5, or 1 %."""
    missing = total - ok
    return (code == 0) | ((missing > 0) & (missing <= F.greatest(F.lit(5), F.floor(total / 100))))


def same_url(url: Column) -> Column:
    """Addresses that differ in slashes at the end are one."""
    return F.regexp_replace(url, "/+$", "")


def latest_run(runs: DataFrame, by: list[str], run: str = "run_id") -> DataFrame:
    return runs.where(F.col(run).rlike(RUN)).groupBy(*by).agg(F.max(run).alias(run))


def latest_complete(items: DataFrame, url: str = "url", run: str = "run_id", status: str = "status") -> DataFrame:
    """url, run: of each address the latest run that has items, all of them ok."""
    each = items.groupBy(same_url(F.col(url)).alias("url"), run).agg(F.bool_and(F.col(status) == "ok").alias("ok"))
    return each.where("ok").groupBy("url").agg(F.max(run).alias(run))


def resume(plan: DataFrame, done: DataFrame, key: str = "url", status: str = "status", seq: str = "seq") -> DataFrame:
    """What is still to do: not in the last run's ok items. Numbers stay as planned."""
    return plan.join(done.where(F.col(status) == "ok").select(key).distinct(), key, "left_anti")


def queue_state(lines: DataFrame, seq: str = "seq", line: str = "line", queue: str = "queue") -> DataFrame:
    """lines with grp, mark, url, args, pid: the group is the last header above, within a queue."""
    text = F.col(line)
    header = F.when(text.startswith("## "), F.nullif(tx.strip(F.regexp_replace(F.expr(f"substr({line}, 4)"), DONE + "$", "")), F.lit("")))
    # an empty header ends a group too, so headers are told apart from other lines
    named = F.when(text.startswith("## "), F.struct(header.alias("g")))
    lines = carried(lines.withColumn("_named", named), queue, seq, "_named", "_group")
    claim = text.rlike(_CLAIM)
    part = lambda k, c: F.when(claim, F.regexp_extract(text, _CLAIM, c)).otherwise(F.regexp_extract(text, _ITEM, k))
    return lines.withColumns({
        "grp": F.col("_group.g"),
        "mark": F.nullif(F.regexp_extract(text, r"^- \[(.)\] ", 1), F.lit("")),
        "url": F.nullif(part(2, 1), F.lit("")),
        "args": F.when(claim, tx.strip(F.regexp_extract(text, _CLAIM, 2))).otherwise(tx.line_args(F.regexp_extract(text, _ITEM, 3))),
        "pid": F.expr("try_cast(nullif(regexp_extract(" + line + r", '^- \\[>\\] \\S+.* — em andamento \\(pid ([0-9]+)\\)$', 1), '') AS BIGINT)"),
    }).drop("_named", "_group")


def pending(state: DataFrame, live: DataFrame, groups: str | None = None, line: str = "line") -> DataFrame:
    """Items to do: open ones, failed ones without a partial result, and those that a dead process claimed. live: pid."""
    ids = live.select(F.col("pid").alias("_pid"), F.lit(True).alias("_alive")).distinct()
    met = state.where("grp IS NOT NULL AND url IS NOT NULL").join(ids, F.col("pid") == F.col("_pid"), "left")
    partial = F.col(line).contains("lições")
    todo = (F.col("mark") == " ") | ((F.col("mark") == "!") & ~partial) | ((F.col("mark") == ">") & F.col("pid").isNotNull() & F.col("_alive").isNull())
    out = met.where(todo).drop("_pid", "_alive")
    return out.where(F.col("grp").rlike(tx.rxi(groups))) if groups else out


def group_done(marks: DataFrame, by: list[str], mark: str = "mark") -> DataFrame:
    """done: at least one item is, and the others are or are skipped."""
    m = F.col(mark)
    return marks.groupBy(*by).agg((F.bool_or(m == "x") & F.bool_and(m.isin("x", "-"))).alias("done"))


def host_waves(queue: DataFrame, host: str = "host", seq: str = "seq") -> DataFrame:
    """wave: items of one host never share one."""
    return queue.withColumn("wave", F.row_number().over(Window.partitionBy(host).orderBy(seq)))


def copy_or_run(args: Column, complete_in: Column, group: Column) -> Column:
    return F.when(args != "", "run").when(complete_in.isNull(), "run").when(complete_in == group, "already").otherwise("copy")


def rewritten(lines: DataFrame, old: str, new: str, seq: str = "seq", line: str = "line") -> DataFrame:
    """The first line that equals old becomes new."""
    first = lines.where(F.col(line) == old).agg(F.min(seq).alias("_first"))
    # one row
    return lines.join(F.broadcast(first), F.lit(True)).withColumn(line, F.when(F.col(seq) == F.col("_first"), F.lit(new)).otherwise(F.col(line))).drop("_first")


def result_of(log: Column) -> Column:
    """struct(ok, total, folder) of a log, null where it tells none."""
    part = lambda k: F.regexp_extract(log, _RESULT, k)
    return F.when(log.rlike(_RESULT), F.struct(part(1).cast("int").alias("ok"), part(2).cast("int").alias("total"), tx.strip(part(3)).alias("folder")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def arguments(args: pd.Series) -> pd.Series:
    """The words of a command line as a shell reads it, quotes and all; null for a null and for a quote that isn't closed."""

    def words(line: str | None) -> list[str] | None:
        try:
            return None if line is None else shlex.split(line)
        except ValueError:
            return None

    return args.map(words)


def command(url: Column, args: Column) -> Column:
    """The command that a line names, else that of its address."""
    first = F.try_element_at(arguments(args), F.lit(1))
    return F.when(first.isin("extract", "help", "page", "site", "repo", "pdf", "zendesk"), first).otherwise(urls.command_for(url))


def numbered_folders(courses: DataFrame, root: str, seq: str, slug: str, url: str) -> DataFrame:
    """folder number of each course within root, from 0: that of the first course of the same slug or the same address.

    A course's group is the least of the firsts by slug and by address; groups are numbered by that first."""
    one = courses.withColumn("_s", F.min(seq).over(Window.partitionBy(root, slug))).withColumn("_u", F.min(seq).over(Window.partitionBy(root, same_url(F.col(url)))))
    one = one.withColumn("_first", F.least("_s", "_u"))
    return one.withColumn("number", F.dense_rank().over(Window.partitionBy(root).orderBy("_first")) - 1).drop("_s", "_u", "_first")
