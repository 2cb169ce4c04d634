"""Choosing the best of several, and states over observations in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.session import staged


def menu_score(items: Column, title_chars: Column, text_chars: Column) -> Column:
    """Of a container with items links: many short titles that make up its text. Null under two items."""
    share = F.least(F.lit(1.0), 1.5 * title_chars / F.greatest(text_chars, F.lit(1)))
    short = F.when(title_chars / items <= 80, 1.0).otherwise(0.5)
    return F.when(items >= 2, items * share * short)


def content_score(length: Column, nav_length: Column, wraps_nav: Column, is_body: Column) -> Column:
    less = F.when(wraps_nav, length - nav_length).otherwise(length)
    return less * F.when(wraps_nav, 0.6).otherwise(1.0) * F.when(is_body, 0.6).otherwise(1.0)


def best(df: DataFrame, by: list[str], score: str, seq: str) -> DataFrame:
    """The row of highest score of each group, of equal ones the first: an aggregation, not a sort."""
    cols = df.columns
    picked = df.where(F.col(score).isNotNull()).groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct(score, (-F.col(seq)).alias("first"))).alias("won"))
    return picked.select(*(F.col(f"won.{c}") for c in cols))


def menu_items(items: DataFrame, noise: tuple[str, ...]) -> DataFrame:
    """items: scope, seq, title, visible, wrapper. Those that can be entries: visible, no wrapper, 2 to 140 characters, no control, a title once."""
    ok = items.where(F.col("visible") & ~F.col("wrapper") & F.char_length("title").between(2, 140) & ~F.lower("title").isin(*noise))
    return ok.withColumn("_n", F.row_number().over(Window.partitionBy("scope", "title").orderBy("seq"))).where("_n = 1").drop("_n")


def innermost(items: DataFrame, panels: DataFrame, key: str = "item") -> DataFrame:
    """items: item, lo, hi; panels: scope, panel, lo, hi (of items: scope too). Each item with the smallest panel around it, null if none.

    A panel around an item holds the item's lo, so it is dealt to the strips of places that it covers, strips as wide as
    the panel to a power of two: each panel lies in two strips at most, and an item looks into one strip of each width."""
    width = F.ceil(F.log2(F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))).cast("int")
    p = panels.select(F.col("scope").alias("_s"), "panel", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), width.alias("_w"))
    strip = lambda c, w: F.expr(f"shiftright(CAST({c} AS BIGINT), {w})")
    p = p.withColumn("_k", F.explode(F.array_distinct(F.array(strip("_lo", "_w"), strip("_hi", "_w")))))
    widths = p.select(F.col("_s").alias("_ws"), F.col("_w").alias("_iw")).distinct()  # some tens a scope at most
    seek = items.join(widths, F.col("scope") == F.col("_ws"), "left").withColumn("_ik", strip("lo", "_iw"))
    met = seek.join(p, (F.col("scope") == F.col("_s")) & (F.col("_iw") == F.col("_w")) & (F.col("_ik") == F.col("_k")) & (F.col("_lo") < F.col("lo")) & (F.col("_hi") > F.col("hi")), "left")
    return met.groupBy("scope", key).agg(F.min_by("panel", F.col("_hi") - F.col("_lo")).alias("parent"))


def narrowed(containers: DataFrame, rounds: int = 64) -> DataFrame:
    """containers: menu, container, inner (null at the innermost), left_out (links outside inner), buttons (those of them that
    are calls to action). Gives menu, container: a menu moves into its inner container while the one or two links left
    out are all buttons. The chain is followed from each menu's outermost container, all menus a round; containers that
    lie deeper inside each other than rounds are an error, never a result halfway."""
    steps = containers.where((F.col("left_out").between(1, 2)) & (F.col("left_out") == F.col("buttons")) & F.col("inner").isNotNull()).select("menu", F.col("container").alias("_at"), F.col("inner").alias("_to"))
    inner = containers.where("inner IS NOT NULL").select("menu", F.col("inner").alias("container"))
    now = containers.select("menu", "container").join(inner, ["menu", "container"], "left_anti")
    for _ in range(rounds):
        met = now.join(steps, (now["menu"] == steps["menu"]) & (now["container"] == steps["_at"]), "left").select(now["menu"], F.coalesce("_to", "container").alias("container"), F.col("_to").isNotNull().alias("moved"))
        met = staged(met, "narrowed")
        if met.where("moved").isEmpty():
            return met.select("menu", "container")
        now = met.select("menu", "container")
    raise RuntimeError(f"containers lie deeper than {rounds} inside each other, or in a circle")


def _class_says(classes: Column, word: str) -> Column:
    return F.coalesce(classes, F.lit("")).rlike(rf"(^|\s)(is-)?{word}(\s|$)")


def group_state(found: Column, details_open: Column, expanded: Column, data_state: Column, summary_open: Column, classes: Column) -> Column:
    """open, closed, unknown or missing, by the first sign there is: a <details>, aria-expanded, data-state, the <details>
    around a <summary>, a class. Signs that an element doesn't have are null."""
    told = lambda c: F.when(c, "open").when(~c, "closed")
    return F.when(~found, "missing").otherwise(
        F.coalesce(
            told(details_open),
            F.when(expanded == "true", "open").when(expanded == "false", "closed"),
            F.when(data_state.isin("open", "expanded"), "open").when(data_state.isin("closed", "collapsed"), "closed"),
            told(summary_open),
            F.when(_class_says(classes, "collapsed"), "closed").when(_class_says(classes, "expanded"), "open"),
            F.lit("unknown"),
        )
    )


def is_group(expanded: Column, summary: Column, data_state: Column, popup: Column, classes: Column, configured: Column, sublist: Column) -> Column:
    """Whether an entry opens others: by an attribute, a tag, a class, a setting, or a list beside it, hidden or not."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    state = yes(data_state.isin("open", "closed", "expanded", "collapsed"))
    return expanded.isNotNull() | yes(summary) | state | yes((popup != "") & (popup != "false")) | _class_says(classes, "(collapsed|expanded)") | yes(configured) | yes(sublist)


def stable_at(obs: DataFrame, item: str, order: list[str], value: str, loading: str) -> DataFrame:
    """item, value, order columns of the first reading of each item that equals the reading before it, loading ones left out."""
    by = Window.partitionBy(item).orderBy(*order)
    ready = obs.where(~F.col(loading)).withColumn("_before", F.lag(value).over(by))
    hit = ready.where(F.col("_before") == F.col(value))
    return hit.groupBy(item).agg(F.min(F.struct(*order, value)).alias("k")).select(item, *(F.col(f"k.{c}").alias(c) for c in (*order, value)))


def three_alike(obs: DataFrame, item: str, order: list[str], values: list[str]) -> DataFrame:
    """The first reading of each item that equals the two before it."""
    by = Window.partitionBy(item).orderBy(*order)
    v = F.struct(*values)
    seen = obs.withColumn("_a", F.lag(v, 1).over(by)).withColumn("_b", F.lag(v, 2).over(by))
    hit = seen.where((F.col("_a") == v) & (F.col("_b") == v))
    return hit.groupBy(item).agg(F.min(F.struct(*order, *values)).alias("k")).select(item, *(F.col(f"k.{c}").alias(c) for c in (*order, *values)))


def transition(new_tab: Column, url_changed: Column, button_gone: Column, changed: Column) -> Column:
    return F.when(new_tab, "tab").when(url_changed, "url").when(button_gone & changed, "content")
