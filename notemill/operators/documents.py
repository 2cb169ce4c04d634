"""Documents to notes: slides, notebooks, PDF text, formatting in chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions import text as tx

# The first line of a deck's note; titles of a table of contents itself.
NOTE = "<!-- Lição interativa (player de slides): texto coletado slide a slide. -->"
CONTENTS = ("contents", "table of contents", "sumário")
FIND_WITHIN, FIND_CHARS = 6000, 60


# --- slides


def slide_lines(slides: DataFrame, deck: str = "deck", n: str = "n", text: str = "text") -> DataFrame:
    """deck, n, at, line: lines that aren't blank, stripped."""
    lines = slides.select(F.col(deck).alias("deck"), F.col(n).alias("n"), F.posexplode(F.split(text, "\r\n|\r|\n")).alias("at", "raw"))
    return lines.select("deck", "n", "at", tx.strip(F.col("raw")).alias("line")).where("line <> ''")


def chrome(lines: DataFrame) -> DataFrame:
    """deck, line, slides: lines that belong to the player, being on at least 2 and 80 % of a deck's slides."""
    each = lines.select("deck", "n", "line").distinct()
    per = each.groupBy("deck", "line").agg(F.count(F.lit(1)).alias("slides"))
    decks = each.select("deck", "n").distinct().groupBy("deck").agg(F.count(F.lit(1)).alias("pages"))
    return per.where("slides >= 2").join(decks, "deck").where("pages > 1 AND slides >= greatest(2, 0.8D * pages)").select("deck", "line", "slides")


def compose_slides(slides: DataFrame, deck: str = "deck", n: str = "n", text: str = "text") -> DataFrame:
    """deck, markdown: a section a slide that has lines, titled by its `slide:` line or its number among them; each line once, none of the player's."""
    lines = slide_lines(slides, deck, n, text)
    titled = F.lower("line").startswith("slide:")
    order = lines.select("deck", "n").distinct().withColumn("k", F.row_number().over(Window.partitionBy("deck").orderBy("n")))
    own = lines.join(chrome(lines).select("deck", "line", F.lit(True).alias("c")), ["deck", "line"], "left")
    own = own.withColumn("first", F.row_number().over(Window.partitionBy("deck", "n", "line").orderBy("at")) == 1)
    shown = F.when(F.col("c").isNull() & ~titled & F.col("first"), F.struct("at", "line"))
    page = own.groupBy("deck", "n").agg(F.min(F.when(titled, F.struct("at", tx.strip(F.expr("substr(line, 7)")).alias("t")))).alias("title"), F.array_sort(F.collect_list(shown)).alias("body"))
    page = page.join(order, ["deck", "n"])
    section = F.concat(F.lit("## "), F.coalesce("title.t", F.concat(F.lit("Slide "), F.col("k"))), F.lit("\n\n"), F.array_join(F.transform("body", lambda x: x["line"]), "\n\n"))
    out = page.groupBy("deck").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", section.alias("s")))), lambda x: x["s"]), "\n\n").alias("all"))
    return out.select("deck", F.concat(F.lit(NOTE + "\n\n"), "all", F.lit("\n")).alias("markdown"))


# --- notebooks

NOTEBOOK = "metadata struct<language_info:struct<name:string>>, cells array<struct<cell_type:string,source:variant>>"


def notebook_markdown(raw: Column) -> Column:
    """Markdown and code cells in order; outputs and raw cells go. Null for what isn't a notebook."""
    book = F.from_json(raw, NOTEBOOK)
    language = F.coalesce(F.nullif(book["metadata"]["language_info"]["name"], F.lit("")), F.lit("python"))

    def cell(c):
        # a source is a string or a list of strings
        parts = F.try_variant_get(c["source"], "$", "array<string>")
        source = F.coalesce(F.array_join(parts, ""), F.try_variant_get(c["source"], "$", "string"), F.lit(""))
        kept = tx.strip(source)
        code = F.concat(F.lit("```"), language, F.lit("\n"), kept, F.lit("\n```"))
        return F.when(kept == "", None).when(c["cell_type"] == "markdown", tx.strip(tx.notebook_images(source))).when(c["cell_type"] == "code", code)

    return F.when(book["cells"].isNotNull(), F.concat(F.array_join(F.filter(F.transform(book["cells"], cell), lambda x: x.isNotNull()), "\n\n"), F.lit("\n")))


# --- PDF text


def pdf_single(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """doc, body: the pages that have text, each under its number; null body where none has."""
    shown = F.when(F.col(text) != "", F.struct(F.col(page).alias("p"), F.concat(F.lit("<!-- página "), F.col(page), F.lit(" -->\n\n"), F.col(text)).alias("s")))
    out = pages.groupBy(F.col(doc).alias("doc")).agg(F.array_sort(F.collect_list(shown)).alias("x"))
    return out.select("doc", F.nullif(F.array_join(F.transform("x", lambda x: x["s"]), "\n\n"), F.lit("")).alias("body"))


def pdf_sections(pages: DataFrame, outline: DataFrame, max_depth: int = 1) -> DataFrame:
    """pages: doc, page (from 0), text; outline: doc, seq, depth, title, page. Gives doc, seq, titles, positions, body.

    A section begins where its title is found within FIND_WITHIN characters of its page's start, else at the page, never
    before the section in front of it, and goes on to the next. A title is sought in a head of its page, which is the
    beginnings of as many pages as those characters take; sections are put together from cuts of pages. Beside positions
    no text is moved but a head a page and each page once."""
    by_page = Window.partitionBy("doc").orderBy("page")
    size = F.char_length("text") + 2  # an empty line follows each page
    placed = pages.select("doc", "page", "text", (F.sum(size).over(by_page) - size).alias("begin"), size.alias("size"))
    placed = placed.withColumn("head", F.array_join(F.collect_list(F.concat(F.substring("text", 1, FIND_WITHIN), F.lit("\n\n"))).over(Window.partitionBy("doc").orderBy("begin").rangeBetween(0, FIND_WITHIN - 1)), ""))
    marks = outline.where((F.col("depth") <= max_depth) & ~F.lower("title").isin(*CONTENTS))
    ends = pages.groupBy("doc").agg(F.sum(size).alias("total"), F.count(F.lit(1)).alias("n_pages"))
    known = marks.join(ends, "doc").join(placed.select("doc", "page", "begin", "head"), ["doc", "page"], "left")
    at = F.instr(F.lower(F.substring("head", 1, FIND_WITHIN)), F.substring(F.lower("title"), 1, FIND_CHARS))
    begin = F.coalesce("begin", "total")  # of a page beyond the last one: the end
    found = known.select("doc", "seq", "depth", "title", "total", (begin + F.greatest(F.coalesce(at, F.lit(0)) - 1, F.lit(0))).alias("found"))
    by_seq = Window.partitionBy("doc").orderBy("seq")
    cuts = found.withColumn("cut", F.max("found").over(by_seq.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = numbered_outline(cuts.select("doc", "seq", "depth", "title", "cut"), max_depth + 1)

    # where cuts fall among pages: of pages the section that goes on, of cuts the page they are in
    nothing = F.lit(None)
    both = placed.select("doc", F.col("begin").alias("at"), F.lit(1).alias("kind"), "page", nothing.cast(cuts.schema["seq"].dataType).alias("seq"))
    both = both.union(cuts.select("doc", F.col("cut").alias("at"), F.lit(2).alias("kind"), nothing.cast(placed.schema["page"].dataType).alias("page"), "seq"))
    along = Window.partitionBy("doc").orderBy("at", "kind", "seq")
    both = both.withColumns({"seq": F.last("seq", ignorenulls=True).over(along), "page": F.last("page", ignorenulls=True).over(along)})
    inside = both.groupBy("doc", "page").agg(F.max(F.when(F.col("kind") == 1, F.struct("at", "seq"))).alias("goes_on"), F.array_sort(F.collect_list(F.when(F.col("kind") == 2, F.struct("at", "seq")))).alias("cut"))
    # each page becomes the piece that goes on and one from each cut to the next
    starts = F.concat(F.array_compact(F.array("goes_on")), "cut")
    pieces = placed.select("doc", "page", "text", "begin", "size").join(inside.select("doc", "page", starts.alias("starts")), ["doc", "page"])
    piece = F.transform(F.col("starts"), lambda x, i: F.struct(x["seq"].alias("seq"), x["at"].alias("at"), (F.coalesce(F.try_element_at("starts", i + 2)["at"], F.col("begin") + F.col("size")) - x["at"]).alias("n")))
    pieces = pieces.select("doc", "text", "begin", F.explode(piece).alias("x")).where("x.seq IS NOT NULL AND x.n > 0")
    pieces = pieces.select("doc", F.col("x.seq").alias("seq"), F.col("x.at").alias("at"), F.expr("substr(concat(text, '\n\n'), CAST(x.at - begin + 1 AS INT), CAST(x.n AS INT))").alias("s"))
    bodies = pieces.groupBy(F.col("doc").alias("d"), F.col("seq").alias("q")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]), "").alias("body"))
    out = cuts.join(bodies, (F.col("doc") == F.col("d")) & (F.col("seq") == F.col("q")), "left")
    return out.select("doc", "seq", "titles", "positions", tx.strip(F.coalesce("body", F.lit(""))).alias("body"))


def numbered_outline(marks: DataFrame, levels: int) -> DataFrame:
    """marks (doc, seq, depth from 0, and others) with titles and positions from the top, for depths below levels.

    A mark lies one level below the one before it at most, so its level is the least of depth and of how far marks have
    come: a running minimum of depth less place. The path is the last title of each level up to its own; a position is
    the number of marks of its level since the last one of the level above, a difference of running counts."""
    by = Window.partitionBy("doc").orderBy("seq")
    up_to = by.rowsBetween(Window.unboundedPreceding, 0)
    place = marks.withColumn("_k", F.row_number().over(by) - 1)
    own = place.withColumn("_level", (F.col("_k") + F.least(F.lit(0), F.min(F.col("depth") - F.col("_k")).over(up_to))).cast("int"))
    here = [F.col("_level") == k for k in range(levels)]
    own = own.withColumns({f"_n{k}": F.count(F.when(here[k], 1)).over(up_to) for k in range(levels)} | {f"_t{k}": F.last(F.when(here[k], F.col("title")), ignorenulls=True).over(up_to) for k in range(levels)})
    since = {f"_b{k}": F.coalesce(F.last(F.when(here[k - 1], F.col(f"_n{k}")), ignorenulls=True).over(up_to), F.lit(0)) if k else F.lit(0) for k in range(levels)}
    own = own.withColumns(since)
    path = F.array(*(F.col(f"_t{k}") for k in range(levels)))
    position = F.array(*((F.col(f"_n{k}") - F.col(f"_b{k}")).cast("int") for k in range(levels)))
    depth = F.col("_level") + 1
    return own.select(*(c for c in marks.columns if c not in ("depth", "title")), F.slice(path, 1, depth).alias("titles"), F.slice(position, 1, depth).alias("positions"))


def section_status(body: Column) -> Column:
    """ok, or the error of a section with fewer than three words."""
    words = F.size(F.filter(F.split(body, tx.rx(r"\s+")), lambda w: w != ""))
    return F.when(words < 3, "ValueError: seção sem texto").otherwise("ok")


# --- chunks of texts that come in parts


def chunked(parts: DataFrame, key: str, at: str = "at", text: str = "text", limit: int = 30000) -> DataFrame:
    """key, chunk (from 0), text: a key's parts, joined in the order of at, cut as tx.chunks() cuts the whole text; a key
    whose parts are all null has none. Each part has to end in a line end, so that no heading lies across two.

    No key's text is put together: where cuts fall follows from the lengths of blocks, which alone are read in a key's
    order; texts move once to the other parts of their place and once to their chunk."""
    place = F.struct(F.col(key).alias("key"), F.col(at).alias("at")).alias("place")
    own = parts.where(F.col(text).isNotNull()).groupBy(place).agg(F.array_join(F.array_sort(F.collect_list(text)), "").alias("text"))
    own = own.select("place", tx.blocks(F.col("text")).alias("blocks"))
    goes_on = ~F.element_at("blocks", 1).rlike("^#{1,2} ")  # what a part begins with belongs to the block before it
    lengths = own.select("place", F.transform("blocks", F.char_length).alias("sizes"), goes_on.alias("goes_on")).repartition("place.key").sortWithinPartitions("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last, chunk, size, block = [], [], 0, 0, []  # block: what the open one has, as the length and the row of each piece

        def closed() -> None:
            nonlocal chunk, size
            n = sum(x for x, _ in block)
            if size and size + n > limit:
                chunk, size = chunk + 1, 0
            size += n
            for _, cuts in block:
                cuts.append(chunk)
            block.clear()

        def batch(n: int, kind: pa.DataType) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows[:n]], kind), pa.array([x[1] for x in rows[:n]], pa.list_(pa.int64()))], names=["to", "chunks"])
            del rows[:n]
            return out

        for b in batches:
            kind = b.column(0).type
            for place, sizes, on in zip(*(c.to_pylist() for c in b.columns)):
                if last != [place["key"]]:
                    closed()
                    last, chunk, size = [place["key"]], 0, 0
                rows.append((place, cuts := []))
                for k, n in enumerate(sizes):
                    if k or not on:
                        closed()
                    block.append((n, cuts))
            yield batch(len(rows) - len(block), kind)  # each piece of the open block is the last of its row
        closed()
        if rows:
            yield batch(len(rows), kind)

    placed = lengths.mapInArrow(run, f"to {lengths.schema['place'].dataType.simpleString()}, chunks array<long>")
    rows = own.join(placed, F.col("place") == F.col("to")).select("place", F.posexplode(F.arrays_zip("blocks", "chunks")).alias("i", "x"))
    whole = rows.groupBy(F.col("place.key").alias("key"), F.col("x.chunks").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("place.at", "i", F.col("x.blocks").alias("s")))).alias("x"))
    return whole.select(F.col("key").alias(key), "chunk", F.array_join(F.transform("x", lambda r: r["s"]), "").alias("text"))


def joined_sha1(parts: DataFrame, key: str, at: str = "chunk", text: str = "text") -> DataFrame:
    """key, digest: SHA-1 of a key's texts joined in the order of at. The hash goes on from row to row, in bounded memory."""
    rows = parts.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(text).alias("text")).repartition("key").sortWithinPartitions("key", "at")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(k, digest):
            return pa.RecordBatch.from_arrays([pa.array([k], kept), pa.array([digest.hexdigest()])], names=["key", "digest"])

        last, digest, kept = [], None, None
        for b in batches:
            kept = b.column(0).type
            for k, s in zip(b.column(0).to_pylist(), b.column(2)):
                if last != [k]:
                    if last:
                        yield row(last[0], digest)
                    last, digest = [k], hashlib.sha1()
                if s.is_valid:
                    digest.update(s.as_buffer())
        if last:
            yield row(last[0], digest)

    return rows.mapInArrow(run, f"key {kind}, digest string").withColumnRenamed("key", key)


# --- formatting with a model


def formatted(notes: DataFrame, model: Callable[[str, str], str], key: str = "file", note: str = "note", limit: int = 30000) -> DataFrame:
    """notes with formatted (front matter kept, the body's chunks through model(title, chunk)) and error (type of the exception, or null)."""
    front, body = tx.front_of(F.col(note)), tx.body_of(F.col(note))
    stem = F.regexp_replace(F.regexp_extract(F.col(key), r"([^/]*)$", 1), r"\.[^.]*$", "")
    parts = notes.select(key, front.alias("front"), tx.front_title(F.col(note), stem).alias("title"), tx.chunks(body, limit).alias("chunks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, errors = [], []
            for front, title, chunks in zip(b["front"], b["title"], b["chunks"]):
                try:
                    out.append(front + "\n\n".join(model(title, c) for c in chunks).strip() + "\n")
                    errors.append(None)
                except Exception as e:  # a model may raise anything; one file's failure isn't the others'
                    out.append(None)
                    errors.append(f"erro: {type(e).__name__}")
            yield pd.DataFrame({key: b[key], "formatted": out, "error": errors})

    return parts.mapInPandas(run, f"{key} {notes.schema[key].dataType.simpleString()}, formatted string, error string")
