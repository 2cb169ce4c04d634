import pytest
from pyspark.sql import functions as F

from notemill.functions import text as tx
from notemill.functions import urls
from notemill.operators import batch, documents, robots, toc


def one(spark, col, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(col.alias("out")).first()[0]


@pytest.mark.parametrize(
    ("text", "limit", "slug"),
    [("Visão geral — IA", 70, "visao-geral-ia"), ("", 70, "sem-titulo"), ("¿¡!", 70, "sem-titulo"), ("um dois três quatro", 10, "um-dois"), ("abcdefghijklmno", 10, "abcdefghij"), ("um dois-tres", 7, "um-dois"), ("straße ÇA", 70, "stra-e-ca")],
)
def test_slug(spark, text, limit, slug):
    assert one(spark, tx.slugify(F.col("t"), limit), t=text) == slug


@pytest.mark.parametrize(
    ("tab", "heading", "title"),
    [("Project Syste… | Site", "Project System  in depth", "Project System in depth"), ("Curso | Site", "Outro", "Curso"), ("", "Só o título", "Só o título"), ("Curso", "", "Curso")],
)
def test_pick_title(spark, tab, heading, title):
    assert one(spark, tx.pick_title(F.col("a"), F.col("b")), a=tab, b=heading) == title


def test_chunks_join_to_the_text(spark):
    text = "intro\n" + "".join(f"# Seção {k}\n" + "x" * 1500 + "\n" for k in range(6))
    parts = one(spark, tx.chunks(F.col("t"), 4000), t=text)
    assert "".join(parts) == text and len(parts) > 1 and all(len(p) <= 4000 for p in parts)
    assert one(spark, tx.chunks(F.col("t"), 4000), t="# a\nb") == ["# a\nb"]


def test_parts_are_cut_as_the_whole_text(spark):
    """The same chunks as of the joined text, which no row ever holds."""
    parts = [(k, n, f"{'#' * (n % 4)} T {n}\n" + "é" * (n * 37 % 90) + ("\n## S\n" + "y" * (n * 53 % 70) if n % 3 else "") + "\n") for k in ("a", "b", None) for n in range(40)]
    parts += [("b", 7, "again\n"), ("b", 41, None), ("long", 1, "z" * 300 + "\n"), ("long", 2, "# z\n"), ("short", 3, "s\n"), ("null", 1, None), ("empty", 1, "")]
    frame = spark.createDataFrame(parts, "k string, at long, text string").repartition(5)
    got = documents.chunked(frame, "k", limit=120)
    assert {(r.k, r.chunk): r.text for r in got.collect()} == {(r.k, r.chunk): r.s for r in whole_texts(frame).select("k", F.posexplode(tx.chunks(F.col("text"), 120)).alias("chunk", "s")).collect()}
    assert {r.k: r.digest for r in documents.joined_sha1(got, "k").collect()} == {r.k: r.d for r in whole_texts(frame).select("k", F.sha1("text").alias("d")).collect()}


def whole_texts(parts):
    one = parts.where("text IS NOT NULL").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"))
    return one.select("k", F.array_join(F.transform("x", lambda r: r["text"]), "").alias("text"))


def test_clean_markdown(spark):
    out = one(spark, tx.clean_markdown(F.col("t")), t="---\ntitle: 'A b'\n---\n> ## Documentation Index\n> llms.txt\n\n# A b [[a-b]]\ntext\n")
    assert out["title"] == "A b" and out["body"] == "# A b\ntext\n"
    assert one(spark, tx.clean_markdown(F.col("t")), t="> note\n\n# T\n")["body"] == "> note\n\n# T\n"


def test_default_prefix(spark):
    for url, prefix in (("https://a.com/g/what.html?x#y", "https://a.com/g/"), ("https://a.com/g/", "https://a.com/g/"), ("https://a.com", "https://")):
        assert one(spark, urls.default_prefix(F.col("u")), u=url) == prefix


def test_help_parts(spark):
    out = one(spark, urls.help_parts(F.col("u")), u="https://help.sap.com/viewer/d1/2.0/de-DE/t1.html")
    assert tuple(out) == ("r", "d1", "t1", "2.0", "de-DE")
    assert tuple(one(spark, urls.help_parts(F.col("u")), u="https://help.sap.com/docs/A%20B+C/D")) == ("A B+C", "D", "", "LATEST", "en-US")
    assert one(spark, urls.help_parts(F.col("u")), u="https://example.com/docs/A/D") is None


def test_robots(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: notemill\nDisallow: /a\nAllow: /a\nDisallow: /*.pdf$\nCrawl-delay: 3\n"
    rules = robots.parse(spark.createDataFrame([("h", text)], "host string, text string"))
    pages = spark.createDataFrame([(0, "h", "http://h/a"), (1, "h", "http://h/x.pdf"), (2, "h", "http://h/x.pdf?y"), (3, "h", "http://h/"), (4, "other", "http://o/")], "page_id int, host string, url string")
    got = {r.page_id: r.allowed for r in robots.evaluate(pages, rules).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: True}
    assert rules.where("pattern IS NULL").first().crawl_delay == 3


def test_json_toc(spark):
    body = '{"items": [{"toc_title": "A", "href": "a.html"}, {"title": "Out", "href": "https://x.org/"}, {"name": "B", "children": [{"title": "C", "href": "c.html"}, 5]}, "z"]}'
    tocs = spark.createDataFrame([(1, "https://h/g/", body), (2, "https://h/g/", "<html>")], "toc_id int, base string, body string")
    got = sorted((list(r.positions), r.titles[-1], r.url, r.has_children) for r in toc.json_toc(tocs, "https://h/g/").collect())
    assert got == [([1], "A", "https://h/g/a.html", False), ([2], "B", "", True), ([2, 1], "C", "https://h/g/c.html", False)]


def test_menu_paths_end_at_circles(spark):
    nav = spark.createDataFrame([(1, None, 1, "a"), (2, 1, 2, "b"), (3, 2, 3, "c"), (4, 5, 4, "d"), (5, 4, 5, "e"), (6, 6, 6, "f")], "id int, parent int, seq int, title string")
    got = {r.id: r.path for r in toc.menu_paths(nav).collect()}
    assert got[3] == ["a", "b", "c"] and got[6] == ["f"] and got[4][-1] == "d" and got[5][-1] == "e"


def test_notebook(spark):
    raw = '{"metadata": {"language_info": {"name": "sql"}}, "cells": [{"cell_type": "markdown", "source": ["# T\\n", "![a](attachment:x.png)"]}, {"cell_type": "code", "source": "select 1\\n", "outputs": [1]}, {"cell_type": "raw", "source": "no"}, {"cell_type": "code", "source": []}]}'
    assert one(spark, documents.notebook_markdown(F.col("t")), t=raw) == "# T\n<!-- Imagem presente aqui: a -->\n\n```sql\nselect 1\n```\n"
    assert one(spark, documents.notebook_markdown(F.col("t")), t="no json") is None


def test_slides(spark):
    rows = [("d", 1, "Menu\nSlide: One\nx\nx\n"), ("d", 2, "Menu\n\n"), ("d", 3, "Menu\ny"), ("d", 4, " \n")]
    out = documents.compose_slides(spark.createDataFrame(rows, "deck string, n int, text string")).first().markdown
    assert out == documents.NOTE + "\n\n## One\n\nx\n\n## Slide 2\n\n\n\n## Slide 3\n\ny\n"


def test_pdf_sections(spark):
    pages = spark.createDataFrame([("b", 0, "Cover"), ("b", 1, "First part here. Second part there.")], "doc string, page int, text string")
    marks = spark.createDataFrame([("b", 0, 0, "Contents", 0), ("b", 1, 0, "First part", 1), ("b", 2, 1, "second part", 1), ("b", 3, 0, "Lost", 9)], "doc string, seq int, depth int, title string, page int")
    got = [(list(r.titles), list(r.positions), r.body) for r in documents.pdf_sections(pages, marks).orderBy("seq").collect()]
    assert got == [(["First part"], [1], "First part here."), (["First part", "second part"], [1, 1], "Second part there."), (["Lost"], [2], "")]


def test_format_isolates_failures(spark):
    def model(title, chunk):
        if "bad" in chunk:
            raise ValueError("no")
        return f"{title}:{chunk.upper()}"

    notes = spark.createDataFrame([("a/x.md", '---\ntitle: "T"\n---\n\nbody'), ("a/y.md", "bad")], "file string, note string")
    got = {r.file: (r.formatted, r.error) for r in documents.formatted(notes, model).collect()}
    assert got == {"a/x.md": ('---\ntitle: "T"\n---\n\nT:BODY\n', None), "a/y.md": (None, "erro: ValueError")}


def test_queue(spark):
    lines = ["- [ ] https://lost", "## G1 — concluído", "- [ ] https://a --x 1 — note", "- [!] https://b — 3/5 lições", "- [!] https://c", "- [>] https://d site — em andamento (pid 7)", "- [>] https://e — em andamento (pid 8)", "- [x] https://f", "## "]
    df = spark.createDataFrame([(0, k, x) for k, x in enumerate(lines)], "queue int, seq int, line string")
    live = spark.createDataFrame([(8,)], "pid long")
    got = sorted((r.seq, r.grp, r.url, r.args) for r in batch.pending(batch.queue_state(df), live).collect())
    assert got == [(2, "G1", "https://a", "--x 1"), (4, "G1", "https://c", ""), (5, "G1", "https://d", "site")]
