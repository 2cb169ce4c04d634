"""Operators against plain versions of their own, and where they end: circles, depth, odd input."""

import random

import pytest
from pyspark.sql import functions as F

from notemill.functions import html
from notemill.operators import batch, crawl, documents, notes, scoring, toc
from notemill.sources import files


def outline_by_hand(marks):
    """Titles and positions, one mark after the other."""
    out, path = [], []  # path: [title, position, children so far]
    top = 0
    for depth, title in marks:
        path = path[:depth]
        if path:
            path[-1][2] += 1
            n = path[-1][2]
        else:
            top += 1
            n = top
        path = [*path, [title, n, 0]]
        out.append(([t for t, _, _ in path], [n for _, n, _ in path]))
    return out


def test_outline(spark):
    rng = random.Random(1)
    docs = {d: [(rng.randrange(4), f"t{k}") for k in range(rng.randrange(1, 30))] for d in range(12)}
    rows = [(d, k, depth, t) for d, marks in docs.items() for k, (depth, t) in enumerate(marks)]
    got = documents.numbered_outline(spark.createDataFrame(rows, "doc int, seq int, depth int, title string"), 4).orderBy("doc", "seq").collect()
    want = [x for marks in docs.values() for x in outline_by_hand(marks)]
    assert [(r.titles, r.positions) for r in got] == want


def test_pdf_sections(spark):
    rng = random.Random(2)
    pages, marks, want = [], [], {}
    for doc in range(6):
        texts = ["".join(rng.choice("ab éÉ\n") for _ in range(rng.choice((0, 3, 50, 900, 7000)))).strip() for _ in range(rng.randrange(1, 9))]
        whole, offsets = "", []
        for t in texts:
            offsets.append(len(whole))
            whole += t + "\n\n"
        found, last = [], 0
        for k in range(rng.randrange(0, 12)):
            page = rng.randrange(len(texts) + 1)
            at = rng.randrange(max(1, len(whole)))
            title = rng.choice([whole[at : at + 4].strip(), "nowhere", "Contents"]) or "x"
            depth = rng.randrange(3)
            marks.append((doc, k, depth, title, page))
            if depth > 1 or title == "Contents":
                continue
            begin = offsets[page] if page < len(texts) else len(whole)
            hit = whole[begin : begin + documents.FIND_WITHIN].lower().find(title.lower()[:60]) if page < len(texts) else -1
            last = max(last, begin + max(hit, 0))
            found.append((k, last))
        for n, (k, cut) in enumerate(found):
            want[doc, k] = whole[cut : found[n + 1][1] if n + 1 < len(found) else len(whole)].strip()
        pages += [(doc, n, t) for n, t in enumerate(texts)]
    got = documents.pdf_sections(spark.createDataFrame(pages, "doc int, page int, text string"), spark.createDataFrame(marks, "doc int, seq int, depth int, title string, page int"))
    assert {(r.doc, r.seq): r.body for r in got.collect()} == want and len(want) > 10


def test_innermost(spark):
    rng = random.Random(3)
    panels = [(rng.randrange(3), f"p{k}", a, a + rng.randrange(1, 80)) for k in range(120) for a in [rng.randrange(-40, 200)]]
    items = [(rng.randrange(4), k, a, a + rng.randrange(0, 6)) for k in range(150) for a in [rng.randrange(-40, 200)]]
    got = scoring.innermost(spark.createDataFrame(items, "scope int, item int, lo int, hi int"), spark.createDataFrame(panels, "scope int, panel string, lo int, hi int")).collect()
    size = {p: b - a for _, p, a, b in panels}
    assert len(got) == len(items)
    for r in got:
        scope, _, lo, hi = items[r.item]
        around = [b - a for s, _, a, b in panels if s == scope and a < lo and b > hi]
        assert (size[r.parent] if r.parent else None) == (min(around) if around else None)


def test_narrowing_ends(spark):
    deep = [("m", f"c{k}", f"c{k + 1}" if k < 9 else None, 1, 1) for k in range(10)]
    df = spark.createDataFrame(deep, "menu string, container string, inner string, left_out int, buttons int")
    assert scoring.narrowed(df).first().container == "c9"
    with pytest.raises(RuntimeError):
        scoring.narrowed(df, rounds=4)


def test_paged_listing(spark):
    rows = [(f"u{k}", f"u{k + 1}", [k * 10, k * 10 + 1]) for k in range(37)] + [("u37", "u5", [370]), ("lost", "u1", [0]), ("end", None, [])]
    df = spark.createDataFrame(rows, "url string, next_page string, items array<int>")
    got = files.paged(df, "u0").orderBy("page", "pos").collect()
    assert [(r.page, r.item) for r in got] == [(k, x) for k, (_, _, items) in enumerate(rows[:38]) for x in items]
    assert files.paged(df, "nowhere").count() == 0
    assert {r.page for r in files.paged(df, "lost").collect()} == set(range(38))


def test_sitemaps(spark):
    loc = lambda *urls: "<x>" + "".join(f"<loc>{u}</loc>" for u in urls) + "</x>"
    maps = [("https://a.org/1.xml", loc("https://a.org/2.xml", "https://a.org/p1", "https://a.org/3.xml", "https://a.org/1.xml")), ("https://a.org/2.xml", loc("https://a.org/p2", "https://a.org/p1", "https://a.org/4.xml")), ("https://a.org/3.xml", loc("https://a.org/p3")), ("https://a.org/4.xml", loc("https://a.org/p4", "https://b.org/p5"))]
    df = spark.createDataFrame(maps, "url string, xml string")
    pages = lambda **k: [r.url for r in files.sitemap_pages(df, ["https://a.org/1.xml"], "a.org", "https://a.org/", **k).orderBy("m", "pos").collect()]
    all_pages = [f"https://a.org/p{k}" for k in (1, 2, 3, 4)]
    assert pages() == all_pages == pages(limit=None, most_maps=None)
    assert pages(most_maps=2) == all_pages[:2] and pages(limit=2) == all_pages[:2] and pages(limit=1) == all_pages[:1]


def test_crawl_of_many_levels(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}", 0) for k in range(24)] + [("n3", "n1", 1), ("n24", "n0", 0)], "src string, dst string, pos int")
    got = {r.node: (r.depth, r.crawl) for r in crawl.bfs(edges, spark.createDataFrame([("n0", 0)], "node string, seq long")).collect()}
    assert got == {f"n{k}": (k, k) for k in range(25)}


def test_menu_paths_in_a_circle(spark):
    nav = spark.createDataFrame([("a", "b", 1, "A"), ("b", "a", 2, "B"), ("c", "c", 3, "C"), ("d", "c", 4, "D"), ("e", "lost", 5, "E")] + [(f"x{k}", f"x{k - 1}" if k else None, 10 + k, f"X{k}") for k in range(70)], "id string, parent string, seq int, title string")
    got = {r.id: r.path for r in toc.menu_paths(nav).collect()}
    assert got["d"] == ["C", "D"] and got["c"] == ["C"] and got["e"] == ["E"] and got["x69"] == [f"X{k}" for k in range(70)]
    assert set(got) == {r.id for r in nav.collect()}


def test_arguments(spark):
    lines = ["a  b", "'a b' c", 'x"y z"', "a\\ b", "", None, "'open", '"a\\"b" \'\'']
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(batch.arguments(F.col("line")).alias("w")).collect()
    assert [r.w for r in got] == [["a", "b"], ["a b", "c"], ["xy z"], ["a b"], [], None, None, ['a"b', ""]]


def test_deep_pages():
    deep = "<div>" * 5000 + "x<b>y</b>" + "</div>" * 5000 + "<p>after</p>"
    title, body, size, _ = html.article(f"<body><h1>T</h1><article>{deep}</article></body>")
    assert title == "T" and "x" in body and size > 0
    assert html.to_markdown(html.parse(body)).split() == ["xy", "after"]  # what is nested too deep lies side by side
    assert html.to_markdown(html.parse("<ul><li>" * 600 + "a" + "</li></ul>" * 600)).strip("- \n") == "a"


def test_files_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.png", bytearray(b"\x89PNG\x00")), ("c.bin", bytearray(b"")), ("none", None)], "file string, content binary")
    first, second = str(tmp_path / "one.d"), f"file://{tmp_path}/two"
    assert sorted(tuple(r) for r in notes.export_files(rows, first).collect()) == [("a/b.png", 5), ("c.bin", 0)]
    assert sorted(tuple(r) for r in notes.copied_run(spark, first, second).collect()) == [("a/b.png", 5)]  # Spark lists no empty files
    assert (tmp_path / "two/a/b.png").read_bytes() == b"\x89PNG\x00" and not list((tmp_path / "two").rglob(".*"))
    text = spark.createDataFrame([("x/é.md", "é\n"), ("y.md", None)], "file string, note string")
    assert [tuple(r) for r in notes.export(text, second).collect()] == [("x/é.md", 2)]
    assert (tmp_path / "two/x/é.md").read_text(encoding="utf-8") == "é\n"
    for bad in ("../out.md", "/etc/x"):
        with pytest.raises(Exception, match="outside the folder"):
            notes.export(spark.createDataFrame([(bad, "z")], "file string, note string"), second).collect()


def test_carried_values(spark):
    rng = random.Random(5)
    rows = [(q, k, f"v{k}" if rng.random() < 0.1 else None) for q in ("a", "b", "c") for k in range({"a": 300, "b": 5, "c": 40}[q])]
    want, last = {}, {}
    for q, k, v in rows:
        last[q] = v or last.get(q)
        want[q, k] = last[q]
    df = spark.createDataFrame(rows, "q string, k int, v string").repartition(7)
    assert {(r.q, r.k): r.c for r in toc.carried(df, "q", "k", "v", "c").collect()} == want
