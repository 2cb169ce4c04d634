"""Column functions on text. Regular expressions take Unicode classes, as Python's do: see rx() and rxi()."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UNTITLED = "sem-titulo"


def rx(pattern: str) -> str:
    """A pattern whose classes (\\s, \\w, \\d) are Unicode's."""
    return f"(?U){pattern}"


def rxi(pattern: str) -> str:
    """The same, whatever the case."""
    return f"(?iuU){pattern}"


def _folds(last: int = 0x24FF) -> dict[str, str]:
    """Letters that decompose, and combining marks, with what is left of them without marks."""
    out = {}
    for k in range(0x80, last + 1):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(k)) if not unicodedata.combining(c))
        if plain != chr(k) and len(plain) <= 1:
            out[chr(k)] = plain
    return out


def fold(col: Column) -> Column:
    """Without accents: canonical decomposition less combining marks."""
    table = _folds()
    kept = [c for c, p in table.items() if p]
    gone = [c for c, p in table.items() if not p]
    # translate() drops characters that have no counterpart; most texts have none to fold at all
    folded = F.translate(col, "".join(kept + gone), "".join(table[c] for c in kept))
    return F.when(col.rlike(r"[^\x00-\x7f]"), folded).otherwise(col)


def strip(col: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col, rx(r"^\s+|\s+\z"), "")


def collapse(col: Column) -> Column:
    return strip(F.regexp_replace(col, rx(r"\s+"), " "))


def slugify(col: Column, limit: int = 70) -> Column:
    """Lower-case words joined by hyphens, cut at a whole word near limit; what is left empty has a fixed name."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(fold(col)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    longer = F.substring(slug, 1, limit + 1)
    at_word = F.regexp_replace(longer, "-[^-]*$", "")
    late = F.substring(longer, limit // 2 + 1, limit).contains("-")
    cut = F.when(F.length(slug) <= limit, slug).when(late, at_word).otherwise(F.substring(slug, 1, limit))
    return F.coalesce(F.nullif(F.regexp_replace(cut, "-+$", ""), F.lit("")), F.lit(UNTITLED))


def plain(col: Column) -> Column:
    """For comparing: no accents, white space collapsed, lower case."""
    return F.lower(collapse(fold(col)))


def pick_title(tab: Column, heading: Column) -> Column:
    """The tab's title before ` | `, unless it is cut off and the heading goes on."""
    title, heading = strip(F.substring_index(tab, " | ", 1)), collapse(heading)
    stem = F.lower(F.regexp_replace(title, "[…. ]+$", ""))
    better = (heading != "") & ((title == "") | ((F.char_length(heading) > F.char_length(title)) & F.startswith(F.lower(heading), stem)))
    return F.when(better, heading).otherwise(title)


def first_heading(markdown: Column, fallback: Column) -> Column:
    found = F.regexp_extract(markdown, r"(?m)^#{1,2} (.+)$", 1)
    return F.when(markdown.rlike(r"(?m)^#{1,2} .+$"), strip(F.regexp_replace(found, r"\*\*|__|\*|`", ""))).otherwise(fallback)


def front_matter(title: Column, source: Column, at: Column, module: Column | None = None) -> Column:
    safe = F.replace(title, F.lit('"'), F.lit("'"))
    inside = F.when(F.coalesce(module, F.lit("")) != "", F.concat(F.lit('module: "'), module, F.lit('"\n'))).otherwise("") if module is not None else F.lit("")
    return F.concat(F.lit('---\ntitle: "'), safe, F.lit('"\n'), inside, F.lit("source: "), source, F.lit("\nextracted_at: "), at, F.lit("\n---\n\n"))


def with_title(title: Column, body: Column, always: bool = False) -> Column:
    """The body under its title, unless it begins with a heading."""
    titled = F.concat(F.lit("# "), title, F.lit("\n\n"), body)
    return titled if always else F.when(F.regexp_replace(body, rx(r"^\s+"), "").startswith("#"), body).otherwise(titled)


_FRONT = r"(?s)\A(---\n.*?\n---\n\n?)"


def front_of(note: Column) -> Column:
    return F.regexp_extract(note, _FRONT, 1)


def body_of(note: Column) -> Column:
    return F.regexp_replace(note, _FRONT, "")


def front_title(note: Column, fallback: Column) -> Column:
    front = front_of(note)
    return F.when(front.rlike(r'(?m)^title: ".*"$'), F.regexp_extract(front, r'(?m)^title: "(.*)"$', 1)).otherwise(fallback)


def blocks(markdown: Column) -> Column:
    """The text cut before each heading of level 1 and 2."""
    return F.split(markdown, r"(?m)^(?=#{1,2} )")


def chunks(markdown: Column, limit: int = 30000) -> Column:
    """The text cut before headings of level 1 and 2, as few cuts as keep parts within limit; a longer block stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(at, block):
        full = (at["now"] != "") & (F.char_length(at["now"]) + F.char_length(block) > limit)
        return F.struct(F.when(full, F.concat(at["out"], F.array(at["now"]))).otherwise(at["out"]).alias("out"), F.when(full, block).otherwise(F.concat(at["now"], block)).alias("now"))

    def end(at):
        return F.when(at["now"] != "", F.concat(at["out"], F.array(at["now"]))).otherwise(at["out"])

    return F.when(F.char_length(markdown) <= limit, F.array(markdown)).otherwise(F.aggregate(blocks(markdown), start, step, end))


_ANCHOR = r"(?m)^(#{1,6} [^\n]*?)[^\S\n]*\[\[[^\]\n]+\]\][^\S\n]*$"
_YAML = r"(?s)\A---\n(.*?)\n---\n"
_YAML_TITLE = r"""(?m)^title:\s*["']?(.+?)["']?\s*$"""


def clean_markdown(text: Column) -> Column:
    """struct(title, body) of a published Markdown version: no YAML front, no notice for language models on top, no anchors at headings."""
    front = F.regexp_extract(text, _YAML, 1)
    rest = F.regexp_replace(F.regexp_replace(text, _YAML, ""), rx(r"\A\s+"), "")
    lines = F.split(rest, "\n")

    def step(at, _):
        drop = at["on"] & F.element_at(at["left"], 1).startswith(">") & F.array_join(F.slice(at["left"], 1, 6), "\n").rlike(r"llms(-full)?\.txt|Documentation Index")
        return F.struct(F.when(drop, F.slice(at["left"], 2, F.size(at["left"]))).otherwise(at["left"]).alias("left"), drop.alias("on"))

    # a line more than there are keeps the list from running empty
    kept = F.aggregate(lines, F.struct(F.concat(lines, F.array(F.lit(""))).alias("left"), F.lit(True).alias("on")), step, lambda at: at["left"])
    body = F.concat(strip(F.regexp_replace(F.array_join(kept, "\n"), _ANCHOR, "$1")), F.lit("\n"))
    of_front = strip(F.regexp_extract(front, _YAML_TITLE, 1))
    title = F.when(of_front != "", of_front).otherwise(strip(F.regexp_extract(body, r"(?m)^# (.+)$", 1)))
    return F.struct(title.alias("title"), body.alias("body"))


def line_args(rest: Column) -> Column:
    return strip(F.substring_index(rest, " — ", 1))


def notebook_images(source: Column) -> Column:
    return F.regexp_replace(source, r"!\[([^\]]*)\]\((?:attachment:|data:)[^)]*\)", "<!-- Imagem presente aqui: $1 -->")


def is_html(text: Column) -> Column:
    return text.rlike(rxi(r"^\s*<(!doctype|html)"))


def path_text(titles: Column) -> Column:
    return F.array_join(titles, " › ")
