"""Secret scans, DataFrame operations only.

Base patterns name three kinds of secrets. Beyond them, candidate strings (runs of base64 letters with a letter and a
digit) are scanned by a window of WINDOW characters: its Shannon entropy is kept up to date by incremental counts as
characters enter and leave, and a candidate is a secret where some window reaches the threshold of its character class.
An allow-list suppresses candidates that are known to be harmless; it never suppresses a base span. Repeated groups in
patterns are possessive: they need no stack, however long a candidate is.

Positions are code points; they are found by splitting a text at a pattern, as the pieces and the matches alternate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The base patterns, the least length of what they must find, and its group.
KINDS = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
)
#: Where a text has no match of these, it has no span of that kind that is long enough.
HINTS = {
    "assign": r"""(?:[wW][oO][rR][dD]|[sS][wW][dD]|[cC][rR][eE][tT]|[kK][eE][nN]|[kK][eE][yY])["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
#: Matches of a shorter pattern that are long enough are those of this one.
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits that a window of each class must reach. Random digits to base 16 have about 3.4, letters and digits about 4.1.
THRESHOLDS = {"hex": 3.2, "alnum": 3.8, "base64": 3.9}
CLASSES = (("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$"), ("alnum", r"^[A-Za-z0-9]+$"))
#: Candidates that match one of these are harmless: UUIDs, words joined by signs with numbers between, repeats, documented examples.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^(?:[A-Za-z]++|[0-9]++)(?:[+/_=-]++(?:[A-Za-z]++|[0-9]++))*+[+/_=-]*+$",
    r"(.)\1{5}",
    r"(?i)example|placeholder|xxxx",
)


SPANS = "array<struct<start:int,end:int>>"
#: Elements that one inner fold adds up. A fold copies what it has for each element it adds, so long arrays are folded in
#: blocks of this size, and the blocks then joined.
BLOCK = 256


def _bound(value: Column, use) -> Column:
    """use(value), with value found once: an expression inside a lambda is found anew for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(items: Column, start: Column, step, kind: str) -> Column:
    """Array of what step adds for each item. step: from a state and an item, the next state and the element."""
    none = F.array().cast(f"array<{kind}>")

    def one(now, x):
        at, element = step(now["at"], x)
        return F.struct(at.alias("at"), F.concat(now["out"], F.array(element)).alias("out"))

    def all_of(items):
        def block(now, k):
            own = F.aggregate(F.slice(items, k * BLOCK + 1, BLOCK), F.struct(now["at"].alias("at"), none.alias("out")), one)
            return _bound(own, lambda x: F.struct(x["at"].alias("at"), F.concat(now["out"], F.array(x["out"])).alias("out")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
        whole = F.aggregate(blocks, F.struct(start.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")), block, lambda x: F.flatten(x["out"]))
        return F.when(F.size(items) > 0, whole).otherwise(none)

    return _bound(items, all_of)


def _spans(matches: Column, pieces: Column) -> Column:
    """start and end of each match; pieces has one more element than matches."""

    def step(at, x):
        begin = at + x["gap"]
        end = begin + x["size"]
        return end, F.struct(begin.alias("start"), end.alias("end"))

    sizes = F.zip_with(matches, pieces, lambda m, p: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("size")))
    return _folded(F.filter(sizes, lambda x: x["size"].isNotNull()), F.lit(0), step, "struct<start:int,end:int>")


def _none() -> Column:
    return F.array().cast(SPANS)


def _found(text: Column, pattern: str, hint: str | None = None) -> Column:
    spans = _spans(F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1))
    return F.when(text.rlike(hint or pattern), spans).otherwise(_none())


def base_spans(text: Column) -> dict[str, Column]:
    """By kind: array of start, end of the spans that are long enough."""
    out = {}
    for kind, pattern, least, group in KINDS:
        if kind in LONG:
            out[kind] = _found(text, LONG[kind], HINTS[kind])
        else:
            both = F.arrays_zip(_spans(F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)).alias("s"), F.regexp_extract_all(text, F.lit(pattern), group).alias("g"))
            long = F.transform(F.filter(both, lambda x: F.char_length(x["g"]) >= least), lambda x: x["s"])
            out[kind] = F.when(text.rlike(HINTS[kind]), long).otherwise(_none())
    return out


def best_entropy(value: str, window: int = WINDOW) -> str:
    """SQL: the highest entropy, in bits, of a window of the string value (all of it, if shorter). n characters with
    counts c have log2(n) - sum(c * log2(c)) / n bits; the sum is brought up to date for the two counts that change.

    A count takes five bits of a long, twelve to each, so window is 31 at most."""
    assert window < 32
    longs = -(-len(ALPHABET) // 12)
    word, shift = "CAST((t.{0} - 1) DIV 12 AS INT)".format, "CAST(5 * ((t.{0} - 1) % 12) AS INT)".format
    count = lambda x: f"CAST(shiftright(now.c[{word(x)}], {shift(x)}) & 31L AS DOUBLE)"
    g = "(CASE WHEN {0} > 1 THEN {0} * log2({0}) ELSE 0D END)".format
    into, gone = "codes[i - 1]", f"CASE WHEN i > {window} THEN codes[i - {window} - 1] ELSE 0 END"
    change = f"""CASE WHEN t.a = t.b THEN 0D
        ELSE {g(f"({count('a')} + 1)")} - {g(count('a'))} + CASE WHEN t.b > 0 THEN {g(f"({count('b')} - 1)")} - {g(count('b'))} ELSE 0D END END"""
    step = f"""aggregate(array(struct({into} AS a, {gone} AS b)), now, (now, t) -> struct(
        CASE WHEN t.a = t.b THEN now.c ELSE transform(now.c, (v, k) -> v + CASE WHEN k = {word('a')} THEN shiftleft(1L, {shift('a')}) ELSE 0L END
            - CASE WHEN t.b > 0 AND k = {word('b')} THEN shiftleft(1L, {shift('b')}) ELSE 0L END) END AS c,
        now.s + {change} AS s, now.best AS best))"""
    n = f"least({window}, size(codes))"
    ranked = f"transform(array({step}), x -> struct(x.c AS c, x.s AS s, CASE WHEN i >= {n} THEN greatest(now.best, log2({n}) - x.s / {n}) ELSE now.best END AS best))[0]"
    best = f"aggregate(sequence(1, size(codes)), struct(array_repeat(0L, {longs}) AS c, 0D AS s, 0D AS best), (now, i) -> {ranked}, x -> x.best)"
    # places in the alphabet, found once: a character of a string is reached only from the string's start
    return f"transform(array(transform(split({value}, ''), x -> instr('{ALPHABET}', x))), codes -> {best})[0]"


def _scanned(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with one more column for each kind, and entropy (arrays of start, end); and their names, which docs has not."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = base_spans(text)
    names = {kind: common.free_name(docs, f"_spans_{kind}") for kind in (*base, "entropy")}
    loose = common.free_name(docs, "_spans_candidates")
    out = docs.withColumns({names[kind]: spans for kind, spans in base.items()})
    values = F.regexp_extract_all(text, F.lit(CANDIDATE), 0)
    v = F.zip_with(_spans(values, F.split(text, CANDIDATE, -1)), values, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("v")))
    harmless = "|".join(f"(?:{p})" for p in ALLOW)
    v = F.filter(v, lambda s: ~s["v"].rlike(harmless))
    out = out.withColumn(loose, F.when(text.rlike(CANDIDATE), v).otherwise(F.array().cast("array<struct<start:int,end:int,v:string>>")))
    taken = "concat(" + ", ".join(f"`{names[kind]}`" for kind in base) + ")"
    least = f"CASE WHEN s.v RLIKE '{CLASSES[0][1]}' THEN {THRESHOLDS['hex']}D WHEN s.v RLIKE '{CLASSES[1][1]}' THEN {THRESHOLDS['alnum']}D ELSE {THRESHOLDS['base64']}D END"
    free = "NOT exists(taken, t -> t.start < s.end AND t.end > s.start)"
    high = f"transform(array({taken}), taken -> transform(filter(`{loose}`, s -> {free} AND {best_entropy('s.v')} >= {least}), s -> struct(s.start AS start, s.end AS end)))[0]"
    return out.withColumn(names["entropy"], F.when(F.size(loose) > 0, F.expr(high)).otherwise(_none())).drop(loose), names


def _listed(names: dict[str, str], kinds: tuple[str, ...]) -> Column:
    """The spans of kinds as start, order of the kind, end, kind, by start and then by kind."""

    def named(n: int, kind: str) -> Column:
        return F.transform(F.col(names[kind]), lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*(named(n, kind) for n, kind in enumerate(kinds))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Null and empty texts have no span: counts of 0, the digest of the empty string, empty spans. Repeated rows give
    repeated rows; an empty table gives none; clashing names of other columns do no harm, as only two are read."""
    found, names = _scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    kinds = tuple(k for k, *_ in KINDS)
    counts = [F.size(names[k]).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_joined(_listed(names, kinds)), 256).alias("base_sha256"), _joined(_listed(names, (*kinds, "entropy"))).alias("spans"), F.size(names["entropy"]).cast("long").alias("n_entropy"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns kept, with mark in place of each span (spans that overlap count as one). Null texts stay null;
    other columns keep their values, whatever their names."""
    found, names = _scanned(docs, text_col)
    spans, text, cuts = common.free_name(docs, "_spans_all"), F.col(text_col), common.free_name(docs, "_spans_cuts")
    found = found.withColumn(spans, _listed(names, tuple(names)))

    def step(at, s):
        """What lies between the spans so far and the next one; a span that overlaps them has no such gap."""
        overlaps = (s["start"] < at) & (at > 0)
        return F.greatest(at, s["end"]), F.struct(F.when(overlaps, -1).otherwise(at).alias("start"), s["start"].alias("end"))

    gaps = F.filter(_folded(F.col(spans), F.lit(0), step, "struct<start:int,end:int>"), lambda g: g["start"] >= 0)
    last = F.struct(F.array_max(F.transform(F.col(spans), lambda s: s["end"])).alias("start"), F.char_length(text).alias("end"))
    found = found.withColumn(cuts, F.concat(gaps, F.array(last)))

    def block(k):
        """The gaps of one block, cut from the part of the text that they span, so that no gap is counted from its start."""

        def cut(own):
            begin = F.element_at(own, 1)["start"]
            part = F.substring(text, begin + 1, F.element_at(own, -1)["end"] - begin)
            return _bound(F.struct(begin.alias("begin"), part.alias("part")), lambda x: F.transform(own, lambda g: F.substring(x["part"], g["start"] - x["begin"] + 1, g["end"] - g["start"])))

        return F.array_join(_bound(F.slice(F.col(cuts), k * BLOCK + 1, BLOCK), cut), mark)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / BLOCK).cast("int")), block)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, F.array_join(blocks, mark)).otherwise(text)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
