"""Quality rules: weak supervision in place of a filter that wants every rule passed.

Each rule votes good (1), bad (-1) or abstains (0) on a document. How often a rule is right on good and on bad
documents isn't known; expectation-maximisation estimates it from how the votes agree. The votes of a document are
one of at most 3 ** rules patterns, so the whole corpus is summed up in a table of that fixed size and the
estimation reads only that table. A document's posterior probability of being good decides.

Defined results: a null or empty text has no words and fails the base; rows with repeated ids are judged one by
one; an empty table gives an empty result; other columns are carried through by filter_documents.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES = ("length", "word_length", "symbols", "symbol_words", "repeated_lines", "repeated_words", "capitals", "exclamations")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern int"
#: A document with this posterior or more is kept.
KEEP_AT = 0.5
ROUNDS = 60

_SYMBOL = re.compile(rb"[#*$%&|<>]").search
_CAPITALS = re.compile(rb"[^A-Z]+")
_LETTERS = re.compile(rb"[^A-Za-z]+")


def measures(text: str | None) -> tuple[int, ...]:
    """Words, their code points, symbols, repeated lines, words in repeated 3-word windows; then lines with a word,
    capitals, letters, exclamation marks and words with a symbol."""
    text = text or ""
    data = text.encode()
    words = data.split()  # of bytes: splits at exactly x20 and x09-x0D
    blank = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts, end = Counter(windows), 0
            for i, x in enumerate(windows):
                if counts[x] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    capitals = len(_CAPITALS.sub(b"", data))
    letters = len(_LETTERS.sub(b"", data))
    return len(words), len(text) - blank, symbols, len(lines) - len(set(lines)), repeated, len(lines), capitals, letters, data.count(b"!"), sum(1 for w in words if _SYMBOL(w)) if symbols else 0


def votes(m: tuple[int, ...]) -> tuple[int, ...]:
    """One vote by rule, in the order of RULES."""
    n, chars, symbols, dup_lines, repeated, lines, capitals, letters, marks, marked = m
    if not n:
        return (-1, 0, 0, 0, 0, 0, 0, 0)

    def by(value: float, good: float, bad: float) -> int:
        return 1 if value <= good else -1 if value > bad else 0

    return (
        -1 if n < 50 else 1 if n >= 80 else 0,
        1 if 2.5 <= chars / n <= 12 else -1 if chars / n < 2 or chars / n > 20 else 0,
        by(symbols / n, 0.02, 0.1),
        by(marked / n, 0.05, 0.2),
        by(dup_lines / max(lines, 1), 0.1, 0.3 if dup_lines > 2 else 1),
        by(repeated / n, 0.2, 0.5),
        by(capitals / max(letters, 1), 0.15, 0.5) if letters >= 20 else 0,
        by(marks / n, 0.05, 0.3),
    )


def pattern_of(v: tuple[int, ...]) -> int:
    code = 0
    for x in v:
        code = code * 3 + x + 1
    return code


def votes_of(pattern: int) -> list[int]:
    out = []
    for _ in RULES:
        pattern, x = divmod(pattern, 3)
        out.append(x - 1)
    return out[::-1]


def fit(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], dict[str, tuple[float, float]], float]:
    """Expectation-maximisation over the table of vote patterns.

    Gives the posterior of each pattern, each rule's rate of right votes on good and on bad documents, and the share
    of good documents. Abstentions say nothing. A rule is held to be right on most good documents (0.9 or more), which
    fixes the sense of the two classes: rules that fire together make a document bad, one that fires alone rarely does. An empty table gives no posteriors and the starting rates."""
    codes = sorted(counts)
    weight = np.array([counts[c] for c in codes], float)
    v = np.array([votes_of(c) for c in codes], float).reshape(len(codes), len(RULES))
    up, down = v == 1, v == -1
    right_good, right_bad, share = np.full(len(RULES), 0.99), np.full(len(RULES), 0.4), 0.8
    post = np.zeros(len(codes))
    for _ in range(rounds if len(codes) else 0):
        good = np.log(share) + up @ np.log(right_good) + down @ np.log(1 - right_good)
        bad = np.log(1 - share) + up @ np.log(1 - right_bad) + down @ np.log(right_bad)
        post = 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))
        g, b = weight * post, weight * (1 - post)
        # one document's worth of the starting rates keeps a rule that never votes from 0 / 0
        right_good = np.clip((g @ up + 0.99) / (g @ (up | down) + 1), 0.9, 0.999)
        right_bad = np.clip((b @ down + 0.4) / (b @ (up | down) + 1), 0.02, 0.999)
        share = float(np.clip((g.sum() + 0.8) / (weight.sum() + 1), 0.05, 0.95))
    return dict(zip(codes, post.tolist())), {r: (float(a), float(b)) for r, a, b in zip(RULES, right_good, right_bad)}, share


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the measures of the base and the vote pattern of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measures(x.as_py()) for x in batch.column(1)]
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        codes = pa.array([pattern_of(votes(r)) for r in rows], pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), *cols, codes], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "pattern"])

    return common.map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, {STATS}")


def pattern_counts(stats: DataFrame) -> dict[int, int]:
    """At most 3 ** 8 rows, whatever the input."""
    return {r[0]: r[1] for r in stats.groupBy("pattern").count().collect()}


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality (the posterior)."""
    spark = docs.sparkSession
    stats = common.staged(document_stats(docs, id_col, text_col), "quality")
    posterior, _, _ = fit(pattern_counts(stats))
    rows = spark.createDataFrame([(k, v) for k, v in posterior.items()], "pattern int, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # 3 ** 8 rows at most
    out = stats.join(F.broadcast(rows), "pattern").withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("quality") >= keep_at)).alias("kept"), "quality")


def filter_documents(docs: DataFrame, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows that judge() keeps, with all their columns. Texts aren't shuffled: they are measured twice, once to
    estimate the rules and once to decide."""
    where = docs.columns.index(text_col)
    stats = document_stats(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")))
    posterior, _, _ = fit(pattern_counts(stats))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x in batch.column(where):
            m = measures(x.as_py())
            keep.append(not base_fails(m[0], m[4]) and posterior[pattern_of(votes(m))] >= keep_at)
        return batch.filter(pa.array(keep, pa.bool_()))

    return common.map_batches(docs, run, docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))
