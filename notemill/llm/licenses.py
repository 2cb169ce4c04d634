"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory with a licence file.

Compared with the templates, as sparse TF-IDF vectors, are every line of a text, every run of up to RUN lines that share
words with a template; and with each template, so that a notice is found wherever it lies in a longer line, every window
of the template's number of words, line ends or not. Sums along the text bound the cosine of each window; only windows that can reach the
threshold are compared word by word.

Document frequencies of the templates' words are counted over all texts; a word outside the templates weighs as one that
no text has. A text whose own vector, as a whole, reaches the threshold, or whose file name says so, is a licence file:
it speaks for its directory. Files without a licence of their own take that of the nearest ancestor directory that has
one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD, RUN = 0.6, 6

# Names and the opening words or notices of licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
)
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([-._].*)?$"

_WORD = re.compile(r"[0-9a-z]+(?:[.-][0-9a-z]+)*").findall


def words_of(text: str) -> list[str]:
    return _WORD(text.lower())


def template_words() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in words_of(t)})


class Matcher:
    """Templates as vectors over corpus statistics: n texts, and how many have each template word."""

    def __init__(self, n: int, found: dict[str, int], threshold: float = THRESHOLD):
        idf = lambda df: math.log((1 + n) / (1 + df)) + 1
        self.idf = {w: idf(found.get(w, 0)) for w in template_words()}
        self.rest = idf(0)
        self.threshold = threshold
        self.of_word: dict[str, list[tuple[int, float]]] = {w: [] for w in self.idf}
        for k, (_, text) in enumerate(TEMPLATES):
            v = {w: c * self.idf[w] for w, c in Counter(words_of(text)).items()}
            size = math.sqrt(sum(x * x for x in v.values()))
            for w, x in v.items():
                self.of_word[w].append((k, x / size))
        self.code = {w: k for k, w in enumerate(self.idf)}
        weight = np.array([*self.idf.values(), self.rest])  # words outside have the last place
        self.norms = weight * weight
        self.along = []
        for k, (_, text) in enumerate(TEMPLATES):
            own = np.zeros(len(weight))
            for w in set(words_of(text)):
                own[self.code[w]] = dict(self.of_word[w])[k] * weight[self.code[w]]
            self.along.append((len(words_of(text)), own))
        # cosine <= |shared| / sqrt(|shared|^2 + |rest|^2), and each word outside the templates adds rest^2 at least
        self.least = threshold**2 / (1 - threshold**2) * self.rest**2

    def could_reach(self, shared: float, others: int) -> bool:
        """shared: length of the part within the templates' words, or more; others: words outside."""
        return shared * shared >= self.least * others * (1 - 1e-9) and shared > 0

    def best(self, words: list[str]) -> tuple[float, str]:
        """The highest cosine and its licence; of equal ones the first template's."""
        norm, dots = 0.0, [0.0] * len(TEMPLATES)
        for w, c in Counter(words).items():
            x = c * self.idf.get(w, self.rest)
            norm += x * x
            for k, y in self.of_word.get(w, ()):
                dots[k] += x * y
        top = max(dots)
        return (top / math.sqrt(norm), TEMPLATES[dots.index(top)][0]) if norm else (0.0, "")

    def scan(self, texts: list[str | None]) -> list[tuple[float | None, str | None, str | None]]:
        """For each text: cosine and licence of its best part, and the licence of the whole text; null under the threshold."""
        words = [words_of(t or "") for t in texts]
        tops = [self._lines(t, w) for t, w in zip(texts, words)]
        for n, score, name in self._windows(words):
            if score > tops[n][0][0]:
                tops[n] = ((score, name), tops[n][1])
        return [(*top, whole) if top[0] >= self.threshold else (None, None, whole) for top, whole in tops]

    def _windows(self, words: list[list[str]]) -> Iterator[tuple[int, float, str]]:
        """Text, cosine and licence of the windows of each template's length that reach the threshold for it."""
        place, outside = self.code.get, len(self.code)
        codes = np.array([place(w, outside) for own in words for w in own], np.int64)
        upto = np.r_[0, np.cumsum([len(w) for w in words])]
        owner = np.repeat(np.arange(len(words)), np.diff(upto))
        # a window's squared length is at least this sum, as a word's count squared is at least its count
        norm = np.r_[0, np.cumsum(self.norms[codes])]
        for (size, weights), (name, _) in zip(self.along, TEMPLATES):
            if len(codes) < size:
                continue
            dot = np.r_[0, np.cumsum(weights[codes])]
            dot, least = dot[size:] - dot[:-size], norm[size:] - norm[:-size]
            could = (dot * dot >= (self.threshold**2 - 1e-9) * least) & (owner[: len(dot)] == owner[size - 1 :])
            for a in np.flatnonzero(could).tolist():
                n = int(owner[a])
                counts = Counter(words[n][a - upto[n] : a - upto[n] + size])
                length = math.sqrt(sum((c * self.idf.get(w, self.rest)) ** 2 for w, c in counts.items()))
                score = float(weights[codes[a : a + size]].sum()) / length
                if score >= self.threshold:
                    yield n, score, name

    def _lines(self, text: str | None, whole_words: list[str]) -> tuple[tuple[float, str], str | None]:
        """Cosine and licence of the best line or run of lines, and the licence of the whole text."""
        get, top, whole = self.idf.get, (0.0, ""), None
        run: list[tuple[list[str], float, int]] = []
        all_shared, all_others = 0.0, 0
        for line in (text or "").lower().split("\n"):
            words = _WORD(line)
            if not words:
                continue
            found = [x for w in words if (x := get(w)) is not None]
            others = len(words) - len(found)
            # the length of a sum is at most the sum of lengths, and a word that repeats counts as often
            shared = sum(found)
            all_shared += shared
            all_others += others
            if not found:
                run = []
                continue
            run = [*run[1 - RUN :], (words, shared, others)]
            s, o, joined = 0.0, 0, []
            for own, a, b in reversed(run):
                s, o, joined = s + a, o + b, own + joined
                if self.could_reach(s, o) and (now := self.best(joined))[0] > top[0]:
                    top = now
        if self.could_reach(all_shared, all_others):
            score, name = self.best(whole_words)
            whole = name if score >= self.threshold else None
        return top, whole


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Texts, and for each template word the texts that have it; a row a word and batch is shuffled, a row a word gathered."""
    known = frozenset(template_words())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter({"": batch.num_rows})
        for x in batch.column(0).to_pylist():
            counts.update(known.intersection(words_of(x or "")))
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys())), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    found = {r[0]: r[1] for r in common.map_batches(docs.select(text_col), run, "word string, n long").groupBy("word").sum("n").collect()}
    return found.pop("", 0), found


def _parent(path):
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each file: doc_id, path, own (its licence or null), score (its cosine; null where it is under the
    threshold, as it isn't computed there), license (own or inherited), origin (own, inherited or none).

    Null and empty texts have no licence of their own; a null path has no directory and inherits nothing. A
    directory with several licence files has the alphabetically first licence. Repeated rows give repeated rows; an
    empty table gives none; other columns aren't read, so their names don't matter."""
    matcher = Matcher(*statistics(files, text_col), threshold)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = matcher.scan(batch.column(2).to_pylist())
        own, whole = [f[1] for f in found], [f[2] for f in found]
        score = [None if f[0] is None else round(f[0], 6) for f in found]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.string()), pa.array(score, pa.float64()), pa.array(whole, pa.string())], names=["doc_id", "path", "own", "score", "whole"])

    kind = files.schema[id_col].dataType.simpleString()
    picked = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    rows = common.staged(common.map_batches(picked, run, f"doc_id {kind}, path string, own string, score double, whole string").withColumn("dir", _parent("path")), "licences")
    named = F.regexp_extract("path", r"(?s)([^/]*)$", 1).rlike(FILE_NAME)
    speaks = rows.where("dir IS NOT NULL").select("dir", F.coalesce("whole", F.when(named, F.col("own"))).alias("license")).where("license IS NOT NULL")
    holders = speaks.groupBy(F.col("dir").alias("holder")).agg(F.min("license").alias("license"))
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    dirs = rows.where("dir IS NOT NULL AND own IS NULL").select("dir").distinct().withColumn("a", F.explode(F.array_distinct(ancestors)))
    near = dirs.join(common.sized(common.staged(holders, "holders")), F.col("a") == F.col("holder"))
    near = near.groupBy(F.col("dir").alias("of")).agg(F.max_by("license", F.length("a")).alias("license"))
    out = rows.join(common.sized(common.staged(near, "near")), (F.col("dir") == F.col("of")) & F.col("own").isNull(), "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("license").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", "own", "score", F.coalesce("own", "license").alias("license"), origin.alias("origin"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document lies in the directory of its source and language."""
    docs = common.table(spark, sf_dir, "documents")
    return scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", "doc_id")))
