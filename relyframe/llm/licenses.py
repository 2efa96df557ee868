"""Operator 1: licence scans by sparse TF-IDF cosine, then inheritance from the nearest ancestor directory.

Every file is compared with licence statements, headers and whole licence texts. A template of n terms is compared with each
window of n consecutive terms of the file, so words around a statement don't dilute it, and line ends inside it don't matter.
Terms are weighted by their inverse frequency over all lines of the corpus, which is counted for the templates' terms only; other
terms count as never seen, and stand only where a window lacks a term of the template. A window is scored only if it holds a term
without which the template's cosine can't reach the threshold (prefix filter), so most texts cost one set test. Files without a
licence of their own take that of the nearest ancestor directory with a licence file; directories are resolved once each, by
joining their ancestors with licensed directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm.common import materialize, table

THRESHOLD = 0.8
#: Files to a derived directory of the documents table, per level.
FANOUT = 64
# Licence statements, headers and a whole text, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
}
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def terms(line: str) -> list[str]:
    """Lower-case runs of ASCII letters and digits; version numbers keep their dots."""
    return _TERM.findall(line.lower())


class Scorer:
    """TF-IDF cosine of the windows of a text to templates."""

    def __init__(self, templates: dict[str, tuple[str, ...]], frequency: dict[str, int], n_lines: int, threshold: float = THRESHOLD):
        self.threshold, self.other = threshold, math.log(1 + n_lines)
        self.idf = {t: math.log((1 + n_lines) / (1 + frequency.get(t, 0))) for t in vocabulary(templates)}
        self.templates, self.triggers = [], set()
        for name, statements in sorted(templates.items()):
            for statement in statements:
                counts = Counter(terms(statement))
                weights = {t: n * self.idf[t] for t, n in counts.items()}
                norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
                # A window with none of the first, heaviest terms shares less than the threshold with this template.
                own, rest = set(), 1.0
                for t, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
                    if rest < threshold * threshold:
                        break
                    own.add(t)
                    rest -= (w / norm) ** 2
                self.triggers |= own
                self.templates.append((name, {t: w / norm for t, w in weights.items()}, own, sum(counts.values())))

    def weight(self, term: str) -> float:
        return self.idf.get(term, self.other)

    def cosine(self, template: dict[str, float], window: list[str]) -> float:
        weights = {t: n * self.weight(t) for t, n in Counter(window).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return sum(w * weights[t] for t, w in template.items() if t in weights) / norm if norm else 0.0

    def found(self, stream: list[str]) -> Iterator[tuple[float, int, str]]:
        """(score, first term, name) of each window at or above the threshold; a text shorter than a template is one window."""
        at = [p for p, t in enumerate(stream) if t in self.triggers]
        for name, template, own, n in self.templates:
            last, done = max(0, len(stream) - n), -1
            for p in at:
                if stream[p] not in own:
                    continue
                first, end = max(done + 1, p - n + 1, 0), min(p, last)
                if first <= end:
                    for start in self._passing(template, stream, first, end, n):
                        score = self.cosine(template, stream[start : start + n])
                        if score >= self.threshold:
                            yield score, start, name
                    done = end

    def _passing(self, template: dict[str, float], stream: list[str], first: int, end: int, n: int) -> Iterator[int]:
        """Starts from ``first`` to ``end`` whose windows may pass, by sums that move along; they are scored again exactly."""
        counts = Counter(stream[first : first + n])
        dot = sum(counts[t] * self.weight(t) * w for t, w in template.items())
        square = sum((c * self.weight(t)) ** 2 for t, c in counts.items())
        for start in range(first, end + 1):
            if dot >= (self.threshold - 1e-6) * math.sqrt(max(square, 0.0)):
                yield start
            if start < end:
                for t, step in ((stream[start], -1), (stream[start + n], 1)):
                    w = self.weight(t)
                    square += ((counts[t] + step) ** 2 - counts[t] ** 2) * w * w
                    dot += step * w * template.get(t, 0.0)
                    counts[t] += step

    def best(self, lines: list[list[str]]) -> tuple[str | None, float | None, int | None, int]:
        """(licence, score, line where its window begins, lines where such windows begin) of a text's lines of terms.

        Of equal scores the first window counts, and then the first name.
        """
        if all(self.triggers.isdisjoint(line) for line in lines):
            return None, None, None, 0
        found = list(self.found([t for line in lines for t in line]))
        if not found:
            return None, None, None, 0
        line_of = [k for k, line in enumerate(lines) for _ in line]
        score, start, name = min(found, key=lambda x: (-round(x[0], 9), x[1], x[2]))
        return name, score, line_of[start], len({line_of[s] for _, s, _ in found})


def vocabulary(templates: dict[str, tuple[str, ...]]) -> set[str]:
    return {t for statements in templates.values() for s in statements for t in terms(s)}


def line_frequency(files: DataFrame, words: set[str]) -> tuple[dict[str, int], int]:
    """Of the lines of all texts, how many hold each of the words, and how many have a term at all.

    The result has a number a template term; all counting is done where the lines are.
    """

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                for line in text.split("\n"):
                    own = set(terms(line))
                    if own:
                        found[""] += 1
                        found.update(own & words)
        yield pd.DataFrame(list(found.items()), columns=["term", "n"])

    counted = files.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r.term: r.n for r in counted.collect()}
    return counts, counts.pop("", 0)


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, id, licence, score, line, n_lines) of files (id, path, text): the best window of each file, nulls without any.

    ``line`` is where it begins, ``n_lines`` how many lines begin one. Of equal scores the first counts. A null or empty text has
    no licence. Repeated rows are scanned alike; an empty table gives no rows. Other columns are dropped.
    """
    rows = files.select("id", "path", F.coalesce("text", F.lit("")).alias("text"))
    frequency, n_lines = line_frequency(rows, vocabulary(templates))
    scorer = Scorer(templates, frequency, n_lines, threshold)

    def best(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [scorer.best([terms(line) for line in text.split("\n")]) for text in pdf["text"]]
            names = ["licence", "score", "line", "n_lines"]
            found = pd.DataFrame(out, columns=names, index=pdf.index).astype({"line": "Int64"})
            yield pd.concat([pdf[["id", "path"]], found], axis=1)

    kind = files.schema["id"].dataType.simpleString()
    return rows.mapInPandas(best, f"id {kind}, path string, licence string, score double, line long, n_lines long")


def inherit(scanned: DataFrame) -> DataFrame:
    """Scanned files (id, path, is_licence_file, licence, …) with ``effective`` licence and the directory it is ``from_dir``.

    A directory's licence is that of its licence files (the smallest path that has one). A file's own licence comes
    first, with a null ``from_dir``; else that of the nearest ancestor directory, its own directory included. Null
    paths have no ancestors. Directories are made distinct before their ancestors are listed. Other columns are kept, whatever
    their names, but for ``effective`` and ``from_dir``, which are replaced. No files give no rows.
    """
    names = [c for c in scanned.columns if c not in ("effective", "from_dir")]
    files = scanned.select(F.struct(*(scanned[c] for c in names)).alias("row"), F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"))
    licensed = files.filter("row.is_licence_file and row.licence is not null and row.path is not null")
    licensed = licensed.groupBy("dir").agg(F.min(F.struct("row.path", "row.licence")).alias("own")).select(F.col("dir").alias("ancestor"), F.col("own.licence").alias("given"))
    parts = F.split("dir", "/", -1)
    levels = F.sequence(F.lit(0), F.size(parts))
    ancestors = F.transform(levels, lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("ancestor")))
    dirs = files.select("dir").filter("dir is not null").distinct().select("dir", F.inline(ancestors))
    nearest = dirs.join(licensed, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "given")).alias("near"))
    # Written first: only then is a directory with a third of all files a plain row of the join, which Spark splits.
    nearest = materialize(nearest.select("dir", F.col("near.ancestor").alias("ancestor"), F.col("near.given").alias("given")))
    return files.join(nearest, "dir", "left").select(
        "row.*",
        F.coalesce("row.licence", "given").alias("effective"),
        F.when(F.col("row.licence").isNull(), F.col("ancestor")).alias("from_dir"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree source/language/block/id.

    The table has no licence files: the first document of each block (smallest id) stands for one, and gives its
    licence, if it has any, to the directory. In each source, language and outer block the first document with a licence
    is put into that directory itself and stands for its licence file.
    """
    docs = table(spark, sf_dir, "documents")
    block = F.floor(F.col("doc_id") / FANOUT)
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), (block / FANOUT).cast("long"), block)
    files = docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", folder, F.col("doc_id")).alias("path"), "text")
    scanned = materialize(scan(files))
    parts = F.split("path", "/", -1)
    levels = F.array(*(F.struct(F.lit(k).alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("upper")) for k in (1, 2, 3)))
    upper = scanned.filter("licence is not null").select("id", F.inline(levels)).groupBy("depth", "upper").agg(F.min("id").alias("id"))
    upper = materialize(upper.groupBy("id").agg(F.min_by("upper", "depth").alias("upper")))
    scanned = scanned.join(upper, "id", "left").withColumn("path", F.coalesce(F.concat("upper", F.lit("/"), "id"), "path")).drop("upper")
    scanned = materialize(scanned.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")))
    first = scanned.groupBy("dir").agg(F.min("id").alias("first_id"))
    scanned = scanned.join(first, "dir").withColumn("is_licence_file", F.col("id") == F.col("first_id")).drop("dir", "first_id")
    return inherit(scanned).select(
        F.col("id").alias("doc_id"), "path", F.col("licence").alias("own_license"), F.round("score", 6).alias("score"), "line", "n_lines",
        F.col("effective").alias("license"), F.col("from_dir").alias("inherited_from"),
    )
