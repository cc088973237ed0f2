"""Operator 7: licence scans by TF-IDF cosine to templates, and inheritance along directories.

Around every marker word each line, each sentence and, for every template, each window of as many
terms as the template has is compared with the licence templates as a sparse TF-IDF vector; document
frequencies of all terms are counted over all lines of the corpus and joined to the terms of the
passages around markers. A file without a licence of its own takes that of the nearest directory above
it that has a licence file, found by joining each distinct directory's ancestors with the licensed ones.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.llm.common import batches_of
from faultfold.session import settle

#: Names and notices of common licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License v3.0"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    *[
        (name, f"SPDX-License-Identifier: {name}{ending}")
        for name in ("MIT", "Apache-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0")
        for ending in (("", "-only", "-or-later") if "GPL" in name else ("",))
    ],
]

LEAST_COSINE = 0.7
#: A stretch of text without any of these is not taken for a notice; every template has one.
_MARKER = re.compile(r"licen[cs]e|permission is hereby|redistribut|public domain", re.IGNORECASE)
_TERM = re.compile(r"[^\W_]+(?:\.\d+)*")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\n")
_FILE = r"^(?i:licen[cs]e|copying|notice)([-.].*)?$"


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


#: Terms of each template, and the most that one has.
_OWN = [terms(text) for _, text in TEMPLATES]
WIDEST = max(map(len, _OWN))


def line_frequencies(files: DataFrame) -> DataFrame:
    """(term, n): in how many lines of all files each term occurs; the empty term counts the lines with words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts: Counter[str] = Counter()
            for text in part.column("text"):
                for line in (text.as_py() or "").split("\n"):
                    own = set(terms(line))
                    if own:
                        counts.update(own)
                        counts[""] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def passages(text: str | None) -> list[str]:
    """The distinct stretches of ``text`` around markers, ``WIDEST`` terms to each side, whole lines at least."""
    if not text or not _MARKER.search(text):
        return []
    edges = [m.span() for m in _TERM.finditer(text)]
    starts = [a for a, _ in edges]
    found: list[list[int]] = []
    for m in _MARKER.finditer(text):
        lo, hi = bisect_right(starts, m.start()) - 1, bisect_left(starts, m.end())
        a = min(edges[max(0, lo - WIDEST)][0], text.rfind("\n", 0, m.start()) + 1)
        line = text.find("\n", m.end())
        b = max(edges[min(len(edges), hi + WIDEST) - 1][1], len(text) if line < 0 else line)
        if found and a <= found[-1][1]:
            found[-1][1] = max(b, found[-1][1])
        else:
            found.append([a, b])
    return list(dict.fromkeys(text[a:b] for a, b in found))


class Scanner:
    """Best template of a text, given the lines with words and in how many of them each term occurs."""

    def __init__(self, lines: int, found: dict[str, int]):
        self.lines, self.found = lines, found
        self.templates = []
        for own in _OWN:
            weights = {t: n * self._idf(t, found) for t, n in Counter(own).items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.templates.append({t: w / norm for t, w in weights.items()})
        self.by_length: dict[int, list[int]] = {}
        for i, own in enumerate(_OWN):
            self.by_length.setdefault(len(own), []).append(i)

    def _idf(self, term: str, found: dict[str, int]) -> float:
        return math.log((1 + self.lines) / (1 + found.get(term, 0))) + 1

    def best(self, text: str | None, found: dict[str, int] | None = None) -> tuple[int, float]:
        """(template, cosine) of the closest notice, -1 without one; equal ones go to the first template."""
        top, score = -1, 0.0
        if not text or not _MARKER.search(text):
            return top, score
        found = self.found if found is None else found
        for span in {*text.split("\n"), *_SENTENCE.split(text)}:
            if _MARKER.search(span):
                own = {t: n * self._idf(t, found) for t, n in Counter(terms(span)).items()}
                norm = math.sqrt(sum(w * w for w in own.values())) or 1.0
                for i, template in enumerate(self.templates):
                    cosine = sum(w * own.get(t, 0.0) for t, w in template.items()) / norm
                    if cosine > score + 1e-12 or (cosine > score - 1e-12 and -1 < i < top):
                        top, score = i, max(score, cosine)
        low = text.lower()
        spans = [m.span() for m in _TERM.finditer(low)]
        words = [low[a:b] for a, b in spans]
        starts = [a for a, _ in spans]
        marked = np.zeros(len(words) + 1, np.int64)
        for m in _MARKER.finditer(low):
            marked[bisect_right(starts, m.start())] = 1
        marked = np.cumsum(marked)
        idf = np.array([self._idf(w, found) for w in words])
        for length, picks in self.by_length.items():
            n = len(words) - length + 1
            if n < 1:
                continue
            has = marked[length:] > marked[:n]
            norms = np.sqrt(_window_squares(words, idf, length))
            for i in picks:
                sums = np.concatenate(([0.0], np.cumsum([self.templates[i].get(w, 0.0) for w in words] * idf)))
                cosines = np.where(has, (sums[length:] - sums[:n]) / norms, 0.0)
                cosine = float(cosines.max())
                if cosine > score + 1e-12 or (cosine > score - 1e-12 and i < top):
                    top, score = i, max(score, cosine)
        return top, min(score, 1.0)


def _window_squares(words: list[str], idf: np.ndarray, length: int) -> np.ndarray:
    """Squared norms of the TF-IDF vectors of all windows of ``length`` words."""
    counts: Counter[str] = Counter()
    total, out, square = 0.0, [], (idf * idf).tolist()
    for i, word in enumerate(words):
        total += (2 * counts[word] + 1) * square[i]
        counts[word] += 1
        if i >= length:
            old = words[i - length]
            counts[old] -= 1
            total -= (2 * counts[old] + 1) * square[i - length]
        if i >= length - 1:
            out.append(total)
    return np.array(out)


def judged_passages(near: DataFrame, files: DataFrame) -> DataFrame:
    """(passage, template, score) of every distinct passage of ``near`` (passage); frequencies over ``files``."""
    frequencies = settle(line_frequencies(files))
    vocabulary = sorted({t for own in _OWN for t in own} | {""})
    known = {r["term"]: r["n"] for r in frequencies.where(F.col("term").isin(vocabulary)).collect()}
    scanner = Scanner(known.pop("", 0), known)
    # Terms travel with a name of their passage, not with its text: a line may be long and rich in terms.
    distinct = near.select("passage").distinct().withColumn("id", F.md5(F.col("passage").cast("binary")))

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, text in zip(part.column("id").to_pylist(), part.column("passage"), strict=True):
                own = sorted(set(terms(text.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own, pa.string())], ["id", "term"])

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [
                scanner.best(text.as_py(), {t["term"]: t["n"] for t in own.as_py()})
                for text, own in zip(part.column("passage"), part.column("own"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([part.column("passage"), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.float64())], ["passage", "template", "score"])

    counted = distinct.mapInArrow(split, "id string, term string").join(frequencies, "term")
    counted = counted.groupBy("id").agg(F.collect_list(F.struct("term", "n")).alias("own"))
    joined = distinct.join(counted, "id").select("passage", "own")
    return joined.mapInArrow(judge, "passage string, template int, score double")


def license_scan(files: DataFrame, *keep: str) -> DataFrame:
    """Licences of every row of ``files`` (path, text).

    Columns: path, ``keep``, own_license, score (the best cosine), license (own or inherited),
    inherited_from (the directory, null for an own licence). Of several licence files (LICENSE,
    COPYING, NOTICE, also with an ending) in a directory the highest score counts, then the smaller
    path.

    Cases: null and empty texts have no licence of their own and inherit; a null path inherits
    nothing; repeated rows are judged alike; an empty table gives no rows; other columns are left
    out.
    """
    names = ["path", *keep]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").to_pylist()
            for a, b in batches_of(texts, lambda t: len(t or ""), 8 << 20):
                columns = [part.column(c).slice(a, b - a) for c in [*names, "__row"]]
                near = pa.array([passages(t) for t in texts[a:b]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*columns, near], [*names, "__row", "__near"])

    source = files.select(*names, "text")
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name in names)
    source = source.withColumn("__row", F.monotonically_increasing_id())
    rows = settle(source.mapInArrow(run, ddl + "__row long, __near array<string>"))
    near = rows.select("__row", F.explode("__near").alias("passage"))
    found = near.join(judged_passages(near, files), "passage")
    found = found.groupBy("__row").agg(F.max(F.struct("score", (-F.col("template")).alias("at"))).alias("best"))
    licence = F.element_at(F.array(*[F.lit(name) for name, _ in TEMPLATES]), 1 - F.col("best.at"))
    own = F.when(F.col("best.score") >= LEAST_COSINE, licence)
    rows = rows.drop("__near").join(found, "__row", "left").select(
        *names, own.alias("own_license"), F.coalesce("best.score", F.lit(0.0)).alias("score")
    )
    rows = settle(rows)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = rows.withColumn("dir", F.when(F.col("path").isNotNull(), folder))
    named = rows.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(_FILE) & F.col("own_license").isNotNull())
    given = named.groupBy("dir").agg(F.min(F.struct(-F.col("score"), "path", "own_license")).alias("top"))
    given = given.select(F.col("dir").alias("above"), F.col("top.own_license").alias("given"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    dirs = rows.where("dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = dirs.join(given, "above").groupBy("dir").agg(F.max(F.struct(F.length("above"), "above", "given")).alias("near"))
    nearest = nearest.select("dir", F.col("near.above").alias("near"), F.col("near.given").alias("given"))
    inherits = F.col("own_license").isNull()
    return rows.join(nearest, "dir", "left").select(
        *names,
        "own_license",
        "score",
        F.coalesce("own_license", "given").alias("license"),
        F.when(inherits, F.col("near")).alias("inherited_from"),
    )


def files_of(docs: DataFrame) -> DataFrame:
    """``documents`` as a tree of files: path, doc_id, text.

    source/lang/block/doc_id.txt; short texts that state a licence are the licence files, of their
    source and language for even doc_ids and of their block for odd ones.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit("none"))
    number = F.coalesce(F.col("doc_id"), F.lit(0))
    block = F.concat(F.lit("b"), F.pmod(number, F.lit(32)).cast("string"))
    short = F.coalesce((F.length("text") < 600) & F.col("text").rlike("(?i)licen[cs]ed? "), F.lit(False))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    base = F.concat_ws("/", part("source"), part("lang"))
    path = (
        F.when(short & (number % 2 == 0), F.concat(base, F.lit("/LICENSE-"), name))
        .when(short, F.concat(base, F.lit("/"), block, F.lit("/LICENSE-"), name))
        .otherwise(F.concat(base, F.lit("/"), block, F.lit("/"), name, F.lit(".txt")))
    )
    return docs.select(path.alias("path"), F.col("doc_id").cast("long").alias("doc_id"), "text")
