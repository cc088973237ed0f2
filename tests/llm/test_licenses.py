"""Licence notices in running text, against brute force over all windows."""

import math
import random
from collections import Counter

from faultfold.llm import licenses

COMMON = [f"common{i}" for i in range(300)]


def cosine(a, b, idf):
    x, y = ({t: n * idf(t) for t, n in Counter(w).items()} for w in (a, b))
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y.get(t, 0.0) for t, v in x.items()) / norm if norm else 0.0


def corpus():
    rng = random.Random(9)
    words = lambda n: " ".join(rng.choices(COMMON, k=n))
    notices = ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Apache-2.0",
               "This file is made available under the Mozilla Public License, version 2.0", "Distributed under the BSD 3-Clause License"]
    files = [(f"d{i}/n.txt", f"{words(50)} {notice} {words(50)}") for i, notice in enumerate(notices)]
    files += [(f"e/{i}.txt", "\n".join(words(12) for _ in range(40))) for i in range(30)]
    return [*files, ("f/a.txt", f"{words(9)} licence {words(30)}\n\nlicense"), ("f/b.txt", None), ("f/c.txt", "")]


def test_notices_within_long_lines(spark):
    files = corpus()
    lines = [set(licenses.terms(x)) for _, t in files for x in (t or "").split("\n") if licenses.terms(x)]
    counts = Counter(t for own in lines for t in own)
    idf = lambda t: math.log((1 + len(lines)) / (1 + counts[t])) + 1
    found = {r["path"]: r for r in licenses.license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert [found[f"d{i}/n.txt"]["own_license"] for i in range(5)] == ["Apache-2.0", "MIT", "Apache-2.0", "MPL-2.0", "BSD-3-Clause"]
    assert len(found) == len(files) and all(r["own_license"] is None for p, r in found.items() if p[0] != "d")
    for path, text in files[:5]:
        words = licenses.terms(text)
        best = 0.0
        for _, template in licenses.TEMPLATES:
            own = licenses.terms(template)
            for i in range(len(words) - len(own) + 1):
                window = words[i : i + len(own)]
                if any("licen" in w for w in window):
                    best = max(best, cosine(window, own, idf))
        assert math.isclose(found[path]["score"], best, rel_tol=1e-9)


def test_frequencies_of_all_terms(spark):
    files = spark.createDataFrame([("a", "Is this it\nit is\n\n"), ("b", "is is licensed"), ("c", None)], "path string, text string")
    found = {r["term"]: r["n"] for r in licenses.line_frequencies(files).collect()}
    assert found == {"": 3, "is": 3, "this": 1, "it": 2, "licensed": 1}


def test_one_long_line(spark):
    """A megabyte in one line with 50,000 distinct words: terms travel by the name of their passage."""
    line = " ".join(f"word{i}" for i in range(50_000)) + " Licensed under the MIT License. " + "tail " * 100_000
    files = spark.createDataFrame([("a/x.txt", line), ("a/y.txt", "nothing"), ("b/LICENSE", "The MIT License (MIT)")], "path string, text string")
    found = {r["path"]: (r["own_license"], r["license"]) for r in licenses.license_scan(files).collect()}
    assert found["a/x.txt"] == ("MIT", "MIT") and found["b/LICENSE"][0] == "MIT" and found["a/y.txt"][0] is None


def test_small_tables(spark):
    names = "path string, text string, term string, id string, passage string, own string, n long"
    rows = [("d/LICENSE", "Released under the MIT License.", "t", "i", "p", "o", 1)] * 2 + [("d/e/f", None, "t", "i", "p", "o", 2), ("d/e/g", "", "t", "i", "p", "o", 3)]
    files = spark.createDataFrame(rows, names)
    found = licenses.license_scan(files, "id", "n").collect()
    assert [(r["path"], r["license"], r["id"]) for r in sorted(found, key=lambda r: (r["path"], r["n"]))] == [
        ("d/LICENSE", "MIT", "i"), ("d/LICENSE", "MIT", "i"), ("d/e/f", "MIT", "i"), ("d/e/g", "MIT", "i")]
    assert licenses.license_scan(files.where("false")).count() == 0
