"""Lexical search against scores of every document, exact arithmetic and all ties."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from faultfold.llm import lexical

DOCS = "doc_id long, text string, item long, score long, block long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    big, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in set(items):
        found = []
        for d, c, n in counted:
            m = 100 - 75 + (75 * n * big) // total
            score = 0
            for t in terms(text):
                w = math.floor(1000 * math.log((2 * big + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        for rank, (score, none, d) in enumerate(sorted(found)[:k], 1):
            out.append((item_id, rank, None if none else d, -score))
    return sorted(out, key=repr)


def tables(seed, n):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeéß日1Z") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(len(pool))]
    text = lambda m: "".join(w + rng.choice([" ", ", ", "\n", "--"]) for w in rng.choices(pool, weights, k=m))
    passages = [text(30) for _ in range(6)]
    texts = [text(rng.choice([2, 20, 60, 200])) for _ in range(n)]
    texts += [text(20) + rng.choice(passages) + text(20) for _ in range(n // 8)]
    texts += [passages[0]] * 25 + [None, "", " .!?", "x" * 5000, text(6000), "ONE one One"]
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, passages[0]), (3, passages[1]), (3, passages[1])]
    items = [(i, p) for i, p in enumerate(passages)] + [(7, "one"), (8, "nowhere-to-be-found"), (9, None), (10, ""), (11, "x x x")]
    items += [(0, passages[0]), (12, " ".join(rng.choices(pool, weights, k=60))), (None, passages[2] + " one one")]
    return docs, items


@pytest.mark.parametrize("rows", [7, 1024])
def test_every_rank(spark, monkeypatch, rows):
    monkeypatch.setattr(lexical, "BLOCK_ROWS", rows)
    docs, items = tables(rows, 300)
    given = spark.createDataFrame([(*d, 0, 0, 0) for d in docs], DOCS).repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((tuple(r) for r in lexical.search(given, asked).collect()), key=repr)
    assert found == brute(docs, items)
    # Several passes give the same.
    monkeypatch.setattr(lexical, "PASS_TERMS", 100)
    assert sorted((tuple(r) for r in lexical.search(given, asked).collect()), key=repr) == found


def test_bounds_are_never_below_scores():
    docs, items = tables(5, 200)
    block, known, frequency = lexical.Block(), {}, Counter()
    for d, text in docs:
        found = lexical.terms(text)
        if found:
            counts = Counter(found)
            frequency.update([t.decode() for t in counts])
            frequency["*"] += 1
            frequency["+"] += len(found)
            block.add(d, text.encode(), found, counts, known)
    texts = [(i, t) for i, (_, t) in enumerate(items) if lexical.terms(t)]
    made, row = lexical.Items(texts, frequency), block.row(0)
    lengths = np.frombuffer(row["lengths"], "<i8")
    near = 0
    for a, bounds in made.bounds(row):
        for j in range(len(row["ids"])):
            scores = made.scores(row["texts"][j], int(lengths[j]), np.arange(a, a + len(bounds)))
            assert (scores <= bounds[:, j]).all()
            near += int((bounds[:, j] < 2 * scores + 1).sum())
    assert near > 0.5 * len(row["ids"])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words", 0, 0, 0)], DOCS)
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert [tuple(r)[:3] for r in lexical.search(docs, items).collect()] == [(1, 1, 1)]
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.selectExpr("doc_id", "cast(null as string) text"), items)):
        found = lexical.search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0
