"""Every stage of the pipeline against brute force on the rows its predecessor kept, and the whole run."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline
from faultfold.llm import bpe, oracle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(11)
    plain = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    text = lambda n: [rng.choice(plain) for _ in range(n)]
    passage, base = text(70), text(200)
    texts, toxic = [], set()
    for i in range(600):
        own = text(rng.randint(30, 90))
        if i % 6 == 5:
            toxic.add(i)
            own[4:10] = [rng.choice(["vileword", "foulword", "badword"]) for _ in range(6)]
        elif i % 20 == 1:
            own[7:7] = passage
        elif i % 20 == 3:
            own = list(base)
        elif i == 200:
            own = passage[:55]
        texts.append(" ".join(own))
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t)) for i, t in enumerate(texts)]
    rows += [(700, None, None, None, None), (701, "", "en", "s1", 0)]
    # The class prior is the share among labelled rows, so these are drawn at random.
    labels = [(i, 1, int(i in toxic)) for i in range(600) if rng.random() < 0.6]
    path = tmp_path_factory.mktemp("pipeline")
    pq.write_table(pa.table(dict(zip(COLUMNS, zip(*rows), strict=True))), path / "documents.parquet")
    pq.write_table(pa.table(dict(zip(["doc_id", "quality", "toxic"], zip(*labels), strict=True))), path / "labels.parquet")
    return path, toxic


@pytest.fixture(scope="module")
def results(spark, folder):
    """What each stage returned, the input first, as the pipeline writes and rereads it."""
    path, _ = folder
    made = [path / "documents.parquet"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, spark.read.parquet(str(made[-1])), str(path)).write.parquet(str(path / f"stage{i}"))
        made.append(path / f"stage{i}")
    return [spark.read.parquet(str(m)).collect() for m in made]


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(low[i : i + 4]) for i in range(len(low) - 3)] or ([b" ".join(low)] if low else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_toxic_texts_go_and_clean_ones_stay(results, folder):
    _, toxic = folder
    before, after = ({r["doc_id"] for r in rows} for rows in results[:2])
    assert after < before and results[1][0].asDict().keys() == set(COLUMNS)
    assert len(after & toxic) <= 0.05 * len(toxic)
    assert len(after - toxic) >= 0.97 * len(before - toxic)


def test_one_of_each_group_stays(results):
    prints = sorted((r["doc_id"], fingerprint(r["text"])) for r in results[1])
    least = {d: d for d, _ in prints}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for i, (d, a) in enumerate(prints):
        for e, b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                low, high = sorted((root(d), root(e)))
                least[high] = low
    assert sorted(r["doc_id"] for r in results[2]) == [d for d, _ in prints if least[d] == d]
    assert len(results[2]) < len(results[1])


def test_later_passages_go(results):
    given = sorted((r["doc_id"], (r["text"] or "").encode().split(), r["text"]) for r in results[2])
    first = {}
    for d, words, _ in given:
        for j in range(len(words) - 49):
            first.setdefault(tuple(words[j : j + 50]), d)
    want, n_cut = {}, 0
    for d, words, text in given:
        gone = [False] * len(words)
        for j in range(len(words) - 49):
            if first[tuple(words[j : j + 50])] < d:
                gone[j : j + 50] = [True] * 50
        n_cut += any(gone)
        if not gone or not all(gone):
            want[d] = " ".join(w.decode() for w, g in zip(words, gone, strict=True) if not g)
    assert n_cut > 5
    assert {r["doc_id"]: " ".join((r["text"] or "").split()) for r in results[3]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in results[3] if r["text"])


def test_mix_takes_what_sql_takes(results, folder):
    path, _ = folder
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/stage2/*.parquet'")
    taken = {d: n // size for d, size, n in db.sql(f"SELECT doc_id, size, taken FROM ({oracle.OP8})").fetchall() if size}
    found = Counter(r["doc_id"] for r in results[4] if r["text"])
    assert found == Counter({d: n for d, n in taken.items() if n})
    assert max(found.values()) == 2


def test_ids_are_those_of_the_whole_text(results):
    whole = bpe.encoder(bpe.default_ranks(), bpe.default_pattern())
    want = Counter()
    for r in results[4]:
        ids = whole.encode_ordinary(r["text"] or "")
        packed = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want[r["doc_id"], tuple(ids), packed, hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in results[5]) == want


def test_run_gives_the_rows_of_the_last_stage(spark, folder, results):
    rows = corpus_pipeline.run(spark, str(folder[0])).collect()
    assert Counter(map(repr, rows)) == Counter(map(repr, results[5]))


def test_clashing_columns_null_ids_and_empty_tables(spark, folder):
    """Every stage returns the columns it was given, whatever they are called."""
    path, _ = folder
    docs = spark.read.parquet(str(path / "documents.parquet")).where("doc_id < 120 or doc_id > 650")
    names = ["d", "g", "n_words", "kept_text", "size", "copies", "score", "fp", "id", "cell", "a column", "__others"]
    extra = docs.selectExpr("if(doc_id = 50, null, doc_id) as doc_id", "text", "lang", "source", "n_chars", *[f"'x' as `{n}`" for n in names])
    for given in (extra, extra.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, given, str(path))
            assert made.columns == given.columns
            assert {r["a column"] for r in made.collect()} <= {"x"}
        last = corpus_pipeline.STAGES[-1][1](spark, given, str(path))
        assert last.count() == given.count()
