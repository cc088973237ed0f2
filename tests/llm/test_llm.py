"""The operators against brute force, on small tables with nulls, ties, repeats and odd columns."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from faultfold.llm import ann, bpe, licenses, mixing, quality, sharding, simhash, substring, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, base = text(80), text(300)
    texts = [None, "", " \n\t", "a", text(3), base, base, base[:-1] + "z", text(40) + "\n" + shared + " " + text(60)]
    texts += [text(20) + " " + shared, shared + " " + shared, text(5000), "x" * 20000, "the same words " * 70]
    texts += [base.upper(), "  two  spaces\r\n  and 's 12 日本 ", text(49), text(50), text(51)]
    rows = [(i * 3 % 31, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None), (7, shared, "en", None, 0), (7, shared, "en", None, 0)]
    return [(*r, -1, -1) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_substring_dedup(docs):
    own = [(r[0] if r[0] is not None else 1 << 63, r[0], (r[1] or "").encode().split()) for r in corpus()]
    first = {}
    for d, _, words in own:
        for j in range(len(words) - 49):
            key = tuple(words[j : j + 50])
            first[key] = min(d, first.get(key, d))
    want = []
    for d, doc_id, words in own:
        gone = [False] * len(words)
        for j in range(len(words) - 49):
            if first[tuple(words[j : j + 50])] < d:
                gone[j : j + 50] = [True] * 50
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert any(w[2] for w in want)
    assert rows(substring.substring_dedup(docs)) == sorted(want, key=repr)


def test_simhash_components(docs):
    table = []
    for doc_id, text, *_ in corpus():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        shingles = [b" ".join(low[i : i + 4]) for i in range(len(low) - 3)] or ([b" ".join(low)] if low else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        table.append((doc_id, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    groups = list(range(len(table)))
    for _ in table:
        for i, (_, a) in enumerate(table):
            for j, (_, b) in enumerate(table):
                if (a ^ b).bit_count() <= 4:
                    groups[i] = groups[j] = min(groups[i], groups[j])
    least = defaultdict(list)
    for g, (doc_id, _) in zip(groups, table, strict=True):
        least[g] += [doc_id] if doc_id is not None else []
    want = [(d, f"{f:016x}", min(least[g])) for g, (d, f) in zip(groups, table, strict=True)]
    found = simhash.simhash_components(docs).select("doc_id", "fingerprint", "component_id")
    assert rows(found) == sorted(want, key=repr)


def test_pivot_cells_lose_no_link():
    rng = np.random.default_rng(1)
    seed = rng.integers(0, 1 << 63, 6, dtype=np.int64).astype(np.uint64)
    values = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for s in seed]))
    found = list(range(len(values)))

    def root(x):
        while found[x] != x:
            x = found[x]
        return x

    for i, j in simhash.cell_forest(values):
        assert (int(values[i]) ^ int(values[j])).bit_count() <= 4
        found[root(i)] = root(j)
    for i in range(len(values)):
        for j in range(i):
            if (int(values[i]) ^ int(values[j])).bit_count() <= 4:
                assert root(i) == root(j)


@pytest.mark.parametrize("cell_rows", [5, 40, 4096])
def test_cut_cells_lose_no_link(spark, cell_rows):
    """One template makes a hot cell: it is cut again and every link stays."""
    rng = np.random.default_rng(4)
    flips = rng.integers(0, 20, (700, 6)).astype(np.uint64)
    values = np.unique(np.uint64(0x5A5A123400000000) ^ np.bitwise_or.reduce(np.uint64(1) << flips, axis=1))
    nodes = [(int(v), i) for i, v in enumerate(values.view(np.int64))]
    found = simhash.links(spark.createDataFrame(nodes, "fp long, id long"), 4, cell_rows).collect()
    bits = np.bitwise_count(values[:, None] ^ values[None, :])
    group = list(range(len(values)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for r in found:
        assert bits[r["a"], r["b"]] <= 4
        group[root(r["a"])] = root(r["b"])
    for i, j in zip(*np.nonzero(bits <= 4), strict=True):
        assert root(int(i)) == root(int(j))
    cells, n = simhash.cells(spark.createDataFrame(nodes, "fp long, id long"), 4, cell_rows)
    largest = max(r["count"] for r in cells.groupBy("cell").count().collect())
    assert cells.count() <= n and (cell_rows > 5 or largest < len(values) / 3)


def test_one_of_each(spark):
    base = " ".join(f"w{i}" for i in range(60))
    table = [(5, base, 1), (3, base, 2), (3, base, 3), (None, base, 4), (None, "alone here", 5), (None, "alone here", 6)]
    table += [(9, None, 7), (8, "", 8), (4, "two texts", 9), (4, "one identity but another text", 10)]
    names = "doc_id long, text string, __kept int, fp int, id int, component int, component_id int"
    given = spark.createDataFrame([(*r, 0, 0, 0, 0) for r in table], names)
    kept = simhash.one_of_each(given)
    assert kept.columns == given.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert got == sorted([(3, base), (0, "alone here"), (8, ""), (4, "two texts"), (4, "one identity but another text")])
    assert simhash.one_of_each(given.where("false")).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 95), (95, 93)], "a long, b long")
    want = {i: 0 for i in range(41)} | {90: 90, 95: 90, 93: 90}
    assert dict(rows(simhash.components(edges))) == want


def test_byte_bpe(docs):
    whole = bpe.encoder(bpe.default_ranks(), bpe.default_pattern())
    want = []
    for doc_id, text, *_ in corpus():
        ids = whole.encode_ordinary(text or "")
        packed = np.array(ids, "<u4").tobytes()
        want.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows(bpe.byte_bpe(docs)) == sorted(want, key=repr)


def test_mix(docs):
    found = [r.asDict() for r in mixing.systematic_mix(docs).collect()]
    assert sorted(map(repr, found)) == sorted(repr(r.asDict()) for r in mixing.systematic_mix(docs).collect())
    sizes = defaultdict(int)
    for r in corpus():
        sizes[r[3]] += len((r[1] or "").encode().split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    assert len(found) == len(corpus())
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    emitted = Counter(r[1] for r in mixing.mixed_documents(docs).select("doc_id", "text").collect())
    assert sum(emitted.values()) == sum(r["copies"] for r in found)


def test_hash_tree(docs):
    found = sharding.hash_tree_shards(docs).collect()
    assert len(found) == len(corpus())
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sums = sorted((len((t[1] or "").encode()) + 16, zlib.crc32((t[1] or "").encode())) for t in corpus())
    assert sorted((r["size"], r["text_crc32"]) for r in found) == sums


def test_hash_tree_like_independent_draws(docs):
    """Shard, grown shard and slot of every row, by draws that are made here."""
    racks = [(f"r{i // 2}", f"k{i}", list(range(4 * i, 4 * i + 4))) for i in range(10)]

    def draw(key, name, weight):
        bits = xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(key.encode(), 42)) >> 11
        return -math.log((bits + 0.5) / (1 << 53)) / weight

    def shard(key, racks):
        regions = {}
        for r, k, shards in racks:
            regions.setdefault(r, []).append((k, shards))
        region = min(regions, key=lambda r: draw(key, r, sum(len(s) for _, s in regions[r])))
        rack = min(regions[region], key=lambda x: draw(key, f"{region}/{x[0]}", len(x[1])))
        return min(rack[1], key=lambda n: draw(key, f"shard {n}", 1))

    want, placed = [], defaultdict(list)
    for doc_id, text, *_ in corpus():
        key, raw = "null" if doc_id is None else str(doc_id), (text or "").encode()
        cell = xxhash.xxh64_intdigest(key.encode(), 42)
        cell = (cell - (1 << 64) if cell >> 63 else cell) % sharding.CELLS
        row = (doc_id, len(raw) + 16, zlib.crc32(raw), "key", shard(key, racks), shard(key, [*racks, ("r+40", "k+40", [40])]))
        placed[row[4]].append(((cell, doc_id is None, doc_id or 0, row[2], row[1]), row))
    for rows_ in placed.values():
        want += [(*row[:5], slot, row[5]) for slot, (_, row) in enumerate(sorted(rows_, key=lambda x: x[0]))]
    assert rows(sharding.hash_tree_shards(docs)) == sorted(want, key=repr)


def test_hash_tree_follows_weights(spark):
    tree = (
        sharding.Region("a", (sharding.Rack("x", (sharding.Shard(0, 3.0), sharding.Shard(1, 1.0))),)),
        sharding.Region("b", (sharding.Rack("y", (sharding.Shard(2, 4.0),)),)),
    )
    keys = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text")
    n = Counter(r["shard"] for r in sharding.hash_tree_shards(keys, tree).select("shard").collect())
    assert abs(n[0] / 7500 - 1) < 0.05 and abs(n[1] / 2500 - 1) < 0.08 and abs(n[2] / 10000 - 1) < 0.05


def test_quality():
    assert quality.repeated_words("a b c a b c d".split()) == 6
    good = "\n".join(" ".join(f"w{i}x{j}" for i in range(15)) + "." for j in range(6))
    assert quality.judge(good)[5:7] == (False, True)
    menu = "\n".join(f"Home | Shop{i} | Help | Login{i}" for i in range(20))
    assert quality.judge(good[:200] + ".\n" + menu)[6] is False
    assert quality.judge(None) == quality.judge("") and quality.judge(None)[5] is True
    assert quality.judge(good + "\n" + good)[3] == 6


def test_toxicity_learns_from_unlabelled(spark):
    rng = random.Random(2)
    table, marks = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        own = [rng.choice("red green blue sun moon tree stone river".split()) for _ in range(30)]
        if toxic:
            own[3:5] = [rng.choice(["vileword", "foulword"]), rng.choice(["vileword", "foulword"])]
        table.append((i, " ".join(own), 1.0))
        if i % 2 == 0:
            marks.append((i, int(toxic)))
    table += [(None, None, 0.0), (5000, "", 0.0)]
    labels = spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, toxic int")
    found = toxicity.toxicity(spark.createDataFrame(table, "doc_id long, text string, score double"), labels).collect()
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1500]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found if r["doc_id"] is not None)
    right = sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held)
    assert right / len(held) > 0.97 and all(0 <= r["score"] <= 1 for r in found)


def toxic_corpus(rng, n, share):
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    signs = ["vileword", "foulword", "badword", "nastyword"]
    rows, toxic = [], set()
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        if rng.random() < share:
            toxic.add(i)
            words[3:6] = [rng.choice(signs) for _ in range(3)]
        rows.append((i, " ".join(words)))
    return rows, toxic


@pytest.mark.parametrize("share, seen", [(0.03, 0.3), (0.1, 0.25), (0.3, 0.25), (0.5, 0.25), (0.3, 1.0), (0.1, 1.0)])
def test_toxicity_at_every_share(spark, share, seen):
    """Held-out recall and false positives, also where every toxic text is confirmed."""
    rng = random.Random(int(100 * share))
    rows_, toxic = toxic_corpus(rng, 3000, share)
    labels = [(i, 1, int(i in toxic)) for i, _ in rows_ if rng.random() < seen]
    docs_ = spark.createDataFrame(rows_, "doc_id long, text string")
    found = toxicity.toxicity(docs_, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in found if r["held_out"]]
    caught = [r["predicted"] for r in held if r["doc_id"] in toxic]
    alarms = [r["predicted"] for r in held if r["doc_id"] not in toxic]
    assert sum(caught) >= 0.9 * len(caught) and sum(alarms) <= (0.03 if share < 0.5 else 0.06) * len(alarms)


@pytest.mark.parametrize("confirmed", [0.0, 0.1, 0.3])
def test_risk_and_gradient_like_brute_force(confirmed):
    rng = np.random.default_rng(2)
    p, u = rng.random((7, 5)) < 0.5, rng.random((11, 5)) < 0.4
    w, prior = rng.standard_normal(6), 0.3

    def parts(w):
        score = lambda x: 1 / (1 + np.exp(-(x @ w[:5] + w[5])))
        everything = (1 - confirmed) * -np.log(1 - score(u)).mean() + confirmed * -np.log(1 - score(p)).mean()
        return prior * -np.log(score(p)).mean(), everything - prior * -np.log(1 - score(p)).mean()

    sparse = lambda x: (*(i.astype(np.int32) for i in np.nonzero(x)), len(x))
    above, below, g_pos, g_neg = toxicity.risk(w, sparse(p), sparse(u), prior, confirmed)
    assert np.allclose((above, below), parts(w), atol=1e-12)
    for k in range(6):
        step = np.eye(6)[k] * 1e-6
        slopes = (np.array(parts(w + step)) - np.array(parts(w - step))) / 2e-6
        assert np.allclose(slopes, (g_pos[k], g_neg[k]), atol=1e-7)


def test_licenses(spark):
    note = "Licensed under the Apache License, Version 2.0."
    files = [("a/LICENSE", note), ("a/b/c.txt", "code"), ("a/b/d/e.txt", None), ("f/g.txt", "# Released under the MIT License."), ("f/h.txt", ""), (None, "x"), ("a/b/d/COPYING", "This work is licensed under the GNU General Public License, version 3.")]
    found = {r["path"]: (r["license"], r["inherited_from"]) for r in licenses.license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert found["a/b/c.txt"] == ("Apache-2.0", "a") and found["a/b/d/e.txt"] == ("GPL-3.0", "a/b/d")
    assert found["f/g.txt"] == ("MIT", None) and found["f/h.txt"] == (None, None) and found[None] == (None, None)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 16))
    v[100:160] = v[99]
    data = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    data += [(9000, None, 0), (9020, [0.0] * 16, 0), (9040, [float("nan")] * 16, 0), (9060, [None] * 16, 0)]
    found = ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>, rank int"), shard_rows=700).collect()
    hit = 0
    by = defaultdict(list)
    for r in found:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 3000, 20):
        s = v @ v[q]
        order = [int(i) for i in np.lexsort((np.arange(3000), -np.round(s, 9))) if i != q][:20]
        hit += len(set(order) & {x[1] for x in by[q]})
        assert [x[0] for x in sorted(by[q])] == list(range(1, 21))
        # Scores are exact, nearest first, and equal ones go to the smaller id.
        assert all(abs(score - math.fsum(a * b for a, b in zip(v[q], v[i], strict=True))) < 1e-12 for _, i, score in by[q])
        assert sorted(by[q]) == [(k + 1, *x[1:]) for k, x in enumerate(sorted(by[q], key=lambda x: (-x[2], x[1])))]
    assert hit / (150 * 20) >= 0.9 and set(by) == set(range(0, 3000, 20))


@pytest.mark.parametrize("split", ["128m", "900"])
def test_warc_rejects_records_in_payloads(spark, split):
    inner = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    payloads = ["", None, inner * 3, "x" * 5000 + inner + "y" * 3000, warc.MAGIC * 40, "same", "same", inner * 90]
    data = [(i, f"u{i}", p) for i, p in enumerate(payloads)] + [(None, None, "same"), (2, "u", payloads[2])]
    best = {}
    for i, _, p in data:
        if i is not None:
            best[p or ""] = max(i, best.get(p or "", -1))
    want = []
    for i, _, p in data:
        raw, top = (p or "").encode(), best.get(p or "")
        again = top is not None and (i is None or i < top)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = rows(warc.warc_round_trip(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(2)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == sorted(want, key=repr)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    made = [substring.substring_dedup(none), simhash.simhash_components(none), bpe.byte_bpe(none), mixing.systematic_mix(none), sharding.hash_tree_shards(none), quality.line_rules(none)]
    assert [m.count() for m in made] == [0] * 6
