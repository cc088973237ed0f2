"""Operator 12: ranked lexical search over bit-sliced Bloom signatures.

1. *Index.* Documents are dealt to blocks of like length. A document's signature is a Bloom filter of
   its terms, once for each of the ``LEVELS`` of occurrences it reaches; a block keeps them bit by bit, so
   that a slice is one bit of all its documents. Lengths and compressed whole texts lie beside them.
2. *Bounds.* The slices of a term, taken together by AND, are a bitmap of the documents that may hold
   it; it errs to one side only. Weighted sums of such bitmaps over the terms of an item, each level
   with the most that its occurrences can be worth in a document of that length, are upper bounds.
3. *Threshold.* The documents with the highest bounds are scored exactly. The tenth best exact score
   of an item is one that its answer reaches at least.
4. *Rescoring.* Every document whose bound reaches the threshold is scored exactly on its whole text;
   the others are proven to score less.

Texts are never shuffled: an item's candidates travel, at most so many per task as are asked for.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from faultfold.llm.common import U64, give_back, mixed
from faultfold.session import settle, work_dir

#: Occurrences from which a term is entered once more; below the next level a term has the next less one.
LEVELS = (1, 2, 3, 5)
#: Bits of a signature for each entry, and slices that an entry sets.
BITS_PER_ENTRY = 10
HASHES = 4
#: Documents and bytes of text of one block.
BLOCK_ROWS = 1024
BLOCK_BYTES = 2 << 20
#: Documents per item and answer wanted that are scored for the threshold.
PROBES = 3
#: Terms, repeats included, of the items that are searched in one pass; they go to every task.
PASS_TERMS = 200_000
#: Items whose bounds are held at a time.
STEP = 32
#: Hashes of terms that a task remembers.
REMEMBERED = 500_000

_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_INDEX = "block long, ids array<long>, lengths binary, most binary, width long, slices binary, texts array<binary>, term string, n long"


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and all beyond ASCII, A-Z in lower case."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


def places(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """The slices that entries of ``hashes`` at ``level`` set, one row each."""
    first = mixed(hashes + U64(level))
    second = mixed(first ^ U64(0x9E3779B97F4A7C15)) | U64(1)
    steps = np.arange(HASHES, dtype=U64)
    return ((first[:, None] + steps * second[:, None]) % U64(width)).astype(np.int64)


class Block:
    """Documents of like length that wait for their slices."""

    def __init__(self):
        self.ids, self.lengths, self.most, self.texts, self.entries = [], [], [], [], []
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes, found: list[bytes], counts: Counter, known: dict[bytes, int]) -> None:
        hashes = np.fromiter((known[t] if t in known else known.setdefault(t, xxh64_intdigest(t)) for t in counts), U64, len(counts))
        often = np.fromiter(counts.values(), np.int64, len(counts))
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.most.append(int(often.max()))
        self.entries.append([hashes[often >= level] for level in LEVELS])
        self.texts.append(zstandard.ZstdCompressor(3).compress(text))
        self.bytes += len(text)

    def row(self, number: int) -> dict:
        n = len(self.ids)
        width = max(64, BITS_PER_ENTRY * max(sum(map(len, e)) for e in self.entries))
        bits = np.zeros((width, -(-n // 8) * 8), bool)
        for i, entry in enumerate(self.entries):
            for level, hashes in enumerate(entry):
                bits[places(hashes, level, width).ravel(), i] = True
        return {
            "block": number, "ids": self.ids, "lengths": np.array(self.lengths, "<i8").tobytes(), "most": np.array(self.most, "<i8").tobytes(),
            "width": width, "slices": np.packbits(bits, axis=1).tobytes(), "texts": self.texts, "term": None, "n": None,
        }


_ARROW = pa.schema(
    [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("most", pa.binary()), ("width", pa.int64()), ("slices", pa.binary()), ("texts", pa.list_(pa.binary())), ("term", pa.string()), ("n", pa.int64())]
)


def index(docs: DataFrame, path: str, vocabulary: set[bytes]) -> None:
    """Write blocks of ``docs`` (doc_id, text), and how many documents of a task hold each term of the
    vocabulary (n; the term ``*`` counts documents with a term, ``+`` all their terms)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        known: dict[bytes, int] = {}
        waiting: dict[int, Block] = {}
        frequency: Counter[bytes] = Counter()
        for part in parts:
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                text = text.as_py()
                found = terms(text)
                if not found:
                    continue
                counts = Counter(found)
                frequency.update(vocabulary & counts.keys())
                frequency[b"*"] += 1
                frequency[b"+"] += len(found)
                # Half a power of two apart, so that signatures of one width suit all of a block.
                kind = int(2 * math.log2(len(counts)))
                block = waiting.setdefault(kind, Block())
                block.add(doc_id, text.encode(), found, counts, known)
                if len(block.ids) >= BLOCK_ROWS or block.bytes >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist([waiting.pop(kind).row(number)], _ARROW)
                    number += 1
                if len(known) > REMEMBERED:
                    known.clear()
        for block in waiting.values():
            yield pa.RecordBatch.from_pylist([block.row(number)], _ARROW)
            number += 1
        if frequency:
            yield pa.RecordBatch.from_pylist([{"term": t.decode(), "n": n} for t, n in frequency.items()], _ARROW)
        waiting.clear()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _INDEX)
    rows.write.option("compression", "none").parquet(path)


class Items:
    """The items of one pass: their distinct terms with weights, and the terms of each with repeats."""

    def __init__(self, texts: list[tuple[int, str]], frequency: dict[str, int]):
        self.documents, self.total = frequency.get("*", 0), frequency.get("+", 0)
        self.numbers = [i for i, _ in texts]
        own = [Counter(terms(t)) for _, t in texts]
        self.vocabulary = {t: j for j, t in enumerate(dict.fromkeys(t for c in own for t in c))}
        weights = [
            math.floor(1000 * math.log((2 * self.documents + 2) / (2 * frequency.get(t.decode(), 0) + 1)))
            for t in self.vocabulary
        ]
        self.hashes = np.fromiter(map(xxh64_intdigest, self.vocabulary), U64, len(self.vocabulary))
        self.term = np.array([self.vocabulary[t] for c in own for t in c], np.int64)
        again = np.array([n for c in own for n in c.values()], np.int64)
        self.weight = np.array(weights, np.int64)[self.term] * again if len(self.term) else np.empty(0, np.int64)
        self.starts = np.cumsum([0, *map(len, own)])

    def measures(self, lengths: np.ndarray) -> np.ndarray:
        """m of documents with so many terms."""
        return 25 + (75 * lengths * self.documents) // self.total

    def bounds(self, row: dict) -> Iterator[tuple[int, np.ndarray]]:
        """(first item, upper bounds of its and the next items' scores) over the documents of a block."""
        n = len(row["ids"])
        slices = np.frombuffer(row["slices"], np.uint8).reshape(row["width"], -1)
        most = np.frombuffer(row["most"], "<i8")
        m = self.measures(np.frombuffer(row["lengths"], "<i8"))
        worth, maps = [], []
        for level in range(len(LEVELS)):
            at = places(self.hashes, level, row["width"])
            found = slices[at[:, 0]]
            for k in range(1, HASHES):
                found = found & slices[at[:, k]]
            maps.append(found)
            cap = np.minimum(most, LEVELS[level + 1] - 1) if level + 1 < len(LEVELS) else most
            worth.append((1_000_000_000 * cap) // (1000 * cap + 8 * m))
        for a in range(0, len(self.numbers), STEP):
            edges = self.starts[a : a + STEP + 1]
            term, weight = self.term[edges[0] : edges[-1]], self.weight[edges[0] : edges[-1]]
            total = np.zeros((len(edges) - 1, n), np.int64)
            for level, found in enumerate(maps):
                has = np.unpackbits(found[term], axis=1, count=n)
                # A float sum of whole numbers below 2**53 is exact.
                sums = np.add.reduceat(has * weight[:, None].astype(np.float64), edges[:-1] - edges[0], axis=0)
                total += sums.astype(np.int64) * (worth[level] - (worth[level - 1] if level else 0))
            yield a, total

    def scores(self, text: bytes, length: int, items: np.ndarray) -> np.ndarray:
        """Exact scores of one document for ``items``."""
        counts = np.zeros(len(self.vocabulary), np.int64)
        for t, c in Counter(zstandard.ZstdDecompressor().decompress(text).translate(_TERM_BYTES).split()).items():
            j = self.vocabulary.get(t)
            if j is not None:
                counts[j] = c
        m = int(self.measures(np.array([length], np.int64))[0])
        worth = (1_000_000_000 * counts) // (1000 * counts + 8 * m)
        return np.array([int((self.weight[a:b] * worth[self.term[a:b]]).sum()) for a, b in zip(self.starts[items], self.starts[items + 1], strict=True)], np.int64)


class Best:
    """The highest-scoring rows of each item, equal ones by ascending id, rows without an id last."""

    def __init__(self, items: int, most: int):
        self.rows: list[list[tuple]] = [[] for _ in range(items)]
        self.most = most

    def least(self) -> np.ndarray:
        """The score from which on a row can still enter."""
        return np.array([-r[-1][0] if len(r) == self.most else 0 for r in self.rows], np.int64)

    def add(self, item: int, score: int, doc_id: int | None, *rest: int) -> None:
        own = self.rows[item]
        insort(own, (-score, doc_id is None, doc_id or 0, *rest))
        del own[self.most :]


def _first(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` highest rows of each item; per task there are no more than that to begin with."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place")
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= most)


def _search(blocks: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of the items of one pass."""
    count = len(items.numbers)
    schema = "item long, score long, doc_id long, block long, place long"

    def table(best: Best) -> pa.RecordBatch:
        rows = [(items.numbers[i], -r[0], None if r[1] else r[2], *r[3:]) for i, own in enumerate(best.rows) for r in own]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "score", "doc_id", "block", "place"])

    def bound(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(count, PROBES * k)
        for part in parts:
            for row in _rows(part, ["block", "ids", "lengths", "most", "width", "slices"]):
                least = best.least()
                for a, bounds in items.bounds(row):
                    for i, own in enumerate(bounds):
                        above = np.flatnonzero(own > least[a + i])
                        if len(above) > best.most:
                            above = above[np.argpartition(-own[above], best.most)[: best.most]]
                        for j in above.tolist():
                            best.add(a + i, int(own[j]), row["ids"][j], row["block"], j)
        yield table(best)

    def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(count, k)
        at = {number: i for i, number in enumerate(items.numbers)}
        for part in parts:
            for row in _rows(part, ["block", "ids", "lengths", "texts", "picks"]):
                lengths = np.frombuffer(row["lengths"], "<i8")
                chosen: dict[int, list[int]] = {}
                for pick in row["picks"]:
                    chosen.setdefault(pick["place"], []).append(at[pick["item"]])
                for j, wanted in chosen.items():
                    wanted = np.array(wanted)
                    for i, score in zip(wanted, items.scores(row["texts"][j], int(lengths[j]), wanted), strict=True):
                        if score > 0:
                            best.add(int(i), int(score), row["ids"][j], row["block"], j)
        yield table(best)

    slim = blocks.select("block", "ids", "lengths", "most", "width", "slices")
    picks = settle(_first(slim.mapInArrow(bound, schema), PROBES * k))
    by_block = picks.groupBy("block").agg(F.collect_list(F.struct("place", "item")).alias("picks"))
    # No more rows than the items of a pass ask for, whatever the size of the corpus.
    probed = blocks.select("block", "ids", "lengths", "texts").join(F.broadcast(by_block), "block")
    reached = _first(probed.mapInArrow(probe, schema), k).where(F.col("rank") == k).select("item", "score").collect()
    threshold = {r["item"]: r["score"] for r in reached}
    floor = np.array([max(1, threshold.get(i, 1)) for i in items.numbers], np.int64)

    def rescore(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(count, k)
        for part in parts:
            for row in _rows(part, ["block", "ids", "lengths", "most", "width", "slices", "texts"]):
                lengths = np.frombuffer(row["lengths"], "<i8")
                least = np.maximum(floor, best.least())
                wanted: dict[int, list[int]] = {}
                for a, bounds in items.bounds(row):
                    # Equal to the threshold is not excluded: the smaller id may win.
                    for i, j in zip(*np.nonzero(bounds >= least[a : a + len(bounds), None]), strict=True):
                        wanted.setdefault(int(j), []).append(a + int(i))
                for j, own in wanted.items():
                    own = np.array(own)
                    found = items.scores(row["texts"][j], int(lengths[j]), own)
                    for i, score in zip(own[found > 0], found[found > 0], strict=True):
                        best.add(int(i), int(score), row["ids"][j], row["block"], j)
        yield table(best)
        give_back()

    return _first(blocks.mapInArrow(rescore, schema), k)


def _rows(part: pa.RecordBatch, names: list[str]) -> Iterator[dict]:
    for i in range(part.num_rows):
        yield {n: part.column(n)[i].as_py() for n in names}


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents of ``docs`` (doc_id, text) that score highest for each of ``items`` (item_id, text).

    Columns: item_id, rank (from 1), doc_id, score. Only scores above zero; equal ones by ascending
    doc_id. The items are a stated query set: they are read in passes of ``PASS_TERMS`` terms.

    Cases: null texts and texts without terms match nothing; documents without an id count and come
    last among equals; of repeated documents each counts; repeated items (id and text) count once;
    an item without matches gives no rows; empty tables give no rows; other columns are left out.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    asked = settle(asked.dropDuplicates().withColumn("item", F.monotonically_increasing_id()))
    passes: list[list[tuple[int, str]]] = []
    left = 0
    for row in asked.select("item", "text").orderBy("item").toLocalIterator():
        size = len(terms(row["text"]))
        if size and size > left:
            passes.append([])
            left = max(PASS_TERMS, size)
        if size:
            passes[-1].append((row["item"], row["text"]))
            left -= size
    found = None
    for texts in passes:
        vocabulary = {t for _, text in texts for t in terms(text)}
        path = work_dir(spark, "signatures")
        index(docs, path, vocabulary)
        made = spark.read.schema(_INDEX).parquet(path)
        counted = made.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()
        frequency = {r["term"]: r["n"] for r in counted}
        if not frequency.get("*"):
            continue
        own = settle(_search(made.where("block is not null").drop("term", "n"), Items(texts, frequency), k))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
