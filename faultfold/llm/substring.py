"""Operator 3: substring dedup with automata of repeated phrases.

A window is ``WINDOW`` consecutive words; a word is removed when a window over it also starts in a
document with a smaller doc_id.

1. *Confirm recurring phrases.* Of every window, the ``PHRASE``-word phrase with the smallest hash is
   selected. Equal windows select equal phrases, so a window that recurs has a selected phrase that
   recurs; phrases of only one document are dropped. About one phrase in twenty words travels.
2. *Compile sharded automata.* Texts are dealt to groups of bounded size. A group's automaton holds
   the recurring phrases its own texts can meet, so every text is streamed through one automaton
   however many phrases the corpus repeats.
3. *Stream all documents.* Every occurrence is located, and the windows around it are named by a
   96-bit hash. The smallest doc_id of each name decides, and the windows of later documents go back
   to their group, where the words they cover are removed.

Exact copies are settled first by digests of whole texts: a text seen in a smaller document loses all
its words if it has a window, and none otherwise. The three passes read one shuffle of the texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from faultfold.llm.common import U64, batches_of, give_back, inverse, mixed, powers, text_groups

WINDOW = 50
#: Words of a phrase; a window of 50 has 39 phrases of 12.
PHRASE = 12
#: Text of one group, and of what is parsed at a time.
GROUP_BYTES = 4 << 20
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_TABLES = _rng.integers(1 << 63, size=(2, 256), dtype=np.int64).astype(U64) * U64(2) + U64(1)
_STEP = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_ROLL = (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LAST = (1 << 63) - 1


@dataclass
class Chunk:
    """Some texts as one row of words. Word ``i`` lies in text ``row[i]`` and is its word ``place[i]``."""

    flat: bytes
    starts: np.ndarray
    row: np.ndarray
    place: np.ndarray
    left: np.ndarray
    hashes: tuple[np.ndarray, np.ndarray]


def parse(texts: list[bytes], first_row: int) -> Chunk:
    """Words of ``texts`` joined by single spaces (one also in front and behind), with two hashes each."""
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    solid = ~_BLANK[joined]
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = end - begin
    n = len(begin)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    edges = np.searchsorted(begin, offsets)
    counts = np.diff(edges)
    row = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(n) - edges[row]
    left = counts[row] - place
    body = joined[solid]
    heads = np.cumsum(lengths) - lengths
    hashes = []
    for table, step in zip(_TABLES, _STEP, strict=True):
        if not n:
            hashes.append(np.empty(0, U64))
            continue
        within = np.arange(len(body)) - np.repeat(heads, lengths)
        value = table[body] * powers(step, int(lengths.max()))[within]
        hashes.append(mixed(np.add.reduceat(value, heads) + lengths.astype(U64)))
    flat = np.full(int(lengths.sum()) + n + 1, 0x20, np.uint8)
    starts = 1 + heads + np.arange(n)
    flat[np.repeat(starts - heads, lengths) + np.arange(len(body))] = body
    return Chunk(flat.tobytes(), starts, row + first_row, place, left, (hashes[0], hashes[1]))


def rolling(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = len(hashes)
    if n < size:
        return np.empty(0, U64)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(hashes * powers(base, n), dtype=U64)))
    return mixed((total[size:] - total[:-size]) * powers(inverse(base), n - size + 1))


def _slide(values: np.ndarray, size: int, pick) -> np.ndarray:
    done = 1
    while done * 2 <= size:
        values = pick(values[:-done], values[done:])
        done *= 2
    return pick(values[: len(values) - (size - done)], values[size - done :]) if done < size else values


def selected(chunk: Chunk, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the phrases that have the smallest hash of some window."""
    hashes = rolling(chunk.hashes[0], phrase, _ROLL[0]) | U64(1)
    span = window - phrase + 1
    if len(hashes) < span:
        return np.empty(0, np.int64), np.empty(0, U64)
    least = _slide(hashes, span, np.minimum)
    least[chunk.left[: len(least)] < window] = 0
    padded = np.concatenate((np.zeros(span - 1, U64), least, np.zeros(span - 1, U64)))
    at = np.flatnonzero(_slide(padded, span, np.maximum) == hashes)
    return at, hashes[at]


def automaton(phrases: dict[int, str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for key, text in phrases.items():
        made.add_word(text, key)
    if len(made):
        made.make_automaton()
    return made


def occurrences(made: ahocorasick.Automaton, chunk: Chunk, phrase: int = PHRASE) -> np.ndarray:
    """Word indexes at which a phrase of the automaton starts and ends in one text."""
    if not len(made):
        return np.empty(0, np.int64)
    # Bytes as characters one to one; the automaton takes text.
    ends = np.fromiter((e for e, _ in made.iter(chunk.flat.decode("latin-1"))), np.int64)
    last = np.searchsorted(chunk.starts, ends, "left") - 1
    at = np.unique(last - (phrase - 1))
    at = at[at >= 0]
    return at[chunk.left[at] >= phrase]


def windows_at(chunk: Chunk, at: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> np.ndarray:
    """Starts of the windows that hold one of the occurrences."""
    n = len(chunk.row)
    if not len(at) or n < window:
        return np.empty(0, np.int64)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, np.maximum(at + phrase - window, 0), 1)
    np.add.at(delta, at + 1, -1)
    return np.flatnonzero((np.cumsum(delta[:n]) > 0) & (chunk.left >= window))


def _rows_of(left: pa.Table) -> pa.Table:
    return left.sort_by([("__d", "ascending"), ("__tk", "ascending")])


def _copies_of(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Which rows of a group are copies of a text of a smaller document."""
    right = right.filter(right.column("__kind").to_numpy() == 1)
    known = set(zip(right.column("__d").to_pylist(), right.column("__tk").to_pylist(), strict=True))
    if not known:
        return np.zeros(left.num_rows, bool)
    own = zip(left.column("__d").to_pylist(), left.column("__tk").to_pylist(), strict=True)
    return np.fromiter((x in known for x in own), bool, left.num_rows)


def _chunks(left: pa.Table, right: pa.Table) -> list[Chunk]:
    copy = _copies_of(left, right)
    texts = [
        b"" if gone or t is None else t.encode()
        for t, gone in zip(left.column("text").to_pylist(), copy, strict=True)
    ]
    return [parse(texts[a:b], a) for a, b in batches_of(texts, len, CHUNK_BYTES)]


def substring_dedup(docs: DataFrame, *keep: str, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Remove repeated passages from every row of ``docs`` (doc_id, text).

    Columns: doc_id, ``keep``, n_words, n_removed, kept_sha256 and, ``with_text``, kept_text: the
    kept words joined by one space, or the text as it was where nothing is removed.

    Cases: null and empty texts have no words; a null doc_id counts as larger than all others; rows
    that repeat a doc_id are judged each and never against one another; texts shorter than a window
    lose nothing; words longer than a chunk are one word; an empty table gives no rows; other
    columns are left out. ``keep`` may not name a column of the result.
    """
    clash = {"doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"} & set(keep)
    if clash:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    phrase = min(PHRASE, window)
    groups = text_groups(docs, GROUP_BYTES)
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))

    # By document and text, so that rows without a doc_id spread too.
    group = F.pmod(F.xxhash64("__d", "__tk"), F.lit(groups)).alias("__g")
    texts = docs.select(
        d.alias("__d"), F.xxhash64("text").alias("__tk"), "text", F.col("doc_id").cast("long").alias("doc_id"), *keep
    )
    texts = texts.select(group, "*")
    dealt = texts.groupBy("__g")

    # Exact copies: rows whose whole text is also that of a smaller document.
    digest = docs.where("text is not null").select(
        d.alias("__d"), F.xxhash64("text").alias("__tk"), F.md5(F.col("text").cast("binary")).alias("__digest")
    )
    first = digest.groupBy("__digest").agg(F.min("__d").alias("__first"))
    copies = digest.join(first, "__digest").where("__d > __first")
    copies = copies.select(group, F.lit(1).alias("__kind"), "__d", "__tk").distinct()

    def phrases(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _rows_of(left)
        ids = left.column("__d").to_numpy()
        found = [(selected(c, window, phrase), c) for c in _chunks(left, right)]
        h = np.concatenate([x for (_, x), _ in found] + [np.empty(0, U64)]).view(np.int64)
        own = np.concatenate([ids[c.row[at]] for (at, _), c in found] + [np.empty(0, np.int64)])
        order = np.lexsort((own, h))
        h, own = h[order], own[order]
        heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
        tails = np.concatenate((heads[1:], [len(h)])) - 1 if len(h) else heads
        g = left.column("__g")[0].as_py() if left.num_rows else 0
        return pa.table(
            {"__g": pa.array(np.full(len(heads), g)), "__h": pa.array(h[heads]), "__lo": pa.array(own[heads]), "__hi": pa.array(own[tails])}
        )

    made = dealt.cogroup(copies.groupBy("__g")).applyInArrow(phrases, "__g long, __h long, __lo long, __hi long")
    same = Window.partitionBy("__h")
    recurring = made.select("__g", "__h", F.min("__lo").over(same).alias("__lo"), F.max("__hi").over(same).alias("__hi"))
    recurring = recurring.where("__lo < __hi").select("__g", F.lit(0).alias("__kind"), F.col("__h").alias("__d"), F.lit(0).cast("long").alias("__tk"))

    def locate(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _rows_of(left)
        ids = left.column("__d").to_numpy()
        known = np.sort(right.filter(right.column("__kind").to_numpy() == 0).column("__d").to_numpy().view(U64))
        chunks = _chunks(left, right) if len(known) and left.num_rows else []
        shard: dict[int, str] = {}
        for c in chunks:
            at, h = selected(c, window, phrase)
            near = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i, key in zip(at[known[near] == h].tolist(), h[known[near] == h].tolist(), strict=True):
                if key not in shard:
                    stop = c.starts[i + phrase] if i + phrase < len(c.starts) else len(c.flat)
                    shard[key] = c.flat[c.starts[i] - 1 : stop].decode("latin-1")
        machine = automaton(shard)
        g = left.column("__g")[0].as_py() if left.num_rows else 0
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        for c in chunks:
            at = windows_at(c, occurrences(machine, c, phrase), window, phrase)
            if len(at):
                out[0].append(rolling(c.hashes[0], window, _ROLL[0])[at].view(np.int64))
                out[1].append((rolling(c.hashes[1], window, _ROLL[1])[at] >> U64(32)).astype(np.uint32).view(np.int32))
                out[2].append(ids[c.row[at]])
                out[3].append(c.row[at].astype(np.int64) << 32 | c.place[at])
        made = pa.table({n: pa.array(np.concatenate(v)) for n, v in zip(("__k1", "__k2", "__d", "__at"), out, strict=True)})
        del chunks, machine, shard, out
        give_back()
        return made.add_column(0, "__g", pa.array(np.full(made.num_rows, g)))

    hints = recurring.unionByName(copies)
    windows = dealt.cogroup(hints.groupBy("__g")).applyInArrow(locate, "__g long, __k1 long, __k2 int, __d long, __at long")
    owner = F.min("__d").over(Window.partitionBy("__k1", "__k2"))
    later = windows.withColumn("__owner", owner).where("__owner < __d")
    gone = later.select("__g", F.lit(2).alias("__kind"), "__d", F.col("__at").alias("__tk"))

    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())]
    added += [StructField("kept_text", StringType())] * with_text
    fields = StructType([StructField("doc_id", LongType()), *[texts.schema[c] for c in keep], *added])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _rows_of(left)
        copy = _copies_of(left, right)
        at = right.filter(right.column("__kind").to_numpy() == 2).column("__tk").to_numpy()
        at = np.sort(at)
        edges = np.searchsorted(at >> 32, np.arange(left.num_rows + 1))
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for i, text in enumerate(left.column("text")):
            text = text.as_py()
            words = text.encode().split() if text else []
            n = len(words)
            mask = np.zeros(n, bool)
            if copy[i]:
                mask[:] = n >= window
            elif edges[i + 1] > edges[i]:
                delta = np.zeros(n + 1, np.int64)
                begin = at[edges[i] : edges[i + 1]] & 0xFFFFFFFF
                np.add.at(delta, begin, 1)
                np.add.at(delta, begin + window, -1)
                mask = np.cumsum(delta[:n]) > 0
            removed = int(mask.sum())
            kept = b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m] if removed else words)
            n_words.append(n)
            n_removed.append(removed)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_texts.append(kept.decode() if removed else text)
        out = {"doc_id": left.column("doc_id")} | {c: left.column(c) for c in keep}
        out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            out["kept_text"] = pa.array(kept_texts, pa.string())
        made = pa.table(out)
        del left, kept_texts
        give_back()
        return made

    return dealt.cogroup(gone.unionByName(copies).groupBy("__g")).applyInArrow(remove, fields)
