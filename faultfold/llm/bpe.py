"""Operator 4: byte-level BPE encoding and decoding over a global table of distinct words.

1. Texts are cut into pre-tokens. A batch of texts keeps its own list of distinct pre-tokens and, per
   position, its number in that list. Both are written once to the shared folder.
2. The distinct pre-tokens of all batches are shuffled by their hash, and each is encoded once.
3. The ids travel back to their batch and are put in place by position.
4. Decoding looks every id up in the token-byte table, whose size is that of the vocabulary.

What is shuffled is the vocabulary of each batch and one small number per position, never texts.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.llm.common import give_back
from faultfold.session import work_dir

#: About so many characters of text make a batch; it is what one task holds when ids are put in place.
BATCH_CHARS = 32 << 20
#: Distinct pre-tokens are dealt to one group for every so many characters of text.
GROUP_CHARS = 16 << 20


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes in a row, and start and length by id."""
    ranks = read_ranks(path)
    n = 1 + max(ranks.values())
    table = [b""] * n
    for token, i in ranks.items():
        table[i] = token
    lengths = np.fromiter(map(len, table), np.int64, n)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, lengths


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``flat[s : s + l]`` for every start and length, one after another."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
    return flat[at]


def decode(ids: np.ndarray, path: str) -> bytes:
    flat, starts, lengths = token_bytes(path)
    return gather(flat, starts[ids], lengths[ids]).tobytes()


class PreTokens(dict):
    """Distinct pre-tokens of a batch, numbered as they come; chunks of text are cut only once.

    A single space between two other characters always starts a pre-token, so what lies between two
    such spaces is cut the same way wherever it stands. Texts with two white space characters in a
    row, or with one at an end, are cut as a whole.
    """

    _plain = re.compile(r"\s\s|^\s|\s$")

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.numbers: dict[str, int] = {}

    def __missing__(self, chunk: str) -> list[int]:
        numbers = self.numbers
        made = [numbers.setdefault(w, len(numbers)) for w in self.find(chunk)]
        self[chunk] = made
        return made

    def cut(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self._plain.search(text) or not text.strip():
            numbers = self.numbers
            made = [numbers.setdefault(w, len(numbers)) for w in self.find(text)]
            return np.array(made, np.uint32)
        first, *rest = text.split(" ")
        out = list(self[first])
        for chunk in rest:
            out += self[" " + chunk]
        return np.array(out, np.uint32)


def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of significance, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(9).compress(np.ascontiguousarray(planes).tobytes())


def _loosen(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _pack(words: list[bytes]) -> tuple[bytes, bytes]:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return _squeeze(lengths), zstandard.ZstdCompressor(9).compress(b"".join(words))


def _unpack(lengths: bytes, flat: bytes) -> list[bytes]:
    flat = zstandard.ZstdDecompressor().decompress(flat)
    ends = np.cumsum(_loosen(lengths), dtype=np.int64).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


_CUT = pa.schema(
    [
        ("batch", pa.int64()),
        ("part", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.binary()),
        ("data", pa.binary()),
        ("numbers", pa.binary()),
    ]
)


def pre_tokens(docs: DataFrame, pattern: str, groups: int, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """One row per batch and one per share (``part``) of its distinct pre-tokens.

    The row of a batch (part null) has its doc_ids, the pre-tokens of each text (lengths), all their
    numbers by position (data; frequent pre-tokens have small numbers) and the number of each
    pre-token in the order of the shares (numbers). A share has the pre-tokens themselves.

    A batch is named by its task and count, so the result has to be written before it is used twice.
    """

    def flush(batch: int, table: PreTokens, doc_ids: list, rows: list[np.ndarray]) -> pa.RecordBatch:
        words = [w.encode() for w in table.numbers]
        flat = np.concatenate([*rows, np.empty(0, np.uint32)])
        often = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        number = np.empty(len(words), np.uint32)
        number[often] = np.arange(len(words), dtype=np.uint32)
        shares: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            shares.setdefault(zlib.crc32(w) % groups, []).append(i)
        order, out = [], []
        for part in sorted(shares):
            own = sorted(shares[part], key=words.__getitem__)
            order += own
            out.append((batch, part, None, *_pack([words[i] for i in own]), None))
        lengths = _squeeze(np.fromiter(map(len, rows), np.uint32, len(rows)))
        placed = number[np.array(order, np.int64)]
        out.append((batch, None, doc_ids, lengths, _squeeze(number[flat]), _squeeze(placed)))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CUT, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=_CUT)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 32
        table, doc_ids, rows, chars = PreTokens(pattern), [], [], 0
        for part in parts:
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                text = text.as_py() or ""
                doc_ids.append(doc_id)
                rows.append(table.cut(text))
                chars += len(text)
                if chars >= batch_chars:
                    yield flush(batch, table, doc_ids, rows)
                    batch, table, doc_ids, rows, chars = batch + 1, PreTokens(pattern), [], [], 0
        if rows:
            yield flush(batch, table, doc_ids, rows)
        del table, rows
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "batch long, part long, doc_ids array<long>, lengths binary, data binary, numbers binary"
    )


def encode_words(cut: DataFrame, path: str, pattern: str) -> DataFrame:
    """(batch, part, lengths, ids): the ids of each share of a batch; a pre-token is encoded once."""

    def run(table: pa.Table) -> pa.Table:
        piece = encoder(path, pattern)._core_bpe.encode_single_piece
        known: dict[bytes, list[int]] = {}
        lengths, ids = [], []
        for a, b in zip(table.column("lengths"), table.column("data"), strict=True):
            own = []
            for word in _unpack(a.as_py(), b.as_py()):
                made = known.get(word)
                if made is None:
                    made = known[word] = piece(word)
                own.append(made)
            lengths.append(_squeeze(np.fromiter(map(len, own), np.uint32, len(own))))
            ids.append(_squeeze(np.fromiter((i for x in own for i in x), np.uint32, sum(map(len, own)))))
        return pa.table(
            {
                "batch": table.column("batch"),
                "part": table.column("part"),
                "lengths": pa.array(lengths, pa.binary()),
                "ids": pa.array(ids, pa.binary()),
            }
        )

    words = cut.where("part is not null").select("batch", "part", "lengths", "data")
    return words.groupBy("part").applyInArrow(run, "batch long, part long, lengths binary, ids binary")


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_bpe(
    docs: DataFrame,
    path: str | None = None,
    pattern: str | None = None,
    with_ids: bool = False,
    batch_chars: int = BATCH_CHARS,
) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text) and decode the ids again.

    Columns: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the decoded bytes) and, ``with_ids``, ids (array of int). ``path`` names the
    rank file on every machine, ``pattern`` the expression that cuts texts. Texts are cut at single spaces
    first, so a pattern has to start a match at a single space between two other characters, as the
    default one does. ``batch_chars`` of text is what a task holds.

    Cases: a null text counts as empty and has no tokens; a null doc_id is passed on; repeated rows
    are encoded each; very long texts make a batch of their own; an empty table gives no rows; other
    columns are left out.
    """
    spark = docs.sparkSession
    path, pattern = path or default_ranks(), pattern or default_pattern()
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    groups = max(4, int(chars) // GROUP_CHARS)
    folder = work_dir(spark, "pre-tokens")
    pre_tokens(docs, pattern, groups, batch_chars).write.option("compression", "none").parquet(folder)
    cut = spark.read.parquet(folder)
    texts = cut.where("part is null").select("batch", "doc_ids", "lengths", "data", "numbers")

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right.column("part")))
        none = np.empty(0, np.uint32)
        by_share = np.concatenate([*(_loosen(b.as_py()) for b in right.column("lengths")), none])
        flat = np.concatenate([*(_loosen(b.as_py()) for b in right.column("ids")), none])
        begins = np.cumsum(by_share, dtype=np.int64) - by_share
        number = _loosen(left.column("numbers")[0].as_py())
        starts, lengths = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
        starts[number], lengths[number] = begins, by_share
        ends = np.cumsum(_loosen(left.column("lengths")[0].as_py()), dtype=np.int64)
        positions = np.split(_loosen(left.column("data")[0].as_py()), ends[:-1])
        counts, ids_sha, text_sha, all_ids = [], [], [], []
        for at in positions:
            ids = gather(flat, starts[at], lengths[at])
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            text_sha.append(hashlib.sha256(decode(ids, path)).hexdigest())
            if with_ids:
                all_ids.append(ids.astype(np.int32))
        out = {
            "doc_id": left.column("doc_ids").combine_chunks().flatten(),
            "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": pa.array(ids_sha, pa.string()),
            "decoded_sha256": pa.array(text_sha, pa.string()),
        }
        if with_ids:
            out["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
        made = pa.table(out)
        del positions, flat, all_ids
        give_back()
        return made

    ids = encode_words(cut, path, pattern)
    return (
        texts.groupBy("batch")
        .cogroup(ids.groupBy("batch"))
        .applyInArrow(put, _DIGESTS + ", ids array<int>" * with_ids)
    )
