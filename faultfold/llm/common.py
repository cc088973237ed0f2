"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space. ``bytes.split()`` cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
_MASK = (1 << 64) - 1


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; null has none."""
    return text.encode().split() if text else []


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    out = np.empty(n, U64)
    if n:
        out[:] = U64(base & _MASK)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def inverse(base: int) -> int:
    """The inverse of an odd number modulo 2**64."""
    return pow(base, -1, 1 << 64)


def batches_of(column: list, weight, limit: int) -> Iterator[tuple[int, int]]:
    """Cut a list into runs ``[start, stop)`` of about ``limit`` in summed weight."""
    start = total = 0
    for i, value in enumerate(column):
        total += weight(value)
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(column):
        yield start, len(column)


def text_groups(docs: DataFrame, group_bytes: int, column: str = "text") -> int:
    """How many groups of about ``group_bytes`` of text a table makes; one number goes to the driver."""
    total = docs.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0
    return max(1, -(-int(total) // group_bytes))


def arrow_table(schema: pa.Schema, **columns) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema=schema)


def give_back() -> None:
    """Return freed memory to the system. Workers are used again, and what one stage has freed but
    still holds would count against the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
