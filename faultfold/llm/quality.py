"""Operator 5: line-first quality rules.

Every line is judged by itself first (punctuation, navigation, boilerplate, repetition); lines that
fail are removed, and a document that loses too much of its text that way is rejected. One pass over
the texts, row by row; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from faultfold.llm.common import batches_of

#: Fixed values of the base rules.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"

#: A document is rejected when lines with more than this share of its word characters fail.
MOST_LOST = 0.3
#: A line fails the punctuation rule with more symbols than this share of its words ...
MOST_SYMBOLS = 0.25
#: ... or with more than this share of its words shouted ("WORD!!").
MOST_SHOUTED = 0.5
#: A line of at least so many words has to end a sentence, at its end or on the way.
SENTENCE_WORDS = 12
#: Lines of at most so many words are taken for navigation when cut up by separators.
MENU_WORDS = 40

_GAP = re.compile(r"[\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SHOUTED = re.compile(r"!!+(?=[\x20\x09-\x0D]|$)")
_END = re.compile(r"[.!?:;…。！？؟।][\"'”’»)\]]*(?=[\x20\x09-\x0D]|$)")
_SEPARATOR = re.compile(r"(?:^|[\x20\x09-\x0D])[|»>›•·/]+(?=[\x20\x09-\x0D]|$)")
_BOILERPLATE = re.compile(
    r"\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)"
    r"|accept (?:all )?cookies|enable javascript|click here|read more|sign up|log ?in|subscribe"
    r"|lorem ipsum|skip to (?:main )?content|share (?:this|on))\b",
    re.IGNORECASE,
)

METRICS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
        ("lost_share", pa.float64()),
        ("clean_text", pa.string()),
    ]
)


def split_words(text: str) -> list[str]:
    return [w for w in _GAP.split(text) if w]


def repeated_words(words: list[str]) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def failed_rule(line: str, words: list[str], seen: bool) -> str | None:
    """The first rule a line with words breaks, or None."""
    n = len(words)
    if seen and n > 3:
        return "repetition"
    if len(_SYMBOL.findall(line)) > MOST_SYMBOLS * n + 1:
        return "navigation" if _SEPARATOR.search(line) and n <= MENU_WORDS else "punctuation"
    if len(_SHOUTED.findall(line)) > MOST_SHOUTED * n:
        return "punctuation"
    if n <= MENU_WORDS and len(_SEPARATOR.findall(line)) >= 2:
        return "navigation"
    if n >= SENTENCE_WORDS and not _END.search(line):
        return "punctuation"
    if n <= MENU_WORDS and _BOILERPLATE.search(line):
        return "boilerplate"
    return None


def judge(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost, clean)."""
    text = text or ""
    words = split_words(text)
    n_words, chars = len(words), sum(map(len, words))
    seen: set[str] = set()
    clean, lost, dup = [], 0, 0
    for line in text.split("\n"):
        own = split_words(line)
        if not own:
            clean.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if failed_rule(line, own, again):
            lost += sum(map(len, own))
        else:
            clean.append(line)
    repeated = repeated_words(words)
    base_failed = n_words < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * n_words
    share = lost / chars if chars else 0.0
    kept = not base_failed and share <= MOST_LOST
    symbols = len(_SYMBOL.findall(text))
    return n_words, chars, symbols, dup, repeated, base_failed, kept, share, "\n".join(clean)


def line_rules(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Judge every row of ``docs`` (doc_id, text).

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    lost_share (word characters in failed lines), clean_text (the lines that passed; left out with
    ``with_text=False``).

    Cases: null and empty texts have no words and fail the base rule; a null doc_id is passed on;
    repeated rows are judged alike; an empty table gives no rows; other columns are left out.
    """
    schema = METRICS if with_text else METRICS.remove(len(METRICS) - 1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text")
            sizes = texts.to_pylist()
            for start, stop in batches_of(sizes, lambda t: len(t or ""), 4 << 20):
                judged = list(zip(*map(judge, sizes[start:stop]), strict=True))
                columns = [part.column("doc_id").slice(start, stop - start)]
                columns += [pa.array(v, f.type) for v, f in zip(judged, list(METRICS)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(columns[: len(schema)], schema=schema)

    ddl = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_share double" + ", clean_text string" * with_text
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)
