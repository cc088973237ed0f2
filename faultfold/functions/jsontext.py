"""JSON as text: strict parsing, compact writing, and the size with escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultfold.functions.once import compute_once

def parse_whole(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the value when the whole of ``text`` is one JSON value, else null.

    The parser stops after the first value, so '{"a":1} x' would pass. Inside brackets anything
    after the value is an error or a second element, except a closing bracket, which ends the list
    early; texts that hold one are parsed inside braces too.
    """
    t = F.col(text)
    listed = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    braced = F.try_parse_json(F.concat(F.lit('{"e":'), t, F.lit("}")))
    closed = F.when(F.contains(t, F.lit("]")), braced.isNotNull()).otherwise(F.lit(True))
    parsed = compute_once(df, _listed=listed, _closed=closed)
    alone = F.try_variant_get("_listed", "$[1]", "variant").isNull()
    value = F.when(alone & F.col("_closed"), F.try_variant_get("_listed", "$[0]", "variant"))
    return compute_once(parsed, **{out: value}).drop("_listed", "_closed")


def opens_object(text: Column) -> Column:
    """Whether a text known to be JSON is an object; its first character tells."""
    return text.rlike(r"^[ \t\n\r]*\{")


def compact_json(row: Column) -> Column:
    """Minified JSON with nulls kept."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def escaped_bytes(json_text: Column) -> Column:
    """Bytes of the text when everything outside printable ASCII is written as an escape.

    An escape takes 6 bytes, and 12 for a character of four UTF-8 bytes. With C characters in B
    bytes, of which n3 and n4 take three and four, the escapes add 4(B - C) - 5 n3 - 4 n4. Only
    texts with such characters are searched for them. U+007F is one byte and becomes six.
    """
    size = F.octet_length(json_text)
    chars = F.char_length(json_text)
    n3 = F.char_length(F.regexp_replace(json_text, r"[^\x{800}-\x{ffff}]+", ""))
    n4 = F.char_length(F.regexp_replace(json_text, r"[^\x{10000}-\x{10ffff}]+", ""))
    wide = F.when(json_text.rlike(r"[\x{800}-\x{10ffff}]"), n3 * 5 + n4 * 4).otherwise(0)
    delete = F.lit("\x7f")
    deletes = F.when(
        F.contains(json_text, delete), chars - F.char_length(F.replace(json_text, delete, F.lit("")))
    ).otherwise(0)
    escaped = size + (size - chars) * 4 - F.when(size == chars, 0).otherwise(wide)
    return (escaped + deletes * 5).cast("bigint")
