"""Message text: picking it out of an entry, folding white space, masking sensitive values.

Everything here maps ``Column`` to ``Column`` with built-in expressions, so a scan that redacts
stays inside whole-stage code generation.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultfold.functions.once import compute_once

# The characters str.split() and str.strip() treat as white space.
LATIN_SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0"
WIDE_SPACE_CLASS = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CLASS = LATIN_SPACE_CLASS + WIDE_SPACE_CLASS
WIDE_SPACE_RANGE = r"[\x{1680}-\x{3000}]"

# Mask patterns, their order and their placeholders.
JWT_PATTERN = r"\beyJhbGciOi[-_a-zA-Z0-9\.]+\.[-_a-zA-Z0-9\.]+\.[-_a-zA-Z0-9\._~]*\b"
EMAIL_PATTERN = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
CARD_PATTERN = r"\b(?:\d[ -]*?){13,16}\b"
SECRET_KEYS = r"(?:api[_-]?key|secret|password|bearer|auth|token)"
SECRET_VALUE = r"[a-zA-Z0-9_\-\.\~]{16,64}"
SECRET_VALUE_STRICT = r"[a-zA-Z0-9_\-\.\~]{16,}"
JWT_MASK = "[REDACTED_JWT]"
EMAIL_MASK = "[REDACTED_EMAIL]"
CARD_MASK = "[REDACTED_CREDIT_CARD]"
SECRET_MASK = "[REDACTED_SECRET]"

# Not masked unless asked for: an international or ten-digit telephone number.
PHONE_PATTERN = r"(?<![\w.])\+?\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?![\w])"
PHONE_MASK = "[REDACTED_PHONE]"

# Unicode noncharacters, reserved for a program's own use; stray ones in the input are escaped.
_OPEN, _MID, _CLOSE, _ESC = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"


def first_message(json_payload: Column, text_payload: Column) -> Column:
    """The structured message when there is one, else the text payload, else ''."""
    structured = F.try_variant_get(json_payload, "$.message", "string")
    return F.coalesce(
        F.nullif(structured, F.lit("")), F.nullif(text_payload, F.lit("")), F.lit("")
    )


def fold_space(text: Column) -> Column:
    """Every run of white space becomes one blank; the ends are trimmed.

    An ASCII text with single blanks only, as most messages are, needs no regular expression. Texts
    without a character from the range of the wide spaces take a class that holds Latin-1
    characters only, which the regex engine tests with a table.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    runs = [F.contains(text, F.lit(c)) for c in ("\n", "  ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")]
    plain = ascii_only & ~functools.reduce(operator.or_, runs)
    wide = text.rlike(WIDE_SPACE_RANGE)
    narrow = F.regexp_replace(text, f"[{LATIN_SPACE_CLASS}]+", " ")
    folded = F.when(wide, F.regexp_replace(text, f"[{SPACE_CLASS}]+", " ")).otherwise(narrow)
    return F.trim(F.when(plain, text).otherwise(folded))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def mask_jwt(text: Column) -> Column:
    masked = F.regexp_replace(text, "(?U)" + JWT_PATTERN, JWT_MASK)
    return F.when(F.contains(text, F.lit("eyJhbGciOi")), masked).otherwise(text)


def mask_email(text: Column) -> Column:
    masked = F.regexp_replace(text, "(?U)" + EMAIL_PATTERN, EMAIL_MASK)
    return F.when(F.contains(text, F.lit("@")), masked).otherwise(text)


def mask_card(text: Column, luhn: bool = False) -> Column:
    """Mask what may be a card number; with ``luhn`` only what has a right check digit.

    The text is cut at its matches and put together again, so that each is judged by itself.
    """
    pattern = "(?U)" + CARD_PATTERN
    if not luhn:
        return F.regexp_replace(text, pattern, CARD_MASK)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    shown = F.transform(found, lambda m: F.when(passes_luhn(m), F.lit(CARD_MASK)).otherwise(m))
    rest = F.split(text, pattern, -1)
    whole = F.array_join(F.zip_with(rest, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    # Most texts have no match at all.
    return F.when(text.rlike(pattern), whole).otherwise(text)


def passes_luhn(number: Column) -> Column:
    """True if the check digit is right: every second digit from the right is doubled, less nine where
    that has two digits, and the sum ends in zero. Other digits than ASCII ones count as right."""
    digits = F.split(F.reverse(F.regexp_replace(number, "[ -]", "")), "")
    value = lambda c, i: F.try_to_number(c, F.lit("9")).cast("int") * (1 + i % 2)
    summed = F.aggregate(
        F.transform(digits, lambda c, i: value(c, i) - F.when(value(c, i) > 9, 9).otherwise(0)),
        F.lit(0).cast("int"),
        lambda a, b: (a + b).cast("int"),
    )
    return F.coalesce(summed % 10 == 0, F.lit(True))


def mask_secret(text: Column, strict: bool = False) -> Column:
    """Mask ``key: value`` and ``key=value`` secrets in one left-to-right pass.

    The colon form keeps its key, the equals form does not. One replacement marks both forms, so
    that neither can eat a part of the other; two more replacements write the masks. ``strict``
    also takes the tail of a value of more than 64 characters.
    """
    value = SECRET_VALUE_STRICT if strict else SECRET_VALUE
    gap = f'["{SPACE_CLASS}]*'
    pattern = f"(?iu)({SECRET_KEYS}{gap})([:=]){gap}{value}"
    escaped = F.replace(text, F.lit(_OPEN), F.lit(_OPEN + _ESC))
    marked = F.regexp_replace(escaped, pattern, f"{_OPEN}$1{_MID}$2{_CLOSE}")
    key = f"{_OPEN}([^{_ESC}{_MID}][^{_MID}]*){_MID}"
    colon = F.regexp_replace(marked, f"{key}:{_CLOSE}", f'$1: "{SECRET_MASK}"')
    both = F.regexp_replace(colon, f"{key}={_CLOSE}", SECRET_MASK)
    masked = F.replace(both, F.lit(_OPEN + _ESC), F.lit(_OPEN))
    return F.when(_may_hold_secret(text) & text.rlike(pattern), masked).otherwise(text)


def _may_hold_secret(text: Column) -> Column:
    """A cheap condition every text with a secret meets: a separator and a part of a key.

    The parts leave out the letters s and i, which the pattern also matches in other forms (ſ, ı).
    """
    separator = F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))
    lowered = F.lower(text)
    parts = [F.contains(lowered, F.lit(p)) for p in ("ap", "ecret", "word", "bearer", "auth", "token")]
    return separator & functools.reduce(operator.or_, parts)


def mask_phone(text: Column) -> Column:
    return F.regexp_replace(text, PHONE_PATTERN, PHONE_MASK)


def redacted(df: DataFrame, text: Column, out: str, strict: bool = False) -> DataFrame:
    """``df`` with ``out``: the text with folded space and all masks.

    The guards look at their input several times, so each step is computed once.
    """
    step = compute_once(df, _m0=text)
    step = compute_once(step, _m1=fold_space(F.col("_m0")))
    step = compute_once(step, _m2=mask_email(mask_jwt(F.col("_m1"))))
    step = compute_once(step, _m3=mask_card(F.col("_m2")))
    step = compute_once(step, **{out: mask_secret(F.col("_m3"), strict)})
    return step.drop("_m0", "_m1", "_m2", "_m3")


def redact(text: Column, strict: bool = False, phones: bool = False, luhn: bool = False) -> Column:
    """All masks in their fixed order: token, e-mail, card, secret."""
    text = mask_secret(mask_card(mask_email(mask_jwt(text)), luhn), strict)
    return mask_phone(text) if phones else text
