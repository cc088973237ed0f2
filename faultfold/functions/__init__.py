"""Column functions, and their registration for SQL callers."""

from __future__ import annotations

from pyspark.sql import SparkSession

from faultfold.functions import severity, text


def _raw(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    """Offer the main functions to SQL as SQL functions, which Catalyst inlines as expressions.

    ``fold_space(s)``, ``normalize_impact(s)`` and ``fault_signature(labels, severity, message)``.
    """
    spaces = _raw(f"[{text.SPACE_CLASS}]+")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION fold_space(s STRING) RETURNS STRING "
        f"RETURN trim(regexp_replace(s, {spaces}, ' '))"
    )
    cases = " ".join(
        f"WHEN contains(upper(s), '{level}') THEN '{level}'" for level in severity.IMPACTS
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION normalize_impact(s STRING) RETURNS STRING "
        f"RETURN CASE {cases} ELSE 'UNKNOWN' END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION fault_signature"
        "(labels MAP<STRING, STRING>, severity STRING, message STRING) RETURNS STRING "
        "RETURN md5(concat_ws('|', "
        "coalesce(to_json(map_from_entries(sort_array(map_entries(labels)))), '{}'), "
        "upper(coalesce(severity, '')), coalesce(message, '')))"
    )
    _register_redact(spark)


def _register_redact(spark: SparkSession) -> None:
    gap = f'["{text.SPACE_CLASS}]*'
    secret = f"(?iu)({text.SECRET_KEYS}{gap})([:=]){gap}{text.SECRET_VALUE}"
    key = r"\x{fdd0}([^\x{fdd3}\x{fdd1}][^\x{fdd1}]*)\x{fdd1}"
    plain = (
        f"regexp_replace(regexp_replace(regexp_replace(s, {_raw('(?U)' + text.JWT_PATTERN)}, "
        f"'{text.JWT_MASK}'), {_raw('(?U)' + text.EMAIL_PATTERN)}, '{text.EMAIL_MASK}'), "
        f"{_raw('(?U)' + text.CARD_PATTERN)}, '{text.CARD_MASK}')"
    )
    marked = (
        f"regexp_replace(replace({plain}, '\\uFDD0', '\\uFDD0\\uFDD3'), {_raw(secret)}, "
        "'\\uFDD0$1\\uFDD1$2\\uFDD2')"
    )
    both = (
        f"regexp_replace(regexp_replace({marked}, {_raw(key + ':' + chr(92) + 'x{fdd2}')}, "
        f"'$1: \"{text.SECRET_MASK}\"'), {_raw(key + '=' + chr(92) + 'x{fdd2}')}, "
        f"'{text.SECRET_MASK}')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION redact(s STRING) RETURNS STRING "
        f"RETURN replace({both}, '\\uFDD0\\uFDD3', '\\uFDD0')"
    )
