"""Values as the operator sees them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
SHOWN = "yyyy-MM-dd HH:mm:ss"


def present(value: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(value, F.lit(""))


def or_dash(value: Column) -> Column:
    return F.coalesce(present(value), F.lit(DASH))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, ISO_MICROS)


def show_timestamp(text: Column) -> Column:
    """A dash for nothing, the raw text when it is no date, else a fixed UTC format."""
    looks_dated = text.rlike(r"^\d{4}-\d{2}-\d{2}")
    shown = F.date_format(F.try_to_timestamp(text), SHOWN)
    return F.coalesce(F.when(looks_dated, shown), present(text), F.lit(DASH))
