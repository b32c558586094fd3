"""Lenient casts of provider values: blank means null, junk is counted, never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def to_int(value: Column) -> Column:
    return blank_to_null(value).try_cast("int")


def to_long(value: Column) -> Column:
    return blank_to_null(value).try_cast("bigint")


def to_double(value: Column) -> Column:
    return blank_to_null(value).try_cast("double")


def to_number(value: Column) -> Column:
    """A number that may carry a trailing percent sign."""
    return blank_to_null(F.regexp_replace(F.trim(value.cast("string")), r"%$", "")).try_cast("double")


def to_bool(value: Column) -> Column:
    text = F.lower(blank_to_null(value))
    return F.when(text.isNotNull(), text.isin("1", "true", "yes"))


def to_date(value: Column) -> Column:
    return blank_to_null(value).try_cast("date")


def unreadable(value: Column, cast: Column) -> Column:
    """True where a value is present but the cast gave nothing."""
    return blank_to_null(value).isNotNull() & cast.isNull()
