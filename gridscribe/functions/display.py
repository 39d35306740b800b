"""Typed values as the text that a sheet shows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decimals(fmt: Column) -> Column:
    """Places after the point that a number format asks for."""
    return F.length(F.regexp_extract(fmt, r"\.(0+)", 1))


def general(value: Column) -> Column:
    """Six significant digits, without zeros at the end; large and small ones with an exponent."""
    # %g of the JVM keeps trailing zeros and turns to exponents at other sizes than C does, so it is put together here.
    size = F.floor(F.log10(F.abs(value)))
    places = F.greatest(F.lit(0), 5 - size).cast("int")
    short = _places(value, places)
    trimmed = F.when(F.contains(short, F.lit(".")), F.regexp_replace(F.regexp_replace(short, "0+$", ""), r"\.$", "")).otherwise(short)
    # Six digits as a whole number, half to even; rounding up to seven moves the exponent.
    six = F.bround(F.abs(value) / F.pow(F.lit(10.0), size - 5)).cast("long")
    more = (six == 1_000_000).cast("int")
    digits = F.when(more == 1, "100000").otherwise(six.cast("string"))
    mantissa = F.regexp_replace(F.regexp_replace(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5)), "0+$", ""), r"\.$", "")
    exponent = size + more
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    mantissa = F.concat(F.when(value < 0, "-").otherwise(""), mantissa)
    return F.when(value == 0, "0").when((size >= 6) | (size < -4), F.concat(mantissa, F.lit("e"), power)).otherwise(trimmed)


def _places(value: Column, places: Column) -> Column:
    """Fixed places, rounded half to even on the exact value."""
    return F.replace(F.call_function("format_number", value.cast("double"), places), F.lit(","), F.lit(""))


def number_text(value: Column, fmt: Column | str = "General") -> Column:
    """A number through its format: percent, thousands, fixed places; else the integer or six significant digits."""
    fmt = F.substring_index(F.coalesce(fmt if isinstance(fmt, Column) else F.lit(fmt), F.lit("General")), ";", 1)
    value = value.cast("double")
    percent = F.contains(fmt, F.lit("%"))
    shown = F.when(percent, value * 100).otherwise(value)
    grouped = F.contains(fmt, F.lit("#,#")) | F.contains(fmt, F.lit("0,0"))
    places = decimals(fmt)
    with_groups = F.call_function("format_number", shown, places)
    whole = F.format_number(shown, 0)
    fixed = F.when(grouped, with_groups).otherwise(F.replace(with_groups, F.lit(","), F.lit("")))
    free = F.when(grouped, F.call_function("format_number", shown, F.lit("#,##0.################"))).otherwise(general(shown))
    integer = F.when(grouped, whole).otherwise(F.replace(whole, F.lit(","), F.lit("")))
    body = F.when(places > 0, fixed).when(shown == F.floor(shown), integer).otherwise(free)
    return F.when(value.isNotNull(), F.concat(body, F.when(percent, "%").otherwise("")))


def bool_text(value: Column) -> Column:
    return F.upper(value.cast("string"))


def timestamp_text(value: Column) -> Column:
    """Day first; the time only where it is not midnight."""
    midnight = F.date_trunc("day", value) == value
    return F.when(midnight, F.date_format(value, "dd/MM/yyyy")).otherwise(F.date_format(value, "dd/MM/yyyy HH:mm"))


def date_text(value: Column) -> Column:
    return F.date_format(value, "dd/MM/yyyy")


def display(column: Column, kind: T.DataType, fmt: Column | str = "General") -> Column:
    """Any value as text; null is the empty text."""
    if isinstance(kind, T.BooleanType):
        shown = bool_text(column)
    elif isinstance(kind, T.DateType):
        shown = date_text(column)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        shown = timestamp_text(column)
    elif isinstance(kind, T.NumericType):
        shown = number_text(column, fmt)
    else:
        shown = column.cast("string")
    return F.coalesce(shown, F.lit(""))
