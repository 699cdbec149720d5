"""Column functions that turn register text into typed values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .semantics import hours_between, strip_blanks, to_number

# Day 0 of the spreadsheet calendar, and the two date layouts accepted.
SERIAL_EPOCH = "1899-12-30"
# Serials of 0001-01-01 and of the end of 9999-12-31.
FIRST_SERIAL, AFTER_LAST_SERIAL = -693593.0, 2958466.0
DATED_TEXT = r"^\d{4}[-/]"
FULL_STAMP = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}[ T]\d{1,2}:\d{1,2}:\d{1,2}"


def serial_to_timestamp(days: Column) -> Column:
    """Spreadsheet day number (with day fraction) to a time stamp without zone.

    A number outside the calendar is no date and gives NULL.
    """
    days = F.when((days >= FIRST_SERIAL) & (days < AFTER_LAST_SERIAL), days)
    micros = F.round(days * F.lit(86400.0 * 1e6)).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.expr(f"timestamp_ntz'{SERIAL_EPOCH} 00:00:00'"))


def _dated(col: Column) -> Column:
    return F.coalesce(col.rlike(DATED_TEXT), F.lit(False))


def _stamp_or(col: Column, days: Column) -> Column:
    stamp = F.regexp_replace(F.trim(col), "/", "-").try_cast("timestamp_ntz")
    return F.when(_dated(col), F.when(col.rlike(FULL_STAMP), stamp)).otherwise(serial_to_timestamp(days))


def parse_mixed_datetime(col) -> Column:
    """Text that is either a y-m-d h:m:s stamp or a spreadsheet day number."""
    col = F.col(col) if isinstance(col, str) else col
    return _stamp_or(col, to_number(col))


def _day_number(date, time) -> Column:
    date = F.col(date) if isinstance(date, str) else date
    time = F.col(time) if isinstance(time, str) else time
    return to_number(date) + F.coalesce(to_number(time), F.lit(0.0))


def serial_date_plus_time(date, time) -> Column:
    """Day number plus day fraction, both text; a missing time is midnight."""
    return serial_to_timestamp(_day_number(date, time))


def with_stamps(df: DataFrame, mixed: Mapping[str, str] | None = None, serial: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """New columns from text: ``mixed`` as parse_mixed_datetime of one column, ``serial`` as serial_date_plus_time of two.

    The day numbers are parsed in a projection of their own, once for each cell, and then compared with the calendar.
    """
    mixed, serial = dict(mixed or {}), dict(serial or {})
    days = {n: to_number(F.when(~_dated(F.col(c)), F.col(c))) for n, c in mixed.items()}
    days.update({n: _day_number(*cs) for n, cs in serial.items()})
    held = df.withColumns({f"__{n}_days": d for n, d in days.items()})
    stamps = {n: _stamp_or(F.col(c), F.col(f"__{n}_days")) for n, c in mixed.items()}
    stamps.update({n: serial_to_timestamp(F.col(f"__{n}_days")) for n in serial})
    return held.withColumns(stamps).drop(*[f"__{n}_days" for n in days])


def haul_duration(start, end, reported: Column | None = None) -> Column:
    """Hours between two stamps; NULL when not positive.

    ``reported`` (hours) is used where one of the stamps is missing.
    """
    hours = hours_between(start, end)
    if reported is not None:
        hours = F.coalesce(hours, reported)
    return F.when(hours > 0, hours)


def calendar_parts(ts) -> list[Column]:
    return [
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.dayofyear(ts).alias("day"),
    ]


def clean_numeric_text(col, default: str | None = "0") -> Column:
    """Blanks out, missing text replaced, then to double."""
    col = F.col(col) if isinstance(col, str) else col
    text = strip_blanks(col)
    if default is not None:
        text = F.coalesce(text, F.lit(default))
    return to_number(text)


def kg_to_tonnes_fallback(tonnes, kilos) -> Column:
    tonnes = F.col(tonnes) if isinstance(tonnes, str) else tonnes
    kilos = F.col(kilos) if isinstance(kilos, str) else kilos
    return F.coalesce(tonnes, kilos / 1000)


def force_south_west(col) -> Column:
    """Positions are in the south-west quadrant, so a positive value lost its sign."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col > 0, -col).otherwise(col)
