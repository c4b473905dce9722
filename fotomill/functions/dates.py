"""Dates as the library's own rules read them (functions.timestamps reads all written forms)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}:\d{2}"


def capture_time(text: Column, fraction: bool = True) -> Column:
    """TIMESTAMP_NTZ of 'day clock', 'dayTclock', with a fraction after T if asked for, or a day (then 12:00); else null."""
    part = r"(\.\d+)?" if fraction else ""
    return F.when(text.rlike(f"^{_DAY}( {_CLOCK}|T{_CLOCK}{part})$"), text.try_cast("timestamp_ntz")).when(
        text.rlike(f"^{_DAY}$"), text.try_cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")
    )


def exif_day(text: Column) -> Column:
    """'yyyy:MM:dd …' as 'yyyy-MM-dd'; other texts unchanged."""
    return F.when(F.substring(text, 5, 1) == ":", F.replace(F.substring(text, 1, 10), F.lit(":"), F.lit("-"))).otherwise(text)


def normalised_day(text: Column, as_of_year: int | None = None) -> Column:
    """exif_day(); with as_of_year, texts of other forms become its first of January (the legacy rule)."""
    other = text if as_of_year is None else F.lit(f"{as_of_year}-01-01")
    return F.when(F.substring(text, 5, 1) == ":", exif_day(text)).otherwise(other)


def is_invalid_date(text: Column) -> Column:
    """Whether a date is one of the cameras' placeholders; only their colon form counts."""
    return F.startswith(text, F.lit("1970:01:01")) | F.startswith(text, F.lit("0000:00:00"))


def month_name(day: Column) -> Column:
    """English month name, 'Unknown' for null."""
    return F.coalesce(F.date_format(day, "MMMM"), F.lit("Unknown"))
