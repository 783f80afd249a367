"""Local dates and times of an area, and the instants they stand for, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A duty day runs from this local hour to the same hour of the next day.
DUTY_DAY_HOUR = 8


def local_to_instant(date: Column, time: Column, zone: Column | str) -> Column:
    """The instant at which the wall clock in `zone` reads date and HH:MM.

    A time that is skipped in spring becomes the first instant after the gap (for zones whose gap starts on an hour and
    lasts one); a time that comes twice in autumn is the earlier one. Not a time, 24:00 included: null."""
    valid = F.when(time.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), time)
    wall = F.try_to_timestamp(F.concat(date.cast("string"), F.lit(" "), valid), F.lit("yyyy-MM-dd HH:mm"))
    found = F.to_utc_timestamp(wall, zone)
    skipped = F.from_utc_timestamp(found, zone) != wall
    return F.when(skipped, F.to_utc_timestamp(F.date_trunc("hour", wall), zone)).otherwise(found)


def zoned_date(at: Column, zone: Column | str) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def zoned_minutes(at: Column, zone: Column | str) -> Column:
    """Minutes since local midnight, as the clock shows them."""
    local = F.from_utc_timestamp(at, zone)
    return F.hour(local) * 60 + F.minute(local)


def iso_weekday(date: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(date) + 1


def duty_date(at: Column, zone: Column | str) -> Column:
    """The date of the duty day that holds an instant; taken off the local clock, so clock changes don't move it."""
    day = zoned_date(at, zone)
    return F.when(zoned_minutes(at, zone) < DUTY_DAY_HOUR * 60, F.date_sub(day, 1)).otherwise(day)


def minutes_of(time: Column) -> Column:
    """HH:MM as minutes."""
    return F.substring(time, 1, 2).cast("int") * 60 + F.substring(time, 4, 2).cast("int")


def time_of(minutes: Column) -> Column:
    """Minutes (taken modulo a day) as HH:MM."""
    m = F.pmod(minutes, F.lit(1440))
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def clock_of_seconds(seconds: Column) -> Column:
    """Seconds from midnight as HH:MM, to the nearest minute; a day and more goes on from 00:00."""
    return time_of(F.floor(seconds / 60 + 0.5).cast("int"))


def normalize_time(raw: Column) -> Column:
    """8:00 becomes 08:00 and 24:00 becomes 00:00; null for what isn't a time."""
    hours, minutes = (F.try_to_number(F.nullif(F.regexp_extract(F.trim(raw), r"^(\d{1,2}):(\d{2})$", i), F.lit("")), F.lit("99")).cast("int") for i in (1, 2))
    fine = (hours < 24) & (minutes < 60) | (hours == 24) & (minutes == 0)
    return F.when(fine, time_of(hours * 60 + minutes))


def is_proper_range(start: Column, end: Column) -> Column:
    """Only 00:00 may lie after midnight, and only after another time."""
    return F.when(end == "00:00", start != "00:00").otherwise(start < end)


def strict_date(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """A date that exists and is written as the pattern writes it; else null."""
    found = F.to_date(F.try_to_timestamp(text, F.lit(pattern)))
    return F.when(F.date_format(found, pattern) == text, found)


def format_duration(minutes: Column) -> Column:
    """90 as `1 h 30 min`."""
    h, m = F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    return F.concat_ws(" ", F.when(h > 0, F.format_string("%d h", h)), F.when((m > 0) | (h == 0), F.format_string("%d min", m)))


def month_period(date: Column) -> tuple[Column, Column]:
    return F.trunc(date, "month"), F.last_day(date)
