"""Schedule grammars: headings and notes as column expressions, free-typed schedules as a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orarium.functions.text import squash, strip_accents
from orarium.functions.timez import is_proper_range, normalize_time

# Greek weekdays without accents, Monday first; the words of a heading that tell its kind, in the order
# in which they are looked for.
WEEKDAYS = ("δευτερα", "τριτη", "τεταρτη", "πεμπτη", "παρασκευη", "σαββατο", "κυριακη")
KINDS = (("μετα τα μεσανυχτα", "after-midnight"), ("διανυκτερ", "overnight"), ("εφημερ", "on-duty"), ("σαββατο", "saturday-extra"), ("ημερ|λειτουργ", "day"))
CLOCK = r"\d{1,2}:\d{2}"


def window_of(start: Column, end: Column) -> Column:
    """A window from two printed times; it ends the next day where it doesn't end after it starts."""
    a, b = normalize_time(start), normalize_time(end)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("from"), b.alias("to"), (b <= a).alias("toNextDay")))


def heading(text: Column) -> Column:
    """kind and hours (null where none are printed) of a section heading; a null kind is an unknown heading."""
    plain = strip_accents(text)
    kind = F.coalesce(*[F.when(plain.rlike(p), F.lit(k)) for p, k in KINDS])
    pattern = rf"απο\s+({CLOCK})\s+εωσ\s+({CLOCK})"
    hours = window_of(*(F.nullif(F.regexp_extract(plain, pattern, i), F.lit("")) for i in (1, 2)))
    return F.struct(kind.alias("kind"), hours.alias("hours"))


def weekdays_in(text: Column) -> Column:
    plain = strip_accents(text)
    return F.filter(F.array(*[F.when(F.contains(plain, F.lit(w)), F.lit(k + 1)) for k, w in enumerate(WEEKDAYS)]), lambda d: d.isNotNull())


def extra_hours(note: Column) -> Column:
    """weekdays, from, to and exceptHolidays of a note under a heading; null for another kind of note."""
    pattern = rf"({CLOCK})\s*[-–]\s*({CLOCK})"
    start, end = (normalize_time(F.nullif(F.regexp_extract(note, pattern, i), F.lit(""))) for i in (1, 2))
    days = weekdays_in(note)
    but = strip_accents(note).rlike(r"εκτοσ\s+αργιων")
    return F.when(start.isNotNull() & end.isNotNull() & (F.size(days) > 0), F.struct(days.alias("weekdays"), start.alias("from"), end.alias("to"), but.alias("exceptHolidays")))


def heading_windows(text: Column) -> Column:
    """Windows of a heading with several, joined by `&`; a star marks those on call; null when any part can't be read."""
    parts = F.split(text, "&")
    pattern = rf"({CLOCK})\s*[-–]\s*({CLOCK})"
    read = F.transform(parts, lambda p: F.struct(window_of(F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(p, pattern, 2), F.lit(""))).alias("window"), F.contains(p, F.lit("*")).alias("on_call")))
    return F.when(F.forall(read, lambda r: r["window"].isNotNull()), read)


def schedule_lines(cells: DataFrame, key: str, cell: str) -> DataFrame:
    """key, position, weekday, day (null for a weekly line), from, to, error: the lines `<weekday>[ dd/mm/yyyy]: ranges`.

    A line that can't be read, whose weekday isn't its date's, or whose range doesn't end after it starts, gives a row
    with an error and no hours: nothing is guessed."""
    lines = cells.select(F.col(key), F.posexplode(F.split(cell, "\n")).alias("position", "raw")).withColumn("line", squash(F.col("raw"))).where("line <> ''")
    pattern = r"^(\p{L}+)(?: (\d{2})/(\d{2})/(\d{4}))? ?: ?(.+)$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    weekday = F.nullif(F.array_position(F.lit(list(WEEKDAYS)), strip_accents(part(1))), F.lit(0)).cast("int")
    day = F.to_date(F.try_to_timestamp(F.nullif(F.concat_ws("-", part(4), part(3), part(2)), F.lit("--")), F.lit("yyyy-MM-dd")))
    read = lines.withColumns({"weekday": weekday, "dated": part(2) != "", "day": day, "hours": part(5)})
    rest = F.trim(F.regexp_replace(F.regexp_replace("hours", rf"({CLOCK})\s*-\s*({CLOCK})", " "), "και|,", ""))
    times = F.regexp_extract_all("hours", F.lit(rf"{CLOCK}\s*-\s*{CLOCK}"), F.lit(0))
    ranges = F.transform(times, lambda t: F.struct(normalize_time(F.split(t, r"\s*-\s*")[0]).alias("from"), normalize_time(F.split(t, r"\s*-\s*")[1]).alias("to")))
    read = read.withColumns({"ranges": ranges, "rest": rest})
    error = (
        F.when(F.col("weekday").isNull() | (F.size("ranges") == 0) | (F.col("rest") != ""), "unreadable")
        .when(F.col("dated") & (F.col("day").isNull() | (F.weekday("day") + 1 != F.col("weekday"))), "weekday is not the date's")
        .when(~F.forall("ranges", lambda r: F.coalesce(is_proper_range(r["from"], r["to"]), F.lit(False))), "doesn't end after it starts")
    )
    read = read.withColumn("error", error)
    return read.select(key, "position", "weekday", "day", F.explode_outer(F.when(F.col("error").isNull(), F.col("ranges"))).alias("r"), "error").select(key, "position", "weekday", "day", "r.from", "r.to", "error")


def schedule_text(ranges: Column) -> Column:
    return F.array_join(F.transform(ranges, lambda r: F.concat_ws("–", r["from"], r["to"])), ", ")


#: Tokens of free-typed hours: a day or month of numbers, a clock, a word, or a sign.
TOKEN = re.compile(r"(?P<clock>\d{1,2}[:.]\d{2})|(?P<date>\d{1,2}/\d{1,2}(?:/\d{2,4})?)|(?P<number>\d{1,2})|(?P<word>[^\W\d_]+)|(?P<sign>[-–,&])")


def free_hours(text: str, year: int, month: int) -> list[tuple[str, str, str]]:
    """(key, from, to) of free-typed hours: clauses of days (weekdays, dates, spans of either) and then ranges.

    The key is a weekday number or a date. Strict: ValueError for anything that isn't understood."""
    from unicodedata import normalize

    plain = "".join(c for c in normalize("NFD", text.lower()) if not 0x300 <= ord(c) <= 0x36F).replace("ς", "σ")
    if TOKEN.sub("", plain).strip(" :;.\n\t"):
        raise ValueError(f"unread: {text!r}")
    out: list[tuple[str, str, str]] = []
    days: list[str] = []
    clocks: list[str] = []
    span = ""

    def close() -> None:
        nonlocal days, clocks
        if clocks:
            if len(clocks) % 2 or not days:
                raise ValueError(f"unread: {text!r}")
            for a, b in zip(clocks[::2], clocks[1::2], strict=True):
                if not (a < b or b == "00:00" != a):
                    raise ValueError(f"doesn't end after it starts: {a}-{b}")
                out.extend((d, a, b) for d in days)
            days, clocks = [], []

    for m in TOKEN.finditer(plain):
        kind, value = m.lastgroup, m[0]
        if kind == "sign":
            span = value if value in "-–" else ""
        elif kind == "clock" or kind == "number" and days and (clocks or span == ""):
            h, _, minutes = value.replace(".", ":").partition(":")
            if int(h) > 24 or int(minutes or 0) > 59:
                raise ValueError(f"not a time: {value}")
            clocks.append(f"{int(h) % 24:02}:{minutes or '00'}")
            span = ""
        elif kind == "word" and value in ("και", "εωσ", "απο", "ωσ", "εως"):
            span = "-" if value in ("εωσ", "ωσ") else ""
        else:
            close()
            if kind == "word":
                found = [k + 1 for k, w in enumerate(WEEKDAYS) if len(value) >= 3 and w.startswith(value[:3]) and (w == value or value in w)]
                if len(found) != 1:
                    raise ValueError(f"not a day: {value}")
                key = found[0]
                days.extend(map(str, range(int(days[-1]) + 1, key + 1)) if span and days and days[-1].isdigit() else [str(key)])
            else:
                parts = [int(x) for x in value.split("/")]
                day = date(year if len(parts) < 3 else parts[2] % 100 + 2000, parts[1] if len(parts) > 1 else month, parts[0])
                if span and days and not days[-1].isdigit():
                    first = date.fromisoformat(days[-1])
                    days.extend(date.fromordinal(n).isoformat() for n in range(first.toordinal() + 1, day.toordinal() + 1))
                else:
                    days.append(day.isoformat())
            span = ""
    close()
    if days or not out:
        raise ValueError(f"no hours: {text!r}")
    return out


def free_schedules(cells: DataFrame, key: str, cell: str, year: str, month: str) -> DataFrame:
    """key, day_key, from, to, error of free-typed cells; one row with an error for a cell that isn't understood."""
    kind = dict(cells.dtypes)[key]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, text, y, m in zip(pdf["k"], pdf["t"], pdf["y"], pdf["m"], strict=True):
                try:
                    rows += [(k, *r, None) for r in free_hours(text or "", int(y), int(m))]
                except ValueError as error:
                    rows.append((k, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["k", "day_key", "from", "to", "error"])

    found = cells.select(F.col(key).alias("k"), F.col(cell).alias("t"), F.col(year).alias("y"), F.col(month).alias("m")).mapInPandas(read, f"k {kind}, day_key string, `from` string, `to` string, error string")
    return found.withColumnRenamed("k", key)
