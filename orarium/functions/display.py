"""Dates, times, prices, phones and statuses as people read them, as column expressions in two languages."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from orarium.functions.text import encode_component, rewrite, squash, strip_accents
from orarium.functions.timez import iso_weekday, time_of, zoned_date, zoned_minutes

# Names of days (Monday first) and months as each language writes them in a date.
WEEKDAYS = {
    "el": ("Δευτέρα", "Τρίτη", "Τετάρτη", "Πέμπτη", "Παρασκευή", "Σάββατο", "Κυριακή"),
    "en": ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"),
}
SHORT_WEEKDAYS = {"el": ("Δευ", "Τρί", "Τετ", "Πέμ", "Παρ", "Σάβ", "Κυρ"), "en": ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")}
MONTHS = {
    "el": ("Ιανουαρίου", "Φεβρουαρίου", "Μαρτίου", "Απριλίου", "Μαΐου", "Ιουνίου", "Ιουλίου", "Αυγούστου", "Σεπτεμβρίου", "Οκτωβρίου", "Νοεμβρίου", "Δεκεμβρίου"),
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
}
SHORT_MONTHS = {
    "el": ("Ιαν", "Φεβ", "Μαρ", "Απρ", "Μαΐ", "Ιουν", "Ιουλ", "Αυγ", "Σεπ", "Οκτ", "Νοε", "Δεκ"),
    "en": ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sept", "Oct", "Nov", "Dec"),
    "en-US": ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
}
# Units of distance by language, and forms of companies and of partners at a name's end.
UNITS = {"el": ("μ", "χλμ"), "en": ("m", "km")}
FORMS = ("ΟΕ", "ΕΕ", "ΙΚΕ", "ΕΠΕ", "ΑΕ")
#: A form with or without dots and spaces between its letters; OE is also typed in Latin letters.
LEGAL_FORMS = r"\s+(?:OE|" + "|".join(r"\.?\s?".join(f) + r"\.?" for f in FORMS) + r")\s*$"
PARTNERS = r"(?:\s*&|\s+ΚΑΙ)\s*ΣΙΑ\s*$"


def named(names: tuple[str, ...], number: Column) -> Column:
    """The name at a place (from 1) of a fixed list."""
    return F.get(F.array(*map(F.lit, names)), number - 1)


def fill(template: Column | str, **values: Column) -> Column:
    """Replaces {name} by the value of that name; other names stay as written."""
    start = F.lit(template) if isinstance(template, str) else template
    return reduce(lambda text, v: F.replace(text, F.lit(f"{{{v[0]}}}"), v[1].cast("string")), values.items(), start)


def clock_text(at: Column, zone: Column | str) -> Column:
    """21:00, in the area's zone."""
    return time_of(zoned_minutes(at, zone))


def weekday_name(date: Column, locale: str = "en") -> Column:
    return named(WEEKDAYS[locale], iso_weekday(date))


def day_month(date: Column, locale: str = "en", year: bool | Column = False) -> Column:
    """7 Oct, with the year where asked."""
    text = F.concat_ws(" ", F.day(date).cast("string"), named(SHORT_MONTHS[locale], F.month(date)))
    return F.when(F.lit(year) if isinstance(year, bool) else year, F.concat_ws(" ", text, F.year(date).cast("string"))).otherwise(text)


def short_date(date: Column, locale: str = "en") -> Column:
    """Wed 7 Oct."""
    return F.concat_ws(" ", named(SHORT_WEEKDAYS[locale], iso_weekday(date)), day_month(date, locale))


def date_text(date: Column, locale: str = "en") -> Column:
    """5 October 2026."""
    return F.concat_ws(" ", F.day(date).cast("string"), named(MONTHS[locale], F.month(date)), F.year(date).cast("string"))


def long_date(date: Column, locale: str = "en") -> Column:
    """Monday 5 October 2026."""
    return F.concat_ws(" ", weekday_name(date, locale), date_text(date, locale))


def checked_text(at: Column, zone: Column | str, locale: str = "en") -> Column:
    """1 Nov 22:32."""
    return F.concat_ws(" ", day_month(zoned_date(at, zone), locale), clock_text(at, zone))


def updated_short(at: Column, now: Column, zone: Column | str, locale: str = "en") -> Column:
    """The clock alone for today, else with the day."""
    return F.when(zoned_date(at, zone) == zoned_date(now, zone), clock_text(at, zone)).otherwise(checked_text(at, zone, locale))


def updated_at(at: Column, zone: Column | str, locale: str = "en") -> Column:
    """5 Oct 2026, 02:04."""
    return F.concat_ws(", ", day_month(zoned_date(at, zone), locale, True), clock_text(at, zone))


def until_date(date: Column, now: Column, zone: Column | str, locale: str = "en") -> Column:
    """7 Nov, with the year only where it isn't this one."""
    return day_month(date, locale, F.year(date) != F.year(zoned_date(now, zone)))


def zones_differ(at: Column, zone: Column | str, device: Column | str) -> Column:
    """Whether a device's clock shows another date or minute than the area's."""
    shown = lambda z: F.date_trunc("minute", F.from_utc_timestamp(at, z))
    return shown(zone) != shown(device)


def price_text(euros: Column, locale: str = "en") -> Column:
    """€8.19 or 8,19 €."""
    number = F.format_number(euros, 2)
    return F.concat(F.lit("€"), number) if locale == "en" else F.concat(F.translate(number, ",.", ".,"), F.lit(" €"))


def distance_text(metres: Column, locale: str = "en") -> Column:
    """350 m, 1.2 km, 12 km: tens of metres (ten at least), tenths of kilometres below ten of them; half-way is rounded up."""
    m, km = UNITS[locale]
    tens = F.greatest(F.lit(10), F.floor(metres / 10 + 0.5) * 10).cast("int")
    far = F.when(metres < 10_000, F.regexp_replace(F.format_number(F.round(metres / 1000, 1), 1), r"\.0$", "")).otherwise(F.format_number(F.round(metres / 1000), 0))
    number = F.when(metres < 1000, F.format_number(tens, 0)).otherwise(far)
    unit = F.when(metres < 1000, m).otherwise(km)
    return F.concat_ws(" ", number if locale == "en" else F.translate(number, ",.", ".,"), unit)


# Words of a status by language are a parameter; these are the keys that the functions below ask for.
WORDS = {
    "en": {
        "today": "today", "tomorrow": "tomorrow", "midnight": "midnight", "hour": "hour", "hours": "hours", "minute": "minute", "minutes": "minutes",
        "duty": "On duty", "all_night": "{label} all night", "open": "Open", "extended": "Open late", "until": "{label} until {when}", "closes_in": "{label}, closes in {duration} ({when})",
        "on_call": "On call", "unknown": "On duty, hours not printed", "closed": "Closed", "not_on_duty": "Not on duty", "opens": "opens {when}", "next_duty": "next duty {when}",
        "opens_unknown": "opening not known", "not_announced": "next duty not announced",
    },
}


def duration_text(minutes: Column, words: Mapping[str, str]) -> Column:
    """1 hour 20 minutes; at least one minute."""
    total = F.greatest(F.lit(1), F.round(minutes).cast("int"))
    counted = lambda n, one, many: F.concat_ws(" ", n.cast("string"), F.when(n == 1, words[one]).otherwise(words[many]))
    hours, rest = F.floor(total / 60).cast("int"), total % 60
    return F.concat_ws(" ", F.when(hours > 0, counted(hours, "hour", "hours")), F.when((rest > 0) | (hours == 0), counted(rest, "minute", "minutes")))


def when_text(target: Column, at: Column, zone: Column | str, words: Mapping[str, str], locale: str = "en", say_today: bool = False) -> Column:
    """21:00 today, `tomorrow 08:00`, then the weekday, and from a week on the date."""
    days = F.date_diff(zoned_date(target, zone), zoned_date(at, zone))
    day = F.when(days == 0, words["today"] if say_today else None).when(days == 1, words["tomorrow"]).when(days >= 7, short_date(zoned_date(target, zone), locale)).otherwise(weekday_name(zoned_date(target, zone), locale))
    return F.concat_ws(" ", day, clock_text(target, zone))


def is_midnight_after(target: Column, at: Column, zone: Column | str) -> Column:
    return (zoned_minutes(target, zone) == 0) & (zoned_date(target, zone) == F.date_add(zoned_date(at, zone), 1))


def look(state: Column, reasons: Column) -> Column:
    """duty, open, duty-unknown or closed: a duty beats other reasons. Reasons are keys, as orarium.operators.schedules names them."""
    on_duty = F.exists(reasons, lambda r: r.startswith("duty"))
    return F.when(state == "closed", "closed").when(state == "duty-hours-unknown", "duty-unknown").when(on_duty, "duty").otherwise("open")


def is_duty_look(kind: Column) -> Column:
    return kind.isin("duty", "duty-unknown")


def status_text(at: Column, zone: Column | str, words: Mapping[str, str], locale: str = "en", live: bool = True, duty_only: Column | bool = False) -> Column:
    """The sentence about a row of orarium.operators.status.status_at: what it is and until when, or when it opens.

    live: the last minutes before closing are counted down. duty_only: regular hours aren't known, so what is off the
    list is not on duty, and never closed."""
    only = F.lit(duty_only) if isinstance(duty_only, bool) else F.coalesce(duty_only, F.lit(False))
    kind, reasons, until, opens = look(F.col("state"), F.col("reasons")), F.col("reasons"), F.col("until"), F.col("next_open")
    word = F.when(kind == "duty", words["duty"]).when(F.exists(reasons, lambda r: r == "extended"), words["extended"]).otherwise(words["open"])
    night = F.exists(reasons, lambda r: r.rlike(r"^duty(-extra)?\|after-midnight\|"))
    word = F.when((kind == "duty") & night, fill(words["all_night"], label=word)).otherwise(word)
    minutes = F.ceil((F.unix_micros(until) - F.unix_micros(at)) / 60_000_000)
    end = F.when(is_midnight_after(until, at, zone), words["midnight"]).otherwise(when_text(until, at, zone, words, locale))
    counted = fill(words["closes_in"], label=word, duration=duration_text(minutes, words), when=end)
    is_open = F.when(F.lit(live) & F.col("closing_soon"), counted).otherwise(fill(words["until"], label=word, when=end))
    begin = when_text(opens, at, zone, words, locale, say_today=True)
    later = F.when(only, fill(words["next_duty"], when=begin)).otherwise(fill(words["opens"], when=begin))
    never = F.when(only, words["not_announced"]).otherwise(words["opens_unknown"])
    closed = F.concat_ws(", ", F.when(only, words["not_on_duty"]).otherwise(words["closed"]), F.when(opens.isNull(), never).otherwise(later))
    listed = F.when(F.col("on_call"), words["on_call"]).otherwise(words["unknown"])
    return F.when(F.col("state") == "open", is_open).when(F.col("state") == "duty-hours-unknown", listed).otherwise(closed)


def display_name(name: Column) -> Column:
    """A name without a shared-branch prefix, forms of companies and of partners; a branch number stays: `… (2ο)`."""
    trimmed = F.trim(name)
    branch = F.regexp_extract(trimmed, r"\s*\(\s*(\d+)\s*ο\s*\)\s*$", 1)
    rest = rewrite(trimmed, ((r"\s*\(\s*\d+\s*ο\s*\)\s*$", ""), (r"^Σ\.\s?Φ\.?\s+", "")))
    for _ in range(2):  # a partners' clause may stand before a form
        rest = rewrite(rest, ((LEGAL_FORMS, ""), (PARTNERS, "")))
    rest = F.trim(F.regexp_replace(rest, r"[\s,\-–]+$", ""))
    rest = F.when(rest == "", trimmed).otherwise(rest)
    return F.when(branch != "", F.concat(rest, F.lit(" ("), branch, F.lit("ο)"))).otherwise(rest)


def place_line(address: Column, locality: Column, area: Column) -> Column:
    """Address and place; the place once where it is the address too; not at all where it is the area's own name."""
    same = (locality != "") & (F.trim(strip_accents(address)) == F.trim(strip_accents(locality)))
    own = locality == area
    parts = F.filter(F.array(address, F.when(own, "").otherwise(locality)), lambda p: p != "")
    return F.when(same, F.when(own, address).otherwise(locality)).otherwise(F.array_join(parts, ", "))


def single_line(x: Column) -> Column:
    """Control characters are spaces, and white space is single."""
    return squash(F.regexp_replace(x, r"[\p{Cc}  ]", " "))


def lookup(key: Column, names: Mapping[str, str], default: Column | None = None) -> Column:
    """A fixed table of names; what it lacks stays as it is, or takes the default."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key if default is None else default)


def place_name(printed: Column, names: Mapping[str, str]) -> Column:
    """A printed place as people write it: whole, else part by part at hyphens where each part is known, else as printed.

    names: accent-free capitals -> name."""
    key = F.upper(squash(strip_accents(printed)))
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    parts = F.transform(F.split(key, r"\s*-\s*"), lambda p: F.try_element_at(table, p))
    joined = F.when((F.size(parts) > 1) & F.forall(parts, lambda p: p.isNotNull()), F.array_join(parts, ", "))
    return F.coalesce(F.try_element_at(table, key), joined, F.trim(printed))


def destination(lat: Column, lon: Column, precision: Column, address: Column, locality: Column) -> Column:
    """Where directions lead: coordinates of precise places, else the address as text."""
    point = F.concat_ws(",", F.format_string("%.6f", lat), F.format_string("%.6f", lon))
    text = F.array_join(F.filter(F.array(address, locality), lambda p: p != ""), ", ")
    return F.when(lat.isNotNull() & (precision != "locality"), point).otherwise(text)


def directions_url(base: str, target: Column) -> Column:
    """A link of a maps service: its address with {place} for the encoded destination."""
    return fill(base, place=encode_component(target))


def map_url(path: str, area: Column, entity: Column | None = None) -> Column:
    """A link to an area, or to one entity of it."""
    more = F.coalesce(F.concat(F.lit("&pharmacy="), F.url_encode(entity)), F.lit("")) if entity is not None else F.lit("")
    return F.concat(F.lit(f"{path}?city="), F.url_encode(area), more)
