"""Dates, months and clocks out of printed titles and words, and the dates that a run asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from orarium.functions.grammars import WEEKDAYS
from orarium.functions.text import normalize_phone, rewrite, squash, strip_accents
from orarium.functions.timez import iso_weekday, strict_date, zoned_date

# Stems of the Greek months, January first, and of their short forms, without accents.
MONTH_STEMS = ("ιανουαρ", "φεβρουαρ", "μαρτ", "απριλ", "μαι", "ιουν", "ιουλ", "αυγουστ", "σεπτεμβρ", "οκτωβρ", "νοεμβρ", "δεκεμβρ")
SHORT_STEMS = ("ιαν", "φεβ", "μαρ", "απρ", "μαι", "ιουν", "ιουλ", "αυγ", "σεπ", "οκτ", "νοε", "δεκ")
# Parts of the day and what they do to an hour: (word, hours that fit, hours that become the next half day's).
DAY_PARTS = (
    ("ΠΡΩΙ", range(1, 13), ()),
    ("ΜΕΣΗΜΕΡΙ", (1, 2, 3, 4, 5, 11, 12), (1, 2, 3, 4, 5)),
    ("ΑΠΟΓΕΥΜΑ", range(1, 13), range(1, 12)),
    ("ΒΡΑΔΥ", range(1, 13), range(1, 12)),
    ("ΝΥΧΤΑ", (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12), (7, 8, 9, 10, 11)),
    ("ΜΕΣΑΝΥΧΤΑ", (12,), ()),
)
#: Parts of the day in which 12 is midnight.
MIDNIGHT_TWELVE = ("ΠΡΩΙ", "ΒΡΑΔΥ", "ΝΥΧΤΑ", "ΜΕΣΑΝΥΧΤΑ")


def month_number(word: Column, stems: tuple[str, ...] = SHORT_STEMS) -> Column:
    """1 to 12 of a Greek month's name, in any case and form; null for another word."""
    plain = strip_accents(word)
    return F.coalesce(*[F.when(plain.startswith(s), k + 1) for k, s in enumerate(stems)])


def built_date(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers or texts of numbers; null where there is none."""
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return strict_date(F.concat_ws("-", part(year, 4), part(month, 2), part(day, 2)))


def date_in_title(title: Column) -> Column:
    """The first `30 ΣΕΠΤΕΜΒΡΙΟΥ 2026` of a title, the month whole and in the genitive."""
    plain = strip_accents(title)
    pattern = r"(\d{1,2})\s+(\p{L}+)\s+(\d{4})"
    day, word, year = (F.regexp_extract(plain, pattern, k) for k in (1, 2, 3))
    # Endings of the genitive.
    month = F.coalesce(*[F.when(word.rlike(f"^{s}(ιου|ου)$"), k + 1) for k, s in enumerate(MONTH_STEMS)])
    return F.when(day != "", built_date(year, month, day))


def weekday_date(title: Column) -> Column:
    """The date that ends a title as `Σάββατο 03 Οκτ 2026`; null unless it exists and falls on the weekday named."""
    pattern = r"(\S+)\s+(\d{1,2})\s+(\S+)\s+(\d{4})$"
    name, day, month, year = (F.regexp_extract(squash(title), pattern, k) for k in (1, 2, 3, 4))
    found = F.when(day != "", built_date(year, month_number(month), day))
    weekday = F.nullif(F.array_position(F.lit(list(WEEKDAYS)), strip_accents(name)), F.lit(0))
    return F.when(iso_weekday(found) == weekday, found)


def months_in_title(title: Column) -> Column:
    """(year, first month, second month) of a title that names two months in a row and a year; else null."""
    plain = strip_accents(title)
    year = F.regexp_extract(plain, r"\b(20\d{2})\b", 1)
    places = F.filter(F.array(*[F.struct(F.instr(plain, s).alias("at"), F.lit(k + 1).alias("month")) for k, s in enumerate(MONTH_STEMS)]), lambda m: m["at"] > 0)
    months = F.transform(F.array_sort(places), lambda m: m["month"])
    first, second = F.get(months, F.lit(0)), F.get(months, F.lit(1))
    return F.when((year != "") & (F.size(months) == 2) & (second == first + 1), F.struct(year.cast("int").alias("year"), first.alias("first"), second.alias("second")))


def numeric_date(text: Column) -> Column:
    """dd/mm/yy of this century, or d/m/yyyy; null for what isn't a date."""
    pattern = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})\s*$"
    day, month, year = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    return F.when(day != "", built_date(F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), month, day))


def spoken_clock(text: Column) -> Column:
    """HH:MM of `8:30 ΠΡΩΙ`, `12 ΜΕΣΗΜΕΡΙ`, `21:00`; null where hour and part of the day don't go together, or for a bare hour."""
    pattern = r"^\s*(\d{1,2})(?:[:.](\d{2}))?\s*(\p{L}+)?\s*$"
    fields = F.transform(F.array(F.upper(strip_accents(text))), lambda t: F.struct(*[F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).alias(n) for k, n in enumerate(("hour", "minute", "part"), 1)]))

    def clock(f: Column) -> Column:
        h, part = f["hour"].cast("int"), f["part"]

        def of_part(word: str, fits, later) -> Column:
            shifted = F.when(h == 12, 0 if word in MIDNIGHT_TWELVE else 12).when(h.isin(*(later or (-1,))), h + 12).otherwise(h)
            return F.when(h.isin(*fits), shifted)

        plain_hour = F.when(f["minute"].isNotNull() & (h <= 24), h % 24)
        value = reduce(lambda c, p: c.when(part == p[0], of_part(*p)), DAY_PARTS, F.when(part.isNull(), plain_hour))
        minute = F.coalesce(f["minute"], F.lit("00"))
        return F.when((minute < "60") & value.isNotNull(), F.concat_ws(":", F.lpad(value.cast("string"), 2, "0"), minute))

    # fields are computed once, whatever the number of places that use them
    return F.get(F.transform(fields, clock), F.lit(0))


def first_dates(now: Column, zone: Column | str) -> Column:
    """Yesterday to three days ahead: what a first load asks for."""
    today = zoned_date(now, zone)
    return F.sequence(F.date_sub(today, 1), F.date_add(today, 3))


def run_date(now: Column, zone: Column | str, override: str | None = None, production: bool = False) -> Column:
    """The date that a run stands for: a parameter where one is given (never in production), else the area's date."""
    if override and production:
        raise ValueError("an override would freeze the published data in the past")
    return F.to_date(F.lit(override)) if override else zoned_date(now, zone)


def phones_in(cell: Column) -> Column:
    """Every phone of a cell: groups of digits that make ten together are one; seven digits are an Athens number."""
    groups = F.regexp_extract_all(cell, F.lit(r"\d+"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    full = lambda x: F.when(F.length(x) == 7, F.concat(F.lit("210"), x)).otherwise(x)

    def step(state: Column, group: Column) -> Column:
        together = F.concat(state["held"], group)
        joins = (state["held"] != "") & (F.length(state["held"]) < 10) & (F.length(together) == 10)
        closed = F.when(state["held"] == "", state["done"]).otherwise(F.array_append(state["done"], full(state["held"])))
        return F.when(joins, F.struct(F.array_append(state["done"], together).alias("done"), F.lit("").alias("held"))).otherwise(F.struct(closed.alias("done"), group.alias("held")))

    last = F.aggregate(groups, start, step, lambda s: F.when(s["held"] == "", s["done"]).otherwise(F.array_append(s["done"], full(s["held"]))))
    return F.filter(F.transform(last, normalize_phone), lambda p: p.isNotNull())


PHONE = r"\d{4,5}[ .-]?\d{5,6}"


def address_and_phone(line: Column) -> Column:
    """(address, phone) of a line that ends in a phone, with or without the word for it before the number."""
    text = squash(line)
    found = F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))
    before = F.call_function("substring_index", text, F.get(found, F.lit(0)), F.lit(1))
    address = rewrite(before, ((r"(?iu)[ΤT][ΗH][ΛL]\.?:?\s*$", ""), (r"[\s,.:–-]+$", "")))
    bare = F.regexp_replace(text, r"[\s,–-]+$", "")
    phone = F.get(F.filter(F.transform(found, normalize_phone), lambda p: p.isNotNull()), F.lit(0))
    return F.struct(F.when(F.size(found) > 0, address).otherwise(bare).alias("address"), F.coalesce(phone, F.lit("")).alias("phone"))


def clean_substance(text: Column) -> Column:
    """`A:B` and `A,B` as `A, B`."""
    return F.array_join(F.filter(F.split(squash(text), r"\s*[:,;]\s*"), lambda p: p != ""), ", ")


def expand_street(address: Column, streets: tuple[tuple[str, str], ...]) -> Column:
    """The address with a street's printed short form, at its start, written out; streets: (pattern, name), first fit wins."""
    trimmed = F.trim(address)
    head = lambda p: f"(?iu)^(?:{p})"
    return F.coalesce(*[F.when(trimmed.rlike(head(p)), F.regexp_replace(trimmed, head(p), name)) for p, name in streets], address)


def unescape_js(body: Column) -> Column:
    r"""What a JavaScript string literal's body stands for: \n, \t, \/, \", \\, é, \x27."""
    pieces = F.regexp_extract_all(body, F.lit(r"(?s)(\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\.|[^\\]+)"), F.lit(1))
    # a code unit above ASCII is decoded from its two bytes
    code = lambda p: F.decode(F.unhex(F.lpad(F.substring(p, 3, 4), 4, "0")), "UTF-16BE")
    control = lambda p: F.when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\t", "\t").when(p == "\\b", "\b").when(p == "\\f", "\f")
    one = lambda p: F.when(~p.startswith("\\"), p).when(F.length(p) > 2, code(p)).otherwise(F.coalesce(control(p), F.substring(p, 2, 1)))
    return F.array_join(F.transform(pieces, one), "")


def file_date(url: Column, stem: str) -> Column:
    """The date in a file's name, <stem>_dd-mm-yyyy.pdf with any numbers after it, the name percent-encoded or not; null for
    any other name."""
    name = F.try_url_decode(F.substring_index(url, "/", -1))
    found = lambda k: F.regexp_extract(name, rf"^{stem}_(\d{{2}})-(\d{{2}})-(\d{{4}})(?:-\d+)*\.pdf$", k)
    return strict_date(F.concat_ws("-", found(3), found(2), found(1)))
