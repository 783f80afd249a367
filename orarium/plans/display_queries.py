"""Queries of the functions that read printed text and write text for people, over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orarium.functions import display, titles
from orarium.functions.text import format_phone
from orarium.functions.timez import time_of
from orarium.operators import lists
from orarium.plans.interval_queries import AT, HOUR, STATUSES, ZONE, at_instant, statuses
from orarium.plans.registry import register
from orarium.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = register(QUERIES, ORACLE_SQL)


def names(values: tuple[str, ...], index: str) -> str:
    """A list of texts and an index, in SQL."""
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{index}]"


D = display
DAYS = "days AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)"
SHORT = f"{names(D.SHORT_WEEKDAYS['en'], 'isodow(d)')} || ' ' || day(d) || ' ' || {names(D.SHORT_MONTHS['en'], 'month(d)')}"


@query(f"""WITH {DAYS} SELECT strftime(d, '%Y-%m-%d') AS date, {names(D.WEEKDAYS['en'], 'isodow(d)')} AS weekday, {SHORT} AS short,
{names(D.SHORT_WEEKDAYS['el'], 'isodow(d)')} || ' ' || day(d) || ' ' || {names(D.SHORT_MONTHS['el'], 'month(d)')} AS short_el,
day(d) || ' ' || {names(D.MONTHS['el'], 'month(d)')} || ' ' || year(d) AS date_el, {names(D.WEEKDAYS['en'], 'isodow(d)')} || ' ' || day(d) || ' ' || {names(D.MONTHS['en'], 'month(d)')} || ' ' || year(d) AS long,
day(d) || ' ' || {names(D.SHORT_MONTHS['en'], 'month(d)')} || CASE WHEN year(d) <> 1997 THEN ' ' || year(d) ELSE '' END AS until FROM days""")
def date_words(spark, d):
    day = F.col("d")
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    now = F.lit("1997-06-01 12:00:00").cast("timestamp")
    return days.select(day.cast("string").alias("date"), D.weekday_name(day).alias("weekday"), D.short_date(day).alias("short"), D.short_date(day, "el").alias("short_el"), D.date_text(day, "el").alias("date_el"), D.long_date(day).alias("long"), D.until_date(day, now, ZONE).alias("until"))


@query(f"""WITH l AS (SELECT event_id, ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens' AS a, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata' AS k FROM events),
w AS (SELECT *, strftime(a, '%H:%M') AS clock, day(a) || ' ' || {names(D.SHORT_MONTHS['en'], 'month(a)')} AS md FROM l)
SELECT event_id, clock, md || ' ' || clock AS checked, CASE WHEN a::DATE = DATE '2024-01-15' THEN clock ELSE md || ' ' || clock END AS short, md || ' ' || year(a) || ', ' || clock AS updated,
date_trunc('minute', a) <> date_trunc('minute', k) AS differs FROM w""")
def clock_words(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", D.clock_text(ts, ZONE).alias("clock"), D.checked_text(ts, ZONE).alias("checked"), D.updated_short(ts, at_instant(), ZONE).alias("short"), D.updated_at(ts, ZONE).alias("updated"), D.zones_differ(ts, ZONE, "Asia/Kolkata").alias("differs"))


@query("""WITH p AS (SELECT p_partkey AS k, p_retailprice AS e, p_partkey * 37 % 40000 AS m, CASE p_partkey % 6 WHEN 0 THEN '210' || lpad((p_partkey % 10000000)::VARCHAR, 7, '0') WHEN 1 THEN '2310' || lpad(p_partkey::VARCHAR, 6, '0') WHEN 2 THEN '23920' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') WHEN 3 THEN '694' || lpad(p_partkey::VARCHAR, 7, '0') WHEN 4 THEN '800' || lpad(p_partkey::VARCHAR, 7, '0') ELSE p_partkey::VARCHAR END AS t FROM part),
n AS (SELECT *, greatest(10, floor(m / 10.0 + 0.5) * 10)::INT AS tens, (m // 100 * 100 + CASE WHEN m % 100 >= 50 THEN 100 ELSE 0 END) // 100 AS tenths FROM p)
SELECT k AS p_partkey, printf('€%s', format('{:,.2f}', e)) AS price, replace(replace(replace(format('{:,.2f}', e), ',', '#'), '.', ','), '#', '.') || chr(160) || '€' AS price_el,
CASE WHEN m < 1000 THEN format('{:,}', tens) || ' m' WHEN m < 10000 THEN (tenths // 10) || CASE WHEN tenths % 10 > 0 THEN '.' || tenths % 10 ELSE '' END || ' km' ELSE (m // 1000 + CASE WHEN m % 1000 >= 500 THEN 1 ELSE 0 END) || ' km' END AS distance,
CASE k % 6 WHEN 0 THEN t[:3] || ' ' || t[4:] WHEN 1 THEN t[:4] || ' ' || t[5:] WHEN 2 THEN t[:5] || ' ' || t[6:] WHEN 3 THEN t[:3] || ' ' || t[4:6] || ' ' || t[7:] ELSE t END AS phone FROM n""")
def numbers_as_text(spark, d):
    """Prices, distances and phones."""
    k = F.col("p_partkey")
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")  # a longer number keeps its first digits
    metres = k * 37 % 40_000
    phone = F.when(k % 6 == 0, F.concat(F.lit("210"), padded(k % 10**7, 7))).when(k % 6 == 1, F.concat(F.lit("2310"), padded(k, 6))).when(k % 6 == 2, F.concat(F.lit("23920"), padded(k % 10**5, 5))).when(k % 6 == 3, F.concat(F.lit("694"), padded(k, 7))).when(k % 6 == 4, F.concat(F.lit("800"), padded(k, 7))).otherwise(k.cast("string"))
    rows = table(spark, d, "part")
    return rows.select("p_partkey", D.price_text(F.col("p_retailprice")).alias("price"), D.price_text(F.col("p_retailprice"), "el").alias("price_el"), D.distance_text(metres).alias("distance"), format_phone(phone).alias("phone"))


W = D.WORDS["en"]
WHEN = f"""CASE WHEN days = 0 THEN '' WHEN days = 1 THEN 'tomorrow ' WHEN days >= 7 THEN {SHORT} || ' ' ELSE {names(D.WEEKDAYS['en'], 'isodow(d)')} || ' ' END"""


@query(f"""WITH {STATUSES}, s AS (SELECT *, CASE WHEN is_open THEN until_us ELSE start_us END AS t FROM statuses),
z AS (SELECT *, (make_timestamp(t) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens' AS a FROM s),
w AS (SELECT *, a::DATE AS d, a::DATE - DATE '2024-01-15' AS days, strftime(a, '%H:%M') AS clock, ceil((t - {AT}) / 60000000.0)::INT AS mins FROM z)
SELECT user_id, CASE WHEN is_open THEN CASE WHEN t - {AT} <= 1800000000 THEN 'Open, closes in ' || mins || CASE WHEN mins = 1 THEN ' minute' ELSE ' minutes' END || ' (' || {WHEN} || clock || ')' ELSE 'Open until ' || CASE WHEN clock = '00:00' AND days = 1 THEN 'midnight' ELSE {WHEN} || clock END END
WHEN unread THEN 'On duty, hours not printed' WHEN calling THEN 'On call' WHEN t IS NULL THEN 'Closed, opening not known' ELSE 'Closed, opens ' || CASE WHEN days = 0 THEN 'today ' ELSE {WHEN} END || clock END AS label,
CASE WHEN is_open THEN 'open' WHEN unread OR calling THEN 'duty-unknown' ELSE 'closed' END AS look FROM w""")
def status_words(spark, d):
    """The sentence about each user at the fixed instant."""
    found = statuses(spark, d)
    return found.select(F.col("entity_id").alias("user_id"), D.status_text(at_instant(), ZONE, W).alias("label"), D.look(F.col("state"), F.col("reasons")).alias("look"))


@query("""WITH p AS (SELECT p_partkey AS k, upper(p_name) AS n FROM part)
SELECT k AS p_partkey, CASE k % 7 WHEN 5 THEN n || ' (2ο)' WHEN 6 THEN 'ΟΕ' ELSE n END AS display,
CASE WHEN k % 3 = 0 THEN 'Άνω Πόλη' WHEN k % 3 = 1 THEN 'Οδός ' || k ELSE 'Οδός ' || k || ', Νέα Πόλη' END AS line,
CASE k % 4 WHEN 0 THEN 'Πειραιάς' WHEN 1 THEN 'Πειραιάς, Καστέλλα' WHEN 2 THEN 'ΠΕΙΡΑΙΑΣ-ΑΛΛΟΥ' ELSE 'Ρίο' END AS place, 'κ ' || k || ' {other}' AS filled, 'a b ' || k AS one_line FROM p""")
def names_as_text(spark, d):
    k, n = F.col("p_partkey"), F.upper("p_name")
    tails = (" ΟΕ", " & ΣΙΑ Ο.Ε.", " Ι.Κ.Ε.", " ΚΑΙ ΣΙΑ", "", " Ε.Π.Ε. ( 2ο )")
    raw = F.when(k % 7 == 6, "ΟΕ").otherwise(F.concat(F.when(k % 2 == 0, "Σ.Φ. ").otherwise(""), n, F.get(F.array(*map(F.lit, tails)), (k % 7).cast("int"))))
    locality = F.when(k % 3 == 0, "Άνω Πόλη").when(k % 3 == 1, "Χώρα").otherwise("Νέα Πόλη")
    address = F.when(k % 3 == 0, "ΑΝΩ ΠΟΛΗ").otherwise(F.concat(F.lit("Οδός "), k.cast("string")))
    places = {"ΠΕΙΡΑΙΑΣ": "Πειραιάς", "ΚΑΣΤΕΛΛΑ": "Καστέλλα"}
    printed = F.when(k % 4 == 0, "Πειραιάς ").when(k % 4 == 1, "ΠΕΙΡΑΙΑΣ - ΚΑΣΤΕΛΛΑ").when(k % 4 == 2, " ΠΕΙΡΑΙΑΣ-ΑΛΛΟΥ").otherwise("Rio")
    place = F.when(k % 4 == 3, D.lookup(printed, {"Rio": "Ρίο"})).otherwise(D.place_name(printed, places))
    return table(spark, d, "part").select("p_partkey", D.display_name(raw).alias("display"), D.place_line(address, locality, F.lit("Χώρα")).alias("line"), place.alias("place"), D.fill("κ {key} {other}", key=k).alias("filled"), D.single_line(F.concat(F.lit(" a\n\tb\u0007 "), k.cast("string"))).alias("one_line"))


@query(f"""WITH {DAYS} SELECT strftime(d, '%Y-%m-%d') AS date, strftime(d, '%Y-%m-%d') AS genitive, CASE WHEN day(d) % 5 <> 0 THEN strftime(d, '%Y-%m-%d') END AS weekday_title, CASE WHEN day(d) < 28 THEN strftime(d, '%Y-%m-%d') END AS numeric_short, strftime(d, '%Y-%m-%d') AS numeric_long,
CASE WHEN month(d) < 12 THEN '2026-' || month(d) || '-' || (month(d) + 1) END AS two_months FROM days""")
def dates_in_titles(spark, d):
    """Dates written into titles and read back; a wrong weekday, a date that doesn't exist and a wrong pair of months give none."""
    day = F.col("d")
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    month = lambda m: F.upper(D.named(D.MONTHS["el"], m))
    genitive = F.concat(F.lit("Ελλείψεις "), F.day(day).cast("string"), F.lit("  "), month(F.month(day)), F.lit(" "), F.year(day).cast("string"), F.lit(" (νέο)"))
    weekday = D.weekday_name(F.when(F.day(day) % 5 == 0, F.date_add(day, 1)).otherwise(day), "el")
    titled = F.concat_ws(" ", F.lit("Λίστα"), weekday, F.lpad(F.day(day).cast("string"), 2, "0"), D.named(D.SHORT_MONTHS["el"], F.month(day)), F.year(day).cast("string"))
    short = F.when(F.day(day) < 28, F.date_format(day, "dd/MM/")).otherwise(F.lit("31/02/"))
    both = F.concat_ws(" ", F.lit("ΠΙΝΑΚΑΣ"), month(F.month(day)), F.lit("–"), month(F.when(F.month(day) == 12, 3).otherwise(F.month(day) + 1)), F.lit("2026"))
    two = titles.months_in_title(both)
    text = lambda c: c.cast("string")
    # years before 2000 are out of reach of two digits: they are moved there and back
    shifted = F.concat(short, F.substring(F.year(F.add_months(day, 12 * 28)).cast("string"), 3, 2))
    return days.select(text(day).alias("date"), text(titles.date_in_title(genitive)).alias("genitive"), text(titles.weekday_date(titled)).alias("weekday_title"), text(F.add_months(titles.numeric_date(shifted), -12 * 28)).alias("numeric_short"), text(titles.numeric_date(F.date_format(day, "d/M/yyyy"))).alias("numeric_long"), F.when(two.isNotNull(), F.concat_ws("-", two["year"], two["first"], two["second"])).alias("two_months"))


@query("""WITH h AS (SELECT DISTINCT event_id % 27 AS h, event_id % 8 AS p, (event_id % 5) * 13 AS m FROM events)
SELECT h, p, m, CASE WHEN m > 59 THEN NULL ELSE CASE p WHEN 0 THEN CASE WHEN h <= 24 THEN h % 24 END WHEN 1 THEN CASE WHEN h BETWEEN 1 AND 12 THEN h % 12 END WHEN 2 THEN CASE WHEN h BETWEEN 1 AND 5 THEN h + 12 WHEN h IN (11, 12) THEN h END
WHEN 3 THEN CASE WHEN h = 12 THEN 12 WHEN h BETWEEN 1 AND 11 THEN h + 12 END WHEN 4 THEN CASE WHEN h = 12 THEN 0 WHEN h BETWEEN 1 AND 11 THEN h + 12 END WHEN 5 THEN CASE WHEN h = 12 THEN 0 WHEN h BETWEEN 7 AND 11 THEN h + 12 WHEN h BETWEEN 1 AND 6 THEN h END
WHEN 6 THEN CASE WHEN h = 12 THEN 0 END END END AS hour_of_day FROM h""")
def spoken_clocks(spark, d):
    """Hours with the words for parts of the day, in 24 hours; an unknown word gives none."""
    i = F.col("event_id")
    rows = table(spark, d, "events").select((i % 27).alias("h"), (i % 8).alias("p"), (i % 5 * 13).alias("m")).distinct()
    words = ("", " πρωί", " μεσημέρι", " ΑΠΟΓΕΥΜΑ", " βράδυ", " νύχτα", " μεσάνυχτα", " αύριο")
    text = F.concat(F.col("h").cast("string"), F.lit(":"), F.lpad(F.col("m").cast("string"), 2, "0"), F.get(F.array(*map(F.lit, words)), F.col("p").cast("int")))
    clock = titles.spoken_clock(text)
    return rows.select("h", "p", "m", F.substring(clock, 1, 2).cast("int").cast("long").alias("hour_of_day"))


@query("""WITH s AS (SELECT s_suppkey AS k, '210' || lpad(s_suppkey::VARCHAR, 7, '0') AS p FROM supplier)
SELECT k AS s_suppkey, CASE k % 4 WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN p || ',69' || lpad(k::VARCHAR, 8, '0') ELSE '' END AS phones, CASE WHEN k % 4 = 3 THEN 'Οδός ' || k ELSE 'Οδός ' || k END AS address, CASE WHEN k % 4 = 3 THEN '' ELSE p END AS phone,
'A ' || k || ', B, C' AS substance, CASE k % 3 WHEN 0 THEN 'Μεγάλου Αλεξάνδρου ' || k WHEN 1 THEN '21ης Ιουνίου ' || k ELSE ' ΑΛΛΗ ' || k END AS street FROM s""")
def printed_fields(spark, d):
    """Phones, addresses, substances and streets as they are printed, read back."""
    k = F.col("s_suppkey").cast("string")
    phone = F.concat(F.lit("210"), F.lpad(k, 7, "0"))
    of = lambda n, *values: F.get(F.array(*values), (F.col("s_suppkey") % n).cast("int"))
    cell = of(4, F.concat_ws(" ", F.substring(phone, 1, 3), F.substring(phone, 4, 7)), F.lpad(k, 7, "0"), F.concat(phone, F.lit(" / 69"), F.lpad(k, 8, "0")), F.lit("12345 99"))
    line = of(4, F.concat_ws(" ", F.lit("Οδός"), k, F.lit("- ΤΗΛ."), phone), F.concat(F.lit("Οδός "), k, F.lit(", ΤHΛ: "), F.substring(phone, 1, 4), F.lit("-"), F.substring(phone, 5, 6)), F.concat(F.lit("Οδός "), k, F.lit(" - "), phone, F.lit(" 6900000000")), F.concat(F.lit("Οδός "), k, F.lit(" – ")))
    read = titles.address_and_phone(line)
    street = of(3, F.concat(F.lit(" Μ. ΑΛΕΞΑΝΔΡΟΥ "), k), F.concat(F.lit("21 ιουνιου "), k), F.concat(F.lit(" ΑΛΛΗ "), k))
    known = ((r"Μ\.\s*ΑΛΕΞΑΝΔΡΟΥ", "Μεγάλου Αλεξάνδρου"), (r"21\s+ΙΟΥΝΙΟΥ", "21ης Ιουνίου"))
    substance = titles.clean_substance(F.concat(F.lit(" A  "), k, F.lit(":B ;C,")))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(titles.phones_in(cell), ",").alias("phones"), read["address"].alias("address"), read["phone"].alias("phone"), substance.alias("substance"), titles.expand_street(street, known).alias("street"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'https://maps.example/dir?to=' || printf('%.6f', s_suppkey / 8.0) || '%2C' || printf('%.6f', s_suppkey / 4.0) ELSE 'https://maps.example/dir?to=%CE%9F%CE%B4%CF%8C%CF%82%20' || s_suppkey || '%2C%20A%26B' END AS link,
'/?city=area-' || s_suppkey % 7 || CASE WHEN s_suppkey % 2 = 0 THEN '&pharmacy=x' || s_suppkey ELSE '' END AS page,
'line' || chr(10) || s_suppkey || ' "é" /' AS script FROM supplier""")
def links(spark, d):
    """Directions, links to a place, and a script's string read as the browser would."""
    k = F.col("s_suppkey")
    precision = F.when(k % 3 == 0, "street").otherwise("locality")
    target = D.destination(k / 8, k / 4, precision, F.concat(F.lit("Οδός "), k.cast("string")), F.lit("A&B"))
    page = D.map_url("/", F.concat(F.lit("area-"), (k % 7).cast("string")), F.when(k % 2 == 0, F.concat(F.lit("x"), k.cast("string"))))
    script = titles.unescape_js(F.concat(F.lit(r"line\n"), k.cast("string"), F.lit(r" \"é\x22 \/")))
    return table(spark, d, "supplier").select("s_suppkey", D.directions_url("https://maps.example/dir?to={place}", target).alias("link"), page.alias("page"), script.alias("script"))


@query(f"""WITH e AS (SELECT event_id, ts, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens')::DATE AS d FROM events)
SELECT event_id, strftime(d - 1, '%Y-%m-%d') AS first_date, strftime(d + 3, '%Y-%m-%d') AS last_date, 5 AS n_dates, strftime(d, '%Y-%m-%d') AS today,
CASE WHEN event_id % 3 = 0 THEN 'skip' WHEN event_id % 4 = 0 THEN 'denied' WHEN event_id % 4 = 1 THEN 'locate' WHEN event_id % 5 = 0 THEN 'remembered' ELSE 'skip' END AS decision,
CASE WHEN event_id % 6 = 0 THEN 'loading' WHEN event_id % 6 < 3 THEN 'settled' WHEN event_id % 2 = 0 THEN 'loading' ELSE 'unpublished' END AS list_state,
CASE WHEN event_id % 4 = 0 THEN '1,2' WHEN event_id % 4 = 3 THEN '0,1' ELSE CASE event_id % 4 WHEN 1 THEN '0,2' ELSE '0,1,9' END END AS toggled FROM e""")
def first_choices(spark, d):
    """Dates that a first load asks for, whether to ask for a position, what a date's list is waiting for, and a toggled list."""
    i, ts = F.col("event_id"), F.col("ts")
    dates = titles.first_dates(ts, ZONE)
    decision = lists.locate_decision(i % 3 == 0, F.lit(False), F.when(i % 4 == 0, "denied").when(i % 4 == 1, "granted").otherwise("prompt"), i % 5 == 0)
    day = titles.run_date(ts, ZONE)
    only = lambda keep: F.filter(F.array(F.when(keep, day)), lambda x: x.isNotNull())
    inside = (i % 6 < 3) | (i % 2 == 0)
    state = lists.list_state(day, F.when(inside, day), F.when(inside, day), only(i % 6 == 0), only(i % 6 < 3))
    listed = F.when(i % 4 == 2, F.expr("array(0L, 1L)")).otherwise(F.expr("array(0L, 1L, 2L)"))
    flipped = lists.toggled(listed, F.when(i % 4 == 2, F.lit(9)).when(i % 4 == 3, F.lit(2)).otherwise(i % 4).cast("long"), 3)
    return table(spark, d, "events").select("event_id", F.get(dates, F.lit(0)).cast("string").alias("first_date"), F.element_at(dates, -1).cast("string").alias("last_date"), F.size(dates).alias("n_dates"), day.cast("string").alias("today"), decision.alias("decision"), state.alias("list_state"), F.array_join(flipped, ",").alias("toggled"))
