from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from orarium.functions.calendar import holiday_rows, listed_holidays, orthodox_easter, with_holiday, years_between
from orarium.functions.geo import haversine, round_coordinate, sun_elevation
from orarium.functions.timez import duty_date, format_duration, is_proper_range, iso_weekday, local_to_instant, normalize_time, strict_date, zoned_date, zoned_minutes
from orarium.operators import intervals, schedules, status

ZONE = "Europe/Athens"


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_local_to_instant(spark):
    rows = [("2026-01-15", "08:00"), ("2026-03-29", "03:30"), ("2026-10-25", "03:30"), ("2026-07-01", "00:00"), ("2026-07-01", "24:00"), ("2026-07-01", "8:00"), (None, "08:00")]
    got = values(spark, rows, "d string, t string", local_to_instant(F.to_date("d"), F.col("t"), ZONE))
    assert [g[0] for g in got] == [datetime(2026, 1, 15, 6), datetime(2026, 3, 29, 1), datetime(2026, 10, 25, 0, 30), datetime(2026, 6, 30, 21), None, None, None]


def test_every_minute_comes_back(spark):
    t = spark.range(0, 1440).select(F.format_string("%02d:%02d", (F.col("id") / 60).cast("int"), (F.col("id") % 60).cast("int")).alias("t"), "id")
    at = local_to_instant(F.lit(date(2026, 5, 4)), F.col("t"), ZONE)
    assert t.where((zoned_minutes(at, ZONE) != F.col("id")) | (zoned_date(at, ZONE) != F.lit(date(2026, 5, 4)))).count() == 0


def test_duty_date_uses_the_local_clock(spark):
    rows = [(datetime(2026, 10, 25, 5, 30),), (datetime(2026, 10, 25, 6, 0),), (datetime(2026, 3, 29, 4, 59),), (datetime(2026, 3, 29, 5, 0),)]
    got = values(spark, rows, "at timestamp", duty_date(F.col("at"), ZONE))
    assert [g[0].day for g in got] == [24, 25, 28, 29]


def test_times_and_ranges(spark):
    rows = [("8:00",), ("24:00",), ("24:01",), ("7:60",), ("x",), (None,)]
    assert [g[0] for g in values(spark, rows, "t string", normalize_time(F.col("t")))] == ["08:00", "00:00", None, None, None, None]
    rows = [("08:00", "14:00"), ("14:00", "14:00"), ("21:00", "08:30"), ("17:00", "00:00"), ("00:00", "00:00")]
    assert [g[0] for g in values(spark, rows, "a string, b string", is_proper_range(F.col("a"), F.col("b")))] == [True, False, False, True, False]
    assert [g[0] for g in values(spark, [("2026-02-31",), ("2026-02-28",), ("2026-2-8",)], "d string", strict_date(F.col("d")))] == [None, date(2026, 2, 28), None]
    assert [g[0] for g in values(spark, [(90,), (45,), (120,), (0,)], "m int", format_duration(F.col("m")))] == ["1 h 30 min", "45 min", "2 h", "0 min"]
    assert values(spark, [(date(2026, 10, 5),), (date(2026, 10, 11),)], "d date", iso_weekday(F.col("d"))) == [(1,), (7,)]


def test_easter_and_holidays(spark):
    known = {2023: "2023-04-16", 2024: "2024-05-05", 2025: "2025-04-20", 2026: "2026-04-12", 1900: "1900-04-22", 2099: "2099-04-12"}
    rows = spark.createDataFrame([(y,) for y in [*known, 1899, 2100]], "year int").select("year", orthodox_easter(F.col("year")).cast("string").alias("e")).collect()
    assert {r.year: r.e for r in rows} == known | {1899: None, 2100: None}
    days = holiday_rows(years_between(spark, 2026, 2026), "thessaloniki")
    assert days.count() == 14 and days.where("soft").count() == 2


def test_soft_holidays_follow_the_list(spark):
    days = spark.createDataFrame([(date(2026, 4, 10), None), (date(2026, 4, 10), "far"), (date(2026, 6, 1), None), (date(2026, 10, 28), None), (date(2026, 5, 5), None), (date(2026, 10, 26), "metro"), (date(2026, 10, 26), "far")], "date date, group_id string")
    sections = spark.createDataFrame([(date(2026, 4, 10), "metro", "Φαρμακεία εργάσιμα"), (date(2026, 6, 1), "metro", "Σαββατοκύριακα και Αργίες"), (date(2026, 5, 5), "metro", "αργία"), (date(2026, 5, 9), "metro", "Αργίες")], "date date, group_id string, heading string")
    holidays = holiday_rows(years_between(spark, 2026, 2026), "thessaloniki")
    out = with_holiday(days, holidays, listed_holidays(sections), "metro")
    got = {(r.date.isoformat(), r.group_id): r.is_holiday for r in out.collect()}
    assert got == {("2026-04-10", None): False, ("2026-04-10", "far"): True, ("2026-06-01", None): True, ("2026-10-28", None): True, ("2026-05-05", None): True, ("2026-10-26", "metro"): True, ("2026-10-26", "far"): False}


def test_merge_touching_and_empty(spark):
    rows = [("a", 8, 14, 1), ("a", 14, 21, 2), ("a", 22, 23, 3), ("a", 9, 10, 4), ("a", 30, 30, 5), ("a", 40, 35, 6), ("b", 1, 2, 7), (None, 1, 2, 8)]
    df = spark.createDataFrame(rows, "k string, start int, end int, id int")
    out = intervals.merge(df, ["k"], ids=F.array_sort(F.collect_list("id")))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 8, 21, 3, [1, 2, 4]), ("a", 22, 23, 1, [3]), ("b", 1, 2, 1, [7]), (None, 1, 2, 1, [8])], key=str)
    assert {tuple(r)[:3] for r in intervals.clip(out, F.lit(10), F.lit(22)).collect()} == {("a", 10, 21)}
    assert intervals.overlapping_neighbours(df.where("end > start"), ["k"]).count() == 1


def test_spans_over_clock_changes(spark):
    rows = [("2026-10-24", "21:00", "08:00", True), ("2026-03-28", "21:00", "08:00", True)]
    start, end = intervals.window_span(F.to_date("d"), F.col("a"), F.col("b"), F.col("n"), ZONE)
    got = values(spark, rows, "d string, a string, b string, n boolean", (F.unix_micros(end) - F.unix_micros(start)) / 3.6e9)
    assert [g[0] for g in got] == [12.0, 10.0]
    start, end = intervals.range_span(F.to_date("d"), F.col("a"), F.col("b"), ZONE)
    got = values(spark, [("2026-01-01", "17:00", "00:00"), ("2026-01-01", "14:00", "14:00")], "d string, a string, b string", start, end)
    assert got == [(datetime(2026, 1, 1, 15), datetime(2026, 1, 1, 22)), (None, None)]


def test_join_overnight(spark):
    t = lambda d, h: datetime(2026, 1, d, h)
    days = [[(t(1, 21), t(2, 0))], [(t(2, 0), t(2, 8)), (t(2, 9), t(2, 12))], [(t(3, 20), t(4, 0))], [(t(4, 0), t(5, 0))], []]
    df = spark.createDataFrame([(days,)], "d array<array<struct<start:timestamp,end:timestamp>>>")
    out = df.select(intervals.join_overnight(F.col("d"))).first()[0]
    assert [[tuple(r) for r in day] for day in out] == [[(t(1, 21), t(2, 8))], [(t(2, 9), t(2, 12))], [(t(3, 20), t(4, 0))], [(t(4, 0), t(5, 0))], []]


def test_interval_join_by_day(spark):
    spans = spark.createDataFrame([(1, datetime(2026, 1, 1, 22), datetime(2026, 1, 3, 2))], "k int, start timestamp, end timestamp")
    asked = spark.createDataFrame([(1, datetime(2026, 1, 2, 12)), (1, datetime(2026, 1, 3, 2)), (2, datetime(2026, 1, 2, 12))], "k int, at timestamp")
    assert intervals.covering(spans, asked, "at", ["k"]).count() == 1


# --- the whole composition: documents to status ---

DAY = date(2026, 10, 27)


def listing(entity, day, hours=None, on_call=False, extra=(), kind="on-duty", group="metro", position=0):
    a, b, n = hours or (None, None, None)
    return (entity, day, group, kind, "heading", (0, 0, position), a, b, n, on_call, [tuple(x) for x in extra])


LISTING = "entity_id string, date date, group_id string, kind string, heading string, position struct<g:int,s:int,e:int>, `from` string, `to` string, next_day boolean, on_call boolean, extra array<struct<weekdays:array<int>,`from`:string,`to`:string,except_holidays:boolean>>"
REGULAR = "seq int, valid_from date, valid_to date, groups array<string>, weekday int, ranges array<struct<`from`:string,`to`:string>>"
EXTENDED = "entity_id string, list_from date, list_to date, position int, type string, key string, ranges array<struct<`from`:string,`to`:string>>"


@pytest.fixture(scope="module")
def world(spark):
    entities = ["usual", "duty", "unknown", "called", "closed", "extended", "dated"]
    days = spark.createDataFrame([(e, date(2026, 10, d), None if e != "closed" else "other", d == 28) for e in entities for d in range(26, 32)], "entity_id string, date date, group_id string, is_holiday boolean")
    regular = spark.createDataFrame([(1, date(2026, 1, 1), None, None, d, [("08:00", "14:30"), ("17:00", "21:00")]) for d in (2, 4)] + [(2, date(2026, 1, 1), None, None, d, [("00:00", "23:00")]) for d in (2, 4)] + [(1, date(2026, 1, 1), None, None, 5, [("14:00", "14:00")])], REGULAR)
    extended = spark.createDataFrame(
        [
            ("extended", date(2026, 10, 1), date(2026, 10, 31), 1, "weekly", "2", [("08:00", "23:00")]),
            ("extended", date(2026, 10, 1), date(2026, 10, 31), 2, "weekly", "2", [("01:00", "02:00")]),
            ("extended", date(2026, 10, 1), date(2026, 10, 31), 1, "weekly", "3", [("08:00", "23:00")]),
            ("extended", date(2026, 9, 1), date(2026, 10, 31), 1, "weekly", "4", [("10:00", "11:00")]),
            ("dated", date(2026, 10, 1), date(2026, 10, 31), 1, "dates", "2026-10-28", [("09:00", "13:00")]),
            ("dated", date(2026, 10, 1), date(2026, 10, 31), 1, "dates", "2026-10-27", []),
        ],
        EXTENDED,
    )
    listings = spark.createDataFrame(
        [
            listing("duty", date(2026, 10, 26), ("21:00", "08:00", True), kind="overnight"),
            listing("duty", DAY, ("14:30", "17:00", False), extra=[([2], "13:00", "14:30", True)]),
            listing("unknown", DAY, None),
            listing("called", DAY, ("08:00", "08:00", True), on_call=True),
        ],
        LISTING,
    )
    holidays = spark.createDataFrame([(date(2026, 10, 28), "metro", True)], "date date, group_id string, is_holiday boolean")
    return days, regular, extended, listings, holidays, spark.createDataFrame([(e,) for e in [*entities, "nobody"]], "entity_id string")


def test_openings(world):
    days, regular, extended, listings, holidays, _ = world
    out = schedules.openings(days, regular, extended, listings, holidays, ZONE)
    got = {(r.entity_id, r.date.day, r.start.hour, r.end.hour, r.reason.split("|")[0]) for r in out.where("entity_id IN ('usual', 'duty', 'extended', 'dated', 'called')").collect()}
    assert {g for g in got if g[0] == "usual"} == {("usual", 27, 6, 12, "regular"), ("usual", 27, 15, 19, "regular"), ("usual", 29, 6, 12, "regular"), ("usual", 29, 15, 19, "regular")}
    assert {g for g in got if g[0] == "extended"} == {("extended", 27, 6, 21, "extended"), ("extended", 29, 8, 9, "extended")}
    assert {g for g in got if g[0] == "dated"} == {("dated", 28, 7, 11, "extended"), ("dated", 29, 6, 12, "regular"), ("dated", 29, 15, 19, "regular")}
    assert {g[4] for g in got if g[0] == "duty"} == {"regular", "duty", "duty-extra"}
    assert {g[4] for g in got if g[0] == "called"} == {"regular"}


@pytest.mark.parametrize(
    "hour, minute, expected",
    [
        (7, 0, {"usual": "open", "duty": "open", "unknown": "open", "dated": "closed", "nobody": "closed"}),
        (13, 0, {"usual": "closed", "duty": "open", "unknown": "duty-hours-unknown", "called": "duty-hours-unknown", "extended": "open"}),
        (4, 0, {"duty": "open", "unknown": "closed", "usual": "closed"}),
    ],
)
def test_status(world, hour, minute, expected):
    days, regular, extended, listings, holidays, entities = world
    opened = schedules.openings(days, regular, extended, listings, holidays, ZONE)
    at = F.lit(datetime(2026, 10, 27, hour, minute))
    got = {r.entity_id: r for r in status.status_at(entities, opened, listings, at, ZONE).collect()}
    assert {k: got[k].state for k in expected} == expected
    if hour == 13:
        assert got["duty"].until == datetime(2026, 10, 27, 19) and got["duty"].reasons[0].startswith("duty|") and len(got["duty"].run_reasons) == 4
        assert got["usual"].next_open == datetime(2026, 10, 27, 15) and got["usual"].reasons == ["regular"]
        assert got["called"].on_call and got["nobody"].next_open is None
    if hour == 4:
        assert got["duty"].until == datetime(2026, 10, 27, 19) and not got["duty"].closing_soon


def test_horizon_cuts(spark):
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    at = datetime(2026, 1, 1)
    opened = spark.createDataFrame([("a", datetime(2026, 1, 7), datetime(2026, 1, 9), "x"), ("b", datetime(2026, 1, 8), datetime(2026, 1, 9), "x"), ("c", datetime(2025, 12, 31), datetime(2026, 2, 1), "x")], "entity_id string, start timestamp, end timestamp, reason string")
    none = spark.createDataFrame([], LISTING)
    got = {r.entity_id: r for r in status.status_at(entities, opened, none, F.lit(at), ZONE).collect()}
    assert got["a"].next_open == datetime(2026, 1, 7) and got["b"].next_open is None and got["c"].until == datetime(2026, 1, 8)


def test_coverage_and_next_change(spark):
    lists = spark.createDataFrame([(date(2026, 1, 1), "a"), (date(2026, 1, 2), "a"), (date(2026, 1, 2), "b")], "date date, group_id string")
    known = spark.createDataFrame([("a",), ("c",), (None,)], "group_id string")
    r = status.coverage(lists, known, F.lit(date(2026, 1, 1))).first()
    assert (r.duties, r.published, r.missing, r.duties_to) == (True, ["a"], ["b", "c"], date(2026, 1, 2))
    needed = spark.createDataFrame([("x", "a", date(2026, 1, 1), date(2026, 1, 2)), ("y", "b", date(2026, 1, 1), date(2026, 1, 2))], "entity_id string, group_id string, first date, last date")
    assert {r.entity_id: r.published for r in status.published_dates(lists, needed).collect()} == {"x": True, "y": False}
    opened = spark.createDataFrame([(datetime(2026, 1, 1, 9), datetime(2026, 1, 1, 12))], "start timestamp, end timestamp")
    called = spark.createDataFrame([], "start timestamp, end timestamp")
    at = lambda h, m=0: status.next_change(opened, called, F.lit(datetime(2026, 1, 1, h, m)), ZONE).first()[0]
    assert [at(7), at(9), at(11, 30), at(12)] == [datetime(2026, 1, 1, 9), datetime(2026, 1, 1, 11, 30), datetime(2026, 1, 1, 12), datetime(2026, 1, 1, 22)]


def test_places_and_sun(spark):
    got = values(spark, [(40.6401, 22.9444, 37.9838, 23.7275)], "a double, b double, c double, d double", haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    assert abs(got[0][0] - 302_400) < 1_000
    rows = [(datetime(2026, 6, 21, 10, 30),), (datetime(2026, 12, 21, 0, 0),)]
    noon, night = (g[0] for g in values(spark, rows, "t timestamp", sun_elevation(F.col("t"), F.lit(40.64), F.lit(22.94))))
    assert 72 < noon < 73.5 and night < -60
    assert values(spark, [(-1.000005,), (1.000005,)], "x double", round_coordinate(F.col("x")))[1][0] == pytest.approx(1.00001)
