"""Rows of a year's printed table: cut ones, mixed cells, refused ones."""

import pytest
from pyspark.sql import functions as F

from orarium.sources import yearly

SCHEMA = "doc int, page int, position int, x double, y double, width double, height double, text string"


def page_items(*items):
    """(page, x, y, text) in printed order; a town's heading is told by its year."""
    return [(1, page, k, float(x), float(y), 10.0, 11.0 if text and text.endswith(" 2026") else 8.0, text) for k, (page, x, y, text) in enumerate(items)]


def read(spark, *items):
    found = yearly.rows(spark.createDataFrame(page_items(*items), SCHEMA))
    return {r.date_text: r for r in found.collect()}


def row(page, y, date, hours="08:00-21:00", phone="2622000001", flag="Ναι"):
    cells = [(page, 30, y, date), (page, 100, y, hours), (page, 200, y, "ΟΝΟΜΑ"), (page, 300, y, "ΟΔΟΣ 1"), (page, 400, y, phone), (page, 450, y, flag)]
    return [c for c in cells if c[3] is not None]


TOWN = (1, 30, 790, "ΠΟΛΗ 2026")


def test_a_tail_completes_the_first_row_without_a_flag(spark):
    cut = [(1, 30, 650, "2/1/2026, Παρασκευή"), (1, 200, 650, "ΑΛΦΑ"), (1, 300, 650, "ΟΔΟΣ 2")]
    tail = [(1, 100, 560, "17:00-08:00"), (1, 400, 560, "2622000002"), (1, 450, 560, "Όχι")]
    got = read(spark, TOWN, *row(1, 700, "1/1/2026, Πέμπτη"), *cut, *row(1, 600, "3/1/2026, Σάββατο"), *tail)
    mended = got["2/1/2026, Παρασκευή"]
    assert (mended.hours, mended.phone, mended.overnight, mended.name, mended.address, mended.reasons) == ("17:00-08:00", "2622000002", False, "ΑΛΦΑ", "ΟΔΟΣ 2", [])
    assert all(r.reasons == [] for r in got.values()) and len(got) == 3


def test_a_tail_waits_for_the_next_page_and_no_longer(spark):
    tail = [(1, 100, 560, "17:00-08:00"), (1, 400, 560, "2622000002"), (1, 450, 560, "Όχι")]
    start = [TOWN, *row(1, 600, "1/1/2026, Πέμπτη"), *tail]
    cut = lambda page: [(page, 30, 700, "2/1/2026, Παρασκευή"), (page, 200, 700, "ΑΛΦΑ"), (page, 300, 700, "ΟΔΟΣ 2")]
    assert read(spark, *start, *cut(2))["2/1/2026, Παρασκευή"].phone == "2622000002"
    late = read(spark, *start, *row(2, 700, "3/1/2026, Σάββατο"), *cut(3))
    assert late["2/1/2026, Παρασκευή"].reasons == ["hours", "phone", "flag"] and late["1/1/2026, Πέμπτη"].reasons == []


def test_lines_at_the_top_go_on_with_the_last_row(spark):
    open_row = row(1, 600, "1/1/2026, Πέμπτη", hours="08:00-14:30 &")
    got = read(spark, TOWN, *open_row, (2, 100, 780, "17:30-08:00"), *row(2, 700, "2/1/2026, Παρασκευή"))
    assert got["1/1/2026, Πέμπτη"].hours == "08:00-14:30 & 17:30-08:00"
    other = read(spark, TOWN, *open_row, (2, 30, 790, "ΑΛΛΗ 2026"), (2, 100, 780, "17:30-08:00"), *row(2, 700, "2/1/2026, Παρασκευή"))
    assert other["1/1/2026, Πέμπτη"].reasons == ["hours"] and other["17:30-08:00"].reasons == ["orphan"] and other["2/1/2026, Παρασκευή"].town == "ΑΛΛΗ"


@pytest.mark.parametrize(("change", "reasons"), [({"date": "31/2/2026, Τρίτη"}, ["date"]), ({"date": "1/1/2026, Τρίτη"}, ["weekday"]), ({"date": "1/1/2026,"}, ["weekday"]), ({"hours": "08:00-"}, ["hours"]), ({"hours": None}, ["hours"]), ({"phone": "26220"}, ["phone"]), ({"phone": "2622000001 2622000002"}, ["phone"]), ({"flag": "Ναι Όχι"}, ["flag"])])
def test_a_row_that_contradicts_itself_is_refused(spark, change, reasons):
    values = {"date": "1/1/2026, Πέμπτη"} | change
    (got,) = read(spark, TOWN, *row(1, 700, **values)).values()
    assert got.reasons == reasons


def test_mixed_cells(spark):
    texts = [("2624023306 Δευτέρα",), ("Ναι ΠΟΛΙΤΗΣ",), ("ΕΘΝ. ΟΔΟΣ - 2625036166",), ("Δευτέρα",), ("ΑΓ. ΠΑΡΑΣΚΕΥΗ 4",), ("Ναι ΔΕΥΤΕΡΑ Τρίτη",), ("ΚΥΡΙΑΚΗ ΑΛΦΑ Όχι",), ("",), (None,)]
    got = yearly.peeled(spark.createDataFrame(texts, "text string").withColumn("kind", F.lit("cell"))).collect()
    assert [(r.phones, r.flags, r.side, r.rest) for r in got] == [
        (["2624023306"], [], "Δευτέρα", ""), ([], ["Ναι"], None, "ΠΟΛΙΤΗΣ"), (["2625036166"], [], None, "ΕΘΝ. ΟΔΟΣ -"), ([], [], None, "Δευτέρα"), ([], [], None, "ΑΓ. ΠΑΡΑΣΚΕΥΗ 4"),
        ([], ["Ναι"], "Τρίτη", ""), ([], ["Όχι"], "ΚΥΡΙΑΚΗ", "ΑΛΦΑ"), ([], [], None, ""), ([], [], None, None),
    ]


def test_no_items_no_town_and_null_text(spark):
    assert yearly.rows(spark.createDataFrame([], SCHEMA)).count() == 0
    assert read(spark, *row(1, 700, "1/1/2026, Πέμπτη")) == {}
    assert list(read(spark, TOWN, (1, 30, 750, None), *row(1, 700, "1/1/2026, Πέμπτη"))) == ["1/1/2026, Πέμπτη"]


def test_a_named_row_without_a_name(spark):
    got = read(spark, TOWN, (1, 30, 700, "1/1/2026 ΠΕΜΠΤΗ"), (1, 100, 700, "ΝΑΙ"), (1, 300, 700, "ΔΙΑΝΥΚΤΕΡΕΥΣΗ"), (1, 400, 700, "ΠΟΛΗ"), (1, 30, 650, "2/1/2026 ΠΑΡΑΣΚΕΥΗ"), (1, 200, 650, "ΑΛΦΑ"))
    assert got["1/1/2026 ΠΕΜΠΤΗ"].reasons == ["name"]
    assert (got["2/1/2026 ΠΑΡΑΣΚΕΥΗ"].name, got["2/1/2026 ΠΑΡΑΣΚΕΥΗ"].overnight, got["2/1/2026 ΠΑΡΑΣΚΕΥΗ"].reasons) == ("ΑΛΦΑ", True, [])


def test_usual_columns_take_a_row_with_one_text(spark):
    lone = [(1, 30, 600, "3/1/2026, Σάββατο"), (1, 100, 600, "08:00-21:00"), (1, 295, 600, "ΟΔΟΣ 7"), (1, 400, 600, "2622000003"), (1, 450, 600, "Ναι")]
    got = read(spark, TOWN, *row(1, 700, "1/1/2026, Πέμπτη"), *lone, *row(1, 500, "4/1/2026, Κυριακή"))
    assert (got["3/1/2026, Σάββατο"].name, got["3/1/2026, Σάββατο"].address) == ("", "ΟΔΟΣ 7")
