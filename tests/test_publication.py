"""What a site publishes: only what changed is written, nothing outside the allowed paths."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from orarium.sources import publication, sinks

D = datetime.date


def tables(spark, extended=("extended-hours/a_b.json",), name="x"):
    areas = spark.createDataFrame([("one", D(2026, 1, 1), D(2026, 1, 31), list(extended)), ("two", None, None, [])], "area string, from date, to date, extended array<string>")
    places = spark.createDataFrame([("one", 10, 1.0, 2.0, name), ("one", 9, None, None, 'q"'), ("one", 9, None, None, 'q"'), ("gone", 1, 1.0, 1.0, "z")], "area string, id int, lat double, lon double, name string")
    duties = spark.createDataFrame([("one", D(2026, 1, d), 10) for d in (2, 3, 10, 31)] + [("two", D(2026, 1, 10), 5)], "area string, date date, id int")
    hours = spark.createDataFrame([("one", "extended-hours/a_b.json", 10), ("one", "extended-hours/other.json", 10)], "area string, file string, id int")
    return publication.plan(areas, places, duties, hours, F.lit("2026-01-10").cast("date"))


def files(lines):
    out = {}
    for r in lines.orderBy("path", "part", "key").collect():
        out[r.path] = out.get(r.path, "") + r.line
    return out


def test_files_of_a_plan(spark):
    got = files(tables(spark))
    assert sorted(got) == ["national/2026-01-10.json", "national/index.json", "national/places.json", "one/duties/2026-01-03.json", "one/duties/2026-01-10.json", "one/duties/2026-01-31.json", "one/extended-hours/a_b.json", "one/meta.json", "one/pharmacies.json", "two/duties/2026-01-10.json", "two/meta.json"]
    assert got["one/pharmacies.json"] == '[{"area":"one","id":9,"name":"q\\""},{"area":"one","id":10,"lat":1.0,"lon":2.0,"name":"x"}]'
    assert got["national/index.json"] == '[{"date":"2026-01-10","areas":2,"rows":2}]' and got["national/places.json"].count("id") == 1
    assert got["one/meta.json"] == '{"area":"one","duties":{"from":"2026-01-01","to":"2026-01-31","dates":["2026-01-03","2026-01-10","2026-01-31"]},"extendedHours":["extended-hours/a_b.json"]}'
    assert got["two/meta.json"] == '{"area":"two","extendedHours":[]}'


def test_a_path_that_leaves_its_folder_is_an_error(spark):
    with pytest.raises(Exception, match="not a path to publish"):
        tables(spark, extended=("extended-hours/../inputs.json",)).collect()
    paths = ["one/meta.json", "one/inputs/x.json", "one/duties/2026-01-01.json", "one/duties/2026.json", "one/extended-hours/A.b-c_1.json", "one/extended-hours/..json", None]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(sinks.is_published_path(F.col("p"))).collect()]
    assert got == [True, False, True, False, True, False, None]


def test_only_changed_files_are_written(spark, tmp_path):
    folder = str(tmp_path / "site")
    stamps = lambda: {os.path.relpath(p, folder): {f for f in fs if f.endswith(".parquet")} for p, _, fs in os.walk(folder) if "file=" in p}
    publication.write(tables(spark), folder)
    first = stamps()
    publication.write(tables(spark), folder)
    assert stamps() == first
    publication.write(tables(spark, extended=(), name="y"), folder)
    after = stamps()
    touched = {p for p in first if after.get(p) != first[p]}
    assert touched == {"area=one/kind=root/file=pharmacies.json", "area=one/kind=root/file=meta.json", "area=national/kind=root/file=places.json", "area=one/kind=extended-hours/file=a_b.json"}
    assert "area=one/kind=extended-hours/file=a_b.json" not in after


def test_empty_tables(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    lines = publication.plan(empty("area string, from date, to date, extended array<string>"), empty("area string, id int, lat double, lon double"), empty("area string, date date, id int"), empty("area string, file string, id int"), F.lit("2026-01-10").cast("date"))
    assert lines.count() == 0
