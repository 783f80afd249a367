"""Operators of lists, rosters, pages and files on small rows; the queries compare them at scale."""

import pytest
from pyspark.sql import functions as F

from orarium.functions import display, titles
from orarium.functions.geo import haversine
from orarium.functions.text import format_phone
from orarium.operators import ranges, resolve, roster, spatial, visits
from orarium.sources import pages, sinks
from orarium.streaming import streams


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_distance_needs_all_coordinates(spark):
    got = values(spark, [(1.0, 2.0, 1.0, 2.0), (None, 2.0, 1.0, 2.0), (1.0, 2.0, 1.0, None)], "a double, b double, c double, d double", haversine(*map(F.col, "abcd")))
    assert got == [(0.0,), (None,), (None,)]


def test_a_long_script_is_read(spark):
    features = ",".join(f'{{"geometry": {{"coordinates": [{k}, 1.5]}}, "properties": {{"pharmacy_id": {k}, "pharmacy_name": "O\\\'N {k}", "pharmacy_address": "x", "duties": {{}}}}}}' for k in range(5000))
    page = spark.createDataFrame([(1, f"<script>var data = '{{\"features\": [{features}]}}';</script>"), (2, "nothing"), (3, None)], "page_id long, html string")
    got = pages.map_entities(page)
    assert got.count() == 5000 and got.where("id = 4999").first().name == "O'N 4999"


def test_titles_without_a_date(spark):
    texts = [("Κυριακή 03 Οκτ 2026",), ("Σάββατο 03 Οκτ 2026",), ("Σάββατο 31 Φεβ 2026",), ("",), (None,)]
    assert [r[0] and str(r[0]) for r in values(spark, texts, "t string", titles.weekday_date(F.col("t")))] == [None, "2026-10-03", None, None, None]
    assert values(spark, [("31/02/24",), ("1/2/2024",), ("1/2/24x",)], "t string", titles.numeric_date(F.col("t")).cast("string")) == [(None,), ("2024-02-01",), (None,)]
    with pytest.raises(ValueError):
        titles.run_date(F.current_timestamp(), "UTC", "2024-01-01", production=True)


def test_numbers_as_text(spark):
    assert values(spark, [(4.0,), (996.0,), (1500.0,), (12_400.0,)], "m double", display.distance_text(F.col("m"))) == [("10 m",), ("1,000 m",), ("1.5 km",), ("12 km",)]
    assert values(spark, [("2310 123456",), ("6941234567",), ("112",)], "p string", format_phone(F.col("p"))) == [("2310 123456",), ("694 123 4567",), ("112",)]
    assert values(spark, [(0,), (61,), (120,)], "m int", display.duration_text(F.col("m"), display.WORDS["en"])) == [("1 minute",), ("1 hour 1 minute",), ("2 hours",)]


def test_running_sums_over_partitions(spark):
    rows = spark.createDataFrame([(k * 37 % 101, k) for k in range(101)], "k long, v long").repartition(7)
    got = sorted((r.k, r.s, r.n) for r in ranges.running(rows, [F.col("k").asc()], s=F.col("k"), n=F.lit(1)).collect())
    assert got == [(k, k * (k + 1) // 2, k + 1) for k in range(101)]
    assert ranges.numbered(rows.limit(0), [F.col("k").asc()], "n").count() == 0


def test_nearest_of_many_targets(spark, monkeypatch):
    monkeypatch.setattr(spatial, "FEW_TARGETS", 3)
    targets = spark.createDataFrame([(k, 35.0 + k * 0.31 % 6, 20.0 + k * 0.77 % 7) for k in range(40)], "t long, lat double, lon double")
    points = spark.createDataFrame([(k, 35.0 + k * 0.53 % 6, 20.0 + k * 0.29 % 7) for k in range(60)] + [(99, None, 21.0)], "p long, lat double, lon double")
    few = spatial.nearest(points.where("lat IS NOT NULL"), targets, "p", "t", lambda d: F.round(d))
    monkeypatch.setattr(spatial, "FEW_TARGETS", 1000)
    many = spatial.nearest(points.where("lat IS NOT NULL"), targets, "p", "t", lambda d: F.round(d))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_offers_end_as_turns_would(spark):
    rows = [("l", 1, 1, "x", 1, 1.9, True), ("l", 2, 2, "x", 1, 1.8, True), ("l", 2, 2, "y", 2, 1.7, True), ("l", 3, 3, "y", 2, 1.6, True), ("l", 4, 4, "x", 1, 0.9, False), ("l", 5, 5, "z", 3, 0.8, False)]
    got = resolve.greedy_assignment(spark.createDataFrame(rows, "l string, e long, position long, o string, other_position long, score double, strong boolean"), "l", "e", "o")
    assert sorted((r.e, r.o) for r in got.collect()) == [(1, "x"), (2, "y"), (3, None), (4, None), (5, "z")]


def test_a_client_that_never_pauses(spark):
    events = spark.createDataFrame([(k, 1 if k % 3 else 2, k * 20) for k in range(3000)], "id long, client long, s long").select("id", "client", F.timestamp_seconds("s").alias("at"))
    got = {r.id: r.allowed for r in visits.rate_limit(events, "client", "at", "id").collect()}
    for client in (1, 2):
        own = [k for k in range(3000) if (1 if k % 3 else 2) == client]
        assert [got[k] for k in own] == visits.accept([k * 20 for k in own], visits.RATE_LIMIT, visits.RATE_WINDOW)


def test_rosters(spark):
    stored, named = (spark.createDataFrame([(p,) for p in x], "phone string") for x in ("ab", "bc"))
    run = lambda *how: sorted(r.phone for r in roster.next_roster(stored, named, *how).collect())
    assert run(True, True) == ["b", "c"] and run(True, False) == run(False, True) == ["a", "b", "c"]


def test_partitions_without_rows_go(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string")
    sinks.write_changed(rows, path, ["k"])
    sinks.write_changed(rows.where("k = 'a'").withColumn("v", F.col("v") + 1), path, ["k"])
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(2, "a")]


def test_generations(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    write = streams.upsert_sink(path, ["k"], "v", ["x"])
    frame = lambda *rows: spark.createDataFrame(rows, "k int, v int, x string")
    write(frame((1, 1, "a")), 5)
    write(frame().limit(0), 6)
    write(frame((1, 2, "b"), (2, 1, "c")), 7)
    write(frame((1, 1, "old")), 8)
    assert streams.generations(spark, path) == [7, 8]
    assert sorted(map(tuple, spark.read.parquet(f"{path}/8").collect())) == [(1, 2, "b"), (2, 1, "c")]
