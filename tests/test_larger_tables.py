"""Queries on keys, dates and ties that only larger copies of the tables hold, beside their SQL."""

import math
import tempfile

import duckdb
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from orarium.operators import ranges, resolve, roster, spatial
from orarium.sources import pages, yearly

SF = "/root/testdata/sf0.001"


def both(spark, name, **tables):
    """Rows of a query and of its SQL (one thread) over tables given as SQL."""
    folder = tempfile.mkdtemp(prefix="orarium-larger-")
    con = duckdb.connect(config={"threads": 1})
    con.execute("SET TimeZone = 'UTC'")
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    got = queries()[name](spark, folder)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {columns} FROM ({oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def haversine_of(a, b):
    half = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(min(1.0, math.sqrt(half)))


def test_phones_of_long_keys(spark):
    parts = f"SELECT * REPLACE (p_partkey + r AS p_partkey) FROM '{SF}/part.parquet', (VALUES (0::BIGINT), (1_234_500), (123_456_700)) t(r)"
    got, want = both(spark, "numbers_as_text", part=parts)
    assert got == want


def test_lines_with_one_number(spark):
    lines = "SELECT l_orderkey::BIGINT AS l_orderkey, 1::INT AS l_linenumber, l_suppkey::BIGINT AS l_suppkey FROM (VALUES (1, 8), (1, 4), (2, 4), (2, 8), (3, 3), (3, 12), (3, 8)) t(l_orderkey, l_suppkey)"
    got, want = both(spark, "rows_by_any_phone", lineitem=lines, supplier="SELECT s::BIGINT AS s_suppkey FROM range(20) t(s)")
    assert got == want == [(12, 3), (4, 2), (8, 1)]


def test_numbers_that_no_supplier_has(spark):
    lines = "SELECT l_orderkey::BIGINT AS l_orderkey, 1::INT AS l_linenumber, l_suppkey::BIGINT AS l_suppkey FROM (VALUES (1, 40), (1, 4), (2, 4), (3, 5), (NULL, 44), (4, NULL)) t(l_orderkey, l_suppkey)"
    got, want = both(spark, "rows_by_any_phone", lineitem=lines, supplier="SELECT s::BIGINT AS s_suppkey FROM range(20) t(s)")
    assert got == want == [(4, 2), (40, 1), (44, None)]


def test_lines_without_a_number(spark):
    lines = "SELECT l_orderkey::BIGINT AS l_orderkey, p::INT AS l_linenumber, l_suppkey::BIGINT AS l_suppkey FROM (VALUES (1, NULL, 8), (1, 3, 4), (2, NULL, 12), (5, NULL, 8), (6, 1, 5), (6, NULL, 7)) t(l_orderkey, p, l_suppkey)"
    got, want = both(spark, "rows_by_any_phone", lineitem=lines, supplier="SELECT s::BIGINT AS s_suppkey FROM range(20) t(s)")
    assert got == want == [(4, 1), (None, 2)]


def test_duties_until_september(spark):
    events = "SELECT u::BIGINT AS event_id, u::BIGINT AS user_id, TIMESTAMP '2024-01-05 10:00:00' + to_days((u % 300)::INT) AS ts, 'purchase' AS event_type FROM range(600) t(u)"
    got, want = both(spark, "status_rows", events=events)
    assert got == want and any(" Sep " in r[2] for r in got) and any((r[3] or "").endswith(" Sep") for r in got)


def test_easter_of_every_year(spark):
    orders = "SELECT TIMESTAMP '1997-03-04 00:00:00' AS o_orderdate UNION ALL SELECT TIMESTAMP '2104-03-04 00:00:00' UNION ALL SELECT NULL"
    got, want = both(spark, "easter_dates", orders=orders)
    assert got == want and len(got) == 202


def test_a_town_page_is_dated_once(spark):
    entry = '<center><span style="color: #000080"><strong>N {k}</strong></span><br>S {k} - ΤΗΛ. 2310000000<br/></center>'
    html = "<h3> Δευτέρα 02/11/2026 </h3><center><font style='color:#800000'>H</font></center>" + "".join(entry.replace("{k}", str(k)) for k in range(300))
    found = pages.town_duties(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    assert found.count() == 300 and {str(r.date) for r in found.select("date").collect()} == {"2026-11-02"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate posexplode", 1)
    assert "<h3" in below and "<h3" not in above


def test_few_targets_make_no_pairs(spark):
    points = spark.createDataFrame([(k, 35.0 + k % 7, 20.0 + k % 5) for k in range(50)], "p long, lat double, lon double")
    targets = spark.createDataFrame([(k, 35.0 + k, 20.0 + k) for k in range(5)], "t long, lat double, lon double")
    found = spatial.nearest(points, targets, "p", "t")
    far = lambda p, t: haversine_of((p % 7 + 35.0, p % 5 + 20.0), (35.0 + t, 20.0 + t))
    assert {r.p: r.t for r in found.collect()} == {p: min(range(5), key=lambda t: (far(p, t), t)) for p in range(50)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "array_min" in plan


def test_rows_are_dealt_by_their_number(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 7)
    dealt = ranges.spread(rows, "g", rows=50)
    assert dealt.rdd.getNumPartitions() == 20 and ranges.spread(rows, "g").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert dealt.withColumn("p", F.spark_partition_id()).groupBy("g").agg(F.count_distinct("p").alias("n")).where("n > 1").isEmpty() and dealt.count() == 1000


def test_rows_stay_where_their_words_are(spark, monkeypatch):
    rows = [(1, ["alpha", "strong"], []), (2, ["alpha", "strang"], ["x"]), (3, ["beta"], []), (4, ["gamma"], []), (5, ["alpha"], ["far"])]
    members = [(1, ["alpha", "strong"], ["alpha"], "x"), (2, ["alpha", "other"], ["alpha"], "y"), (3, ["beta"], ["beta"], "x"), (4, ["beta"], ["beta"], "y")]
    frames = spark.createDataFrame(rows, "row_id int, words array<string>, hints array<string>"), spark.createDataFrame(members, "member_id int, words array<string>, surnames array<string>, place string")
    want = [(1, 1, "one"), (2, 1, "one"), (3, None, "several"), (4, None, "none"), (5, None, "several")]
    found = roster.match_members(*frames)
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [form" not in plan and plan.count("ObjectHashAggregate") == 0
    monkeypatch.setattr(roster, "SMALL_ROSTER", 1)
    assert sorted(map(tuple, roster.match_members(*frames).collect())) == want


def test_keys_are_made_in_every_task(spark):
    parts = f"SELECT * FROM '{SF}/part.parquet'"
    got, want = both(spark, "greek_keys", part=parts)
    assert got == want
    folder = tempfile.mkdtemp(prefix="orarium-larger-")
    duckdb.sql(f"COPY ({parts}) TO '{folder}/part.parquet'")
    assert queries()["greek_keys"](spark, folder).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_documents_of_a_year_are_dealt_by_items(spark):
    items = spark.createDataFrame([(d, 0, 0, 30.0, 790.0, 10.0, 11.0, "ΠΟΛΗ 2026") for d in range(3)], "doc long, page int, position long, x double, y double, width double, height double, text string")
    found = yearly.rows(items)
    assert found.count() == 0 and "RepartitionByExpression [doc" in found._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_send_no_holders_to_the_driver(spark, monkeypatch):
    rows = [("l", e, e, o, o, 2.0 - abs(e - o) / 100, True) for e in range(6) for o in range(5)]
    plans, settled = {}, resolve.settled

    def watched(df, name="settled"):
        plans.setdefault(name, []).append(df._jdf.queryExecution().sparkPlan().toString())
        return settled(df, name)

    monkeypatch.setattr(resolve, "settled", watched)
    found = resolve.greedy_assignment(spark.createDataFrame(rows, "l string, e long, position long, o long, other_position long, score double, strong boolean"), "l", "e", "o")
    assert sorted((r.e, r.o) for r in found.where("o IS NOT NULL").collect()) == [(k, k) for k in range(5)] and found.count() == 6
    assert len(plans["held"]) > 1 and not any("BroadcastHashJoin" in p for p in [*plans["held"], found._jdf.queryExecution().sparkPlan().toString()])


def test_all_pairs_of_parts_with_their_scores(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 3)
    parts = f"SELECT p_partkey + r * 1000 AS p_partkey, p_name, p_brand, p_type FROM '{SF}/part.parquet', range(7) t(r) WHERE p_partkey < 60 UNION ALL SELECT * FROM (VALUES (9001, NULL, 'Brand#1', 'SMALL'), (9002, NULL, 'Brand#1', 'SMALL'), (9003, 'red bolt', NULL, NULL), (9004, 'red red bolt', NULL, NULL), (9005, 'a b c', 'd', 'e'), (9006, 'a b c', 'd', NULL), (9007, NULL, NULL, NULL), (NULL, 'red bolt', NULL, NULL))"
    got, want = both(spark, "jaccard_parts", part=parts)
    assert got == want and all(left < right and score >= 0.8 for left, right, score in got)
    assert {(9001, 9002, 1.0), (9003, 9004, 1.0), (9005, 9006, 0.8)} <= set(got) and len(got) >= 60 * 21


def test_pairs_of_blocks_are_the_pairs_of_rows(spark, monkeypatch):
    sets = [(k, "abcde"[: 1 + k % 5]) for k in range(60)]
    frame = spark.createDataFrame([(k, list(t)) for k, t in sets] + [(100, []), (101, None)], "k int, tokens array<string>")
    want = {(i, j, len(set(s) & set(t)) / len(set(s) | set(t))) for i, s in sets for j, t in sets if i < j}
    for block in (1, 5, 1000):
        monkeypatch.setattr(resolve, "BLOCK", block)
        got = list(map(tuple, resolve.similar_pairs(frame, "k", "left", "right", 0.6).collect()))
        assert len(got) == len(set(got)) and set(got) == {p for p in want if p[2] >= 0.6}
