"""Running values, periods, places, classes of tokens, searches, visits and bucketed tables against plain loops."""

import math
import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orarium.operators import intervals, periods, ranges, resolve, search, spatial, status, visits
from orarium.streaming import buckets, streams


def rng(seed):
    return random.Random(seed)


# --- running values ---


@pytest.mark.parametrize("hot", [False, True])
def test_running_by_key(spark, hot):
    """Sums, highest and lowest values by key, where one key fills several partitions, with ties and nulls."""
    r = rng(1)
    rows = [(None if k == 3 else k, r.randrange(40), i, None if i % 7 == 0 else r.randrange(100)) for i, k in enumerate([0] * 900 * hot + [r.randrange(6) for _ in range(300)])]
    df = spark.createDataFrame(rows, "k int, t int, i int, v int").repartition(5)
    spec = {"s": F.coalesce("v", F.lit(0)), "top": ranges.Run(F.col("v"), "max", before=True), "low": ranges.Run(F.col("v"), "min")}
    got = {x.i: (x.s, x.top, x.low) for x in ranges.running(df, [F.col("t").asc(), F.col("i").desc()], ["k"], **spec).collect()}
    by = defaultdict(list)
    for k, _, i, v in sorted(rows, key=lambda x: (x[1], -x[2])):
        before = [x for x in by[k] if x is not None]
        by[k].append(v)
        upto = [x for x in by[k] if x is not None]
        assert got[i] == (sum(upto), max(before, default=None), min(upto, default=None))


def test_equal_rows_spread(spark):
    """Rows that are equal in all columns don't share a partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ones would be put together
    df = spark.range(2000).select(F.lit(1).alias("k"))
    placed = ranges.in_order(df, [F.col("k").asc()])
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 1200
    assert sorted(r.n for r in ranges.numbered(df, [F.col("k").asc()], "n").collect()) == list(range(2000))


def test_tables_are_deleted(spark):
    table = ranges.settled(spark.range(3).toDF("x"))
    path = table.scratch_path
    ranges.discard(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)


@pytest.mark.parametrize("hot", [0, 50, 10**6])
def test_islands_of_hot_keys(spark, hot):
    """One key with most intervals gives the same runs however its intervals are spread."""
    r = rng(2)
    rows = [(k, s, s + r.randrange(-1, 6)) for k in [None] + [1] * 400 + [2, 3] * 20 for s in [r.randrange(3000)]]
    got = Counter((x.k, x.start, x.end, x.n_parts) for x in intervals.merge(spark.createDataFrame(rows, "k int, start int, end int"), ["k"], hot=hot).collect())
    want = Counter()
    for k in {x[0] for x in rows}:
        run = None
        for _, s, e in sorted((x for x in rows if x[0] == k and x[2] > x[1]), key=lambda x: x[1:]):
            if run and s <= run[1]:
                run = [run[0], max(run[1], e), run[2] + 1]
            else:
                if run:
                    want[(k, *run)] += 1
                run = [s, e, 1]
        if run:
            want[(k, *run)] += 1
    assert got == want


# --- periods ---


def test_first_period_of_each_date(spark):
    """Single days, long and open periods, reversed ones, missing starts and the ends of the calendar."""
    r = rng(3)
    day = lambda: date(2020, 1, 1) + timedelta(days=r.randrange(1500))
    spans = [(i, r.choice("ab"), d, None if i % 17 == 0 else d + timedelta(days=r.choice([-3, 0, 1, 7, 40, 1000]))) for i, d in enumerate(day() for _ in range(120))]
    spans += [(900, "a", None, date(2021, 1, 1)), (901, "b", date(1, 1, 1), date(9999, 12, 31)), (902, "c", date(2020, 2, 29), date(2020, 2, 29))]
    asked = [(i, r.choice("abc"), day()) for i in range(300)] + [(1000, "c", date(2020, 2, 29)), (1001, "b", date(9999, 12, 31)), (1002, "b", date(1, 1, 1)), (1003, None, day()), (1004, "a", None)]
    p = spark.createDataFrame(spans, "seq int, g string, valid_from date, valid_to date")
    got = {x.i: x.seq for x in periods.first_period(spark.createDataFrame(asked, "i int, g string, date date"), p, "date", "valid_from", "valid_to", "seq", ["g"]).collect()}
    fits = lambda g, d: [s for s, h, f, t in spans if h == g and d and f and f <= d and (t is None or d <= t)]
    assert got == {i: min(fits(g, d), default=None) for i, g, d in asked}
    held = {(x.g, x.date) for x in periods.held(spark.createDataFrame(asked, "i int, g string, date date"), p, "date", "valid_from", "valid_to", ["g"]).collect()}
    assert held == {(g, d) for _, g, d in asked if any(h == g and d and f and t and f <= d <= t for _, h, f, t in spans)}


def test_blocks_cover_their_period(spark):
    rows = [(a, b) for a in range(0, 40) for b in range(a, 40, 3)]
    dated = spark.createDataFrame([(a, b, date(2000, 1, 1) + timedelta(days=a), date(2000, 1, 1) + timedelta(days=b)) for a, b in rows], "a int, b int, f date, t date")
    found = defaultdict(list)
    base = (date(2000, 1, 1) - date(1970, 1, 1)).days + periods.SHIFT
    for x in periods.with_blocks(dated, "f", "t").collect():
        found[x.a, x.b] += range((x.block << x.level) - base, ((x.block + 1) << x.level) - base)
    assert {k: sorted(v) for k, v in found.items()} == {(a, b): list(range(a, b + 1)) for a, b in rows}


# --- places ---


def metres(a, b, radius=6371008.8):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * radius * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("few", [1000, 3])
def test_nearest_leaves_out_what_has_no_place(spark, monkeypatch, few):
    """The same rows by broadcast and by grid: unlocated targets are nobody's, unlocated points have none."""
    monkeypatch.setattr(spatial, "FEW_TARGETS", few)
    r = rng(4)
    points = [(i, *((None, None) if i % 9 == 0 else (40 + r.random(), None if i % 10 == 0 else 22 + r.random()))) for i in range(60)]
    targets = [(9, None, None), (8, 40.5, None), (7, None, 22.5)] + [(100 + i, 40 + r.random(), 22 + r.random()) for i in range(12)]
    got = {x.p: x.t for x in spatial.nearest(spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(targets, "t int, lat double, lon double"), "p", "t").collect()}
    located = [t for t in targets if None not in t]
    assert got == {p: min(located, key=lambda t: (metres((la, lo), t[1:]), t[0]))[0] for p, la, lo in points if la is not None and lo is not None}
    none = spatial.nearest(spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(targets[:3], "t int, lat double, lon double"), "p", "t")
    assert none.count() == 0


def test_places_within_a_radius(spark):
    """All over the globe: poles, the date line, equal places, and keys that must be equal."""
    r = rng(5)
    spot = lambda: (r.choice([r.uniform(-90, 90), 89.99, -89.999, 0.0]), r.choice([r.uniform(-180, 180), 179.999, -179.999]))
    a = [(i, r.choice("xy"), *spot()) for i in range(150)] + [(200, "x", None, 1.0)]
    b = [(i, r.choice("xy"), *spot()) for i in range(150)] + [(300, "x", a[0][2], a[0][3]), (301, "y", 5.0, None)]
    for radius in (2000.0, 300_000.0, 4_000_000.0):
        got = {(x.i, x.j) for x in spatial.within(spark.createDataFrame(a, "i int, g string, lat double, lon double"), spark.createDataFrame(b, "j int, g string, lat double, lon double"), radius, ["g"]).collect()}
        want = {(i, j) for i, g, *p in a for j, h, *q in b if g == h and None not in (*p, *q) and metres(p, q, 6371000.0) <= radius}
        assert got == want


# --- classes of tokens ---


def alike(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize(("least", "longest", "words"), [(0.8, 6, 9), (0.6, 5, 7), (0.5, 30, 12), (0.34, 4, 6), (0.9, 60, 64)])
def test_similar_finds_every_pair(spark, least, longest, words):
    """Combinations of one, two and three tokens, sets of one token, and sizes far apart."""
    r = rng(int(least * 100) + longest)
    sets = [(i, r.sample([f"w{k}" for k in range(words)], r.randrange(0, min(longest, words) + 1))) for i in range(70)]
    sets += [(100 + i, t[: max(1, len(t) - 1)] + ["extra"] * (i % 2)) for i, t in sets[:30]]
    left, right = spark.createDataFrame(sets[:60], "k int, tokens array<string>"), spark.createDataFrame([(i, t) for i, t in sets[40:]], "other int, tokens array<string>")
    got = {(x.k, x.other): round(x.score, 9) for x in resolve.similar(left, right, "k", "other", least).collect()}
    want = {(i, j): round(alike(set(a), set(b)), 9) for i, a in sets[:60] for j, b in sets[40:] if alike(set(a), set(b)) >= least}
    assert got == want


def test_classes_count_what_is_alike(spark):
    r = rng(6)
    sets = [(i, r.sample("abcdef", r.randrange(0, 5))) for i in range(120)] + [(500, None)]
    got = {x.k: (x.class_key, x.n_similar) for x in resolve.similar_within(spark.createDataFrame(sets, "k int, tokens array<string>"), "k", 0.6).collect()}
    known = [(i, set(t or ())) for i, t in sets]
    assert got == {i: (min([j for j, b in known if b == a], default=i) if a else i, sum(alike(a, b) >= 0.6 for j, b in known if j != i)) for i, a in known}


def test_entries_find_the_first_or_the_most_alike(spark):
    r = rng(7)
    names = [" ".join(r.sample(["ALPHA", "BRAVO", "CHARLIE", "DELTA", "ECHO"], r.randrange(1, 4))) for _ in range(60)]
    entries = [(i, n.split(), r.choice("xy")) for i, n in enumerate(names[:30])]
    known = [(100 + i, n.split(), r.choice("xy"), r.randrange(1000)) for i, n in enumerate(names[30:])]
    e, k = spark.createDataFrame(entries, "key int, tokens array<string>, l string"), spark.createDataFrame(known, "id int, tokens array<string>, l string, position int")
    fits = lambda t, place: [(alike(set(t), set(u)), p, i) for i, u, h, p in known if h == place and alike(set(t), set(u)) >= 0.6]
    best = {x.key: x.id for x in resolve.most_alike(e, k, "key", "id", 0.6, by=["l"]).collect()}
    first = {x.key: x.id for x in resolve.most_alike(e, k, "key", "id", 0.6, by=["l"], rank="position").collect()}
    assert best == {i: min(f, key=lambda x: (-x[0], x[1], x[2]))[2] for i, t, place in entries if (f := fits(t, place))}
    assert first == {i: min(f, key=lambda x: (x[1], x[2]))[2] for i, t, place in entries if (f := fits(t, place))}


@pytest.mark.parametrize("shared", [True, False])
def test_greedy_matches_are_those_of_a_loop(spark, shared):
    """Entries that all want the same candidates in one order need few rounds, and get what a loop gives them."""
    r = rng(8)
    scored = []
    for g in ("p", "q"):
        for e in range(40):
            for o in range(25) if shared else r.sample(range(30), 6):
                scored.append((g, f"{g}{e}", e, f"{g}-{o}", o, 1.0 if shared else round(r.uniform(0.8, 1.9), 1), True if shared else r.random() < 0.7))
    frame = spark.createDataFrame(scored, "g string, key string, position int, other string, other_position int, score double, strong boolean")
    got = {x.key: x.other for x in resolve.greedy_assignment(frame, "g", "key", "other").collect()}
    want, taken = {}, set()
    keys = {k: sorted((x for x in scored if x[1] == k), key=lambda x: (-x[5], x[4])) for k in {x[1] for x in scored}}
    for k in sorted(keys, key=lambda k: (keys[k][0][0], -keys[k][0][5], keys[k][0][2])):
        options = [x for n, x in enumerate(keys[k]) if n == 0 or x[6]]
        free = next((x for x in options if x[3] not in taken), None)
        want[k] = free[3] if free else None
        taken |= {free[3]} if free else set()
    assert got == want


def test_searches_equal_single_ones(spark):
    r = rng(9)
    words = ["aspirin", "aspirinum", "asp", "salicyl", "salicylic", "plus", "forte", "standard", "standards"]
    rows = [(i, " ".join(r.sample(words, 2)), r.sample(words, 2), r.sample(words, 1)) for i in range(50)]
    rows = [(i, " ".join(n), n, s) for i, _, n, s in rows]
    asked = [(i, q) for i, q in enumerate([["asp"], ["as", "pl"], ["standardi"], ["aspirinu"], ["zz"], ["a"], ["salicylics", "fo"], ["asp"], ["asp", "zz"], ["plus", "plus"]])]
    prepared = spark.createDataFrame(rows, "id int, name string, name_words array<string>, substance_words array<string>").withColumn("code", F.lpad(F.col("id").cast("string"), 3, "0"))
    got = defaultdict(list)
    for x in sorted(search.search_many(spark.createDataFrame(asked, "query_id int, query_words array<string>"), prepared, "id", ["name", "code"], 4).collect(), key=lambda x: x.nth):
        got[x.query_id].append((x.id, x.score))
    for i, q in asked:
        one = search.ranked_search(prepared, " ".join(q), "name", "code", q).collect()
        assert got[i] == [(x.id, x.score) for x in sorted(one, key=lambda x: (x.score, x.name, x.code))[:4]], q


# --- status ---


def test_next_changes_equal_single_ones(spark):
    at = datetime(2024, 5, 3, 9, 30)
    h = lambda x: at + timedelta(minutes=x)
    openings = spark.createDataFrame([(1, h(-60), h(60)), (1, h(300), h(400)), (2, h(5), h(35)), (3, h(9000), h(9100)), (4, h(50), h(40))], "entity_id int, start timestamp, end timestamp")
    calls = spark.createDataFrame([(h(7), h(200))], "start timestamp, end timestamp")
    asked = [(i, h(m)) for i, m in enumerate([-200, 0, 5, 6, 30, 59, 60, 399, 400, 9099, 20000, 0])]
    got = {x.i: x.next_change for x in status.next_changes(spark.createDataFrame(asked, "i int, at timestamp"), openings, calls, "Europe/Athens").collect()}
    for i, t in asked:
        assert got[i] == status.next_change(openings, calls, F.lit(t), "Europe/Athens").first().next_change


# --- streams ---


def test_visits_are_closed_by_timers(spark, tmp_path):
    """Shuffled micro-batches give the visits of the batch query, and nothing is left of them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = rng(10)
    begin = datetime(2026, 1, 1)
    events = [(r.choice("abc"), begin + timedelta(minutes=r.choice([0, 10, 29, 30, 31]) + 45 * r.randrange(30), seconds=r.randrange(3))) for _ in range(160)]
    late = sorted(events, key=lambda x: x[1])
    parts = [late[i : i + 20] for i in range(0, 160, 20)]
    for k, part in enumerate(parts):
        r.shuffle(part)
        spark.createDataFrame(part, "k string, at timestamp").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    spark.createDataFrame([("z", begin + timedelta(days=30))], "k string, at timestamp").coalesce(1).write.parquet(f"file://{tmp_path}/in/8")
    spark.createDataFrame([("z", begin + timedelta(days=60))], "k string, at timestamp").coalesce(1).write.parquet(f"file://{tmp_path}/in/9")
    source = spark.readStream.schema("k string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    q = streams.closed_visits(source, "k", "at", "30 days").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = Counter((x.key, x.n) for x in spark.table("closed").where("key <> 'z'").collect())
    numbered = visits.sessions(spark.createDataFrame(events, "k string, at timestamp"), ["k"], "at")
    assert got == Counter((x.k, x.n) for x in numbered.groupBy("k", "visit").agg(F.count("*").alias("n")).collect())
    last = [p for p in q.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]
    assert last["numRowsTotal"] <= 4


def test_buckets_merge_on_read(spark, tmp_path):
    """Later versions win over any number of batches; a batch that runs again changes nothing; few buckets are touched."""
    r = rng(11)
    path = f"file://{tmp_path}/t"
    table = buckets.BucketTable(spark, path, ["k"], "v", ["c"], buckets=8, most_deltas=3)
    assert table.read() is None
    want = {}
    for n in range(8):
        rows = [(k, r.randrange(6), r.choice("xyz")) for k in r.sample(range(30), 5 if n else 30)]
        for again in range(1 + (n in (2, 5))):
            table.write(spark.createDataFrame(rows, "k int, v int, c string"), n)
        for k, v, c in rows:
            old = want.get(k)
            if old is None or (v >= old[0] and c != old[1]):
                want[k] = (v, c)
        assert {x.k: (x.v, x.c) for x in buckets.BucketTable(spark, path, ["k"], "v", ["c"]).read().collect()} == want
        now = table.manifest()
        assert max(map(len, now["deltas"].values())) < 3
    assert len(table.manifests()) == buckets.KEPT


@pytest.mark.parametrize("same", [True, False])
def test_nearest_rows_of_crowded_places(spark, same):
    """Half of all rows in one town, many at one spot, others around it and all over the globe."""
    r = rng(12)
    town = [(40.6 + r.random() / 200, 22.9 + r.random() / 200) for _ in range(500)] + [(40.601, 22.901)] * 60
    spots = town + [(40.6 + r.uniform(-1, 1), 22.9 + r.uniform(-1, 1)) for _ in range(60)] + [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(60)] + [(89.9, 10.0), (-90.0, 0.0), (0.0, 180.0), (0.1, -179.9)]
    rows = [(i, *p) for i, p in enumerate(spots)] + [(5000, None, 1.0)]
    others = spark.createDataFrame(rows, "other long, lat double, lon double")
    asked = sorted({*rows[::7], *rows[-8:]}, key=lambda x: x[0])
    points = spark.createDataFrame([(i + (0 if same else 10**6), la, lo) for i, la, lo in asked], "id long, lat double, lon double")
    table = others.withColumnRenamed("other", "id") if same else others
    got = defaultdict(list)
    for x in sorted(spatial.knn(points, table, 4, "id", "other", same=same, metres=lambda d: F.round(d).cast("long")).collect(), key=lambda x: x.nth):
        got[x.id].append((x.other, x.metres))
    for i, *p in asked:
        if None not in p:
            want = sorted((int(metres(p, q) + 0.5), j) for j, *q in rows if None not in q and not (same and j == i))[:4]
            assert got.pop(i + (0 if same else 10**6)) == [(j, m) for m, j in want], (i, p)
    assert not got


def test_a_box_reads_few_row_groups(spark, tmp_path):
    """Of places all over the globe the box of a country lies in a small share of the row groups."""
    import glob

    import pyarrow.parquet as pq

    from orarium.sources import sinks, tables

    path = f"file://{tmp_path}/places"
    rows = spark.range(200_000).select("id", (F.rand(1) * 180 - 90).alias("lat"), (F.rand(2) * 360 - 180).alias("lon"), (F.col("id") % 7).alias("kind"))
    sinks.write_places(rows, path, group_bytes=64 << 10)
    box = (19.0, 34.0, 30.0, 42.0)
    groups, met = 0, 0
    for name in glob.glob(f"{tmp_path}/places/*.parquet"):
        data = pq.ParquetFile(name).metadata
        for g in range(data.num_row_groups):
            column = {data.row_group(g).column(c).path_in_schema: data.row_group(g).column(c).statistics for c in range(data.num_columns)}
            groups += 1
            met += all(column[c].min <= high and column[c].max >= low for c, low, high in (("lon", box[0], box[2]), ("lat", box[1], box[3])))
    assert groups > 40 and met * 8 < groups
    found = tables.places_in_box(spark, path, *box, where=F.col("kind") == 3)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(lat,34.0)" in plan and "EqualTo(kind,3)" in plan
    assert {r.id for r in found.collect()} == {r.id for r in rows.where("kind = 3 AND lat BETWEEN 34 AND 42 AND lon BETWEEN 19 AND 30").collect()}


def test_hours_cells_that_are_not_read(spark):
    """Each way in which a cell has no reading, or two."""
    from orarium.operators import hours

    begin, end = date(2026, 12, 1), date(2026, 12, 31)
    cells = {
        1: (["ΔΕΥΤΕΡΑ"], "days without hours"),
        2: (["08:00-14:00"], "days and hours don't follow each other"),
        3: (["ΔΕΥΤΕΡΑ", "ΤΡΙΤΗ", "08:00-14:00"], "days and hours don't follow each other"),
        4: (["ΔΕΥΤΕΡΑ", "08:00-14:00", "ΔΕΥΤΕΡΑ-ΤΡΙΤΗ", "09:00-15:00"], None),
        5: (["ΔΕΥΤΕΡΑ-ΤΡΙΤΗ-ΤΕΤΑΡΤΗ", "08:00-14:00", "ΤΡΙΤΗ", "09:00-15:00"], "a weekday given twice"),
        6: (["24/12", "08:00-14:00", "24/12/2026", "09:00-15:00"], "a date given twice"),
        7: (["24/11", "08:00-14:00"], "a date outside of the period"),
        8: (["(ΠΛΑΤΕΙΑ)", "ΕΚΤΟΣ ΑΡΓΙΩΝ"], "no hours"),
        9: (["31/02", "08:00-14:00"], "a line that is neither days nor hours"),
        10: (["ΤΡΙΤΗ-ΔΕΥΤΕΡΑ", "08:00-14:00"], "a range of weekdays with more than one reading"),
        11: (["ΤΡΙΤΗ", "14:00-08:00"], "a line that is neither days nor hours"),
        12: ([], "no hours"),
        13: (["ΔΕΥΤΕΡΑ-ΤΕΤΑΡΤΗ", "08:00-14:00", "ΤΡΙΤΗ", "09:00-15:00"], None),
        14: (["ΠΑΡΑΣΚΕΥΗ 24 ΔΕΚΕΜΒΡΙΟΥ", "08:00-14:00"], "a line that is neither days nor hours"),
    }
    frame = spark.createDataFrame([(k, v, begin, end) for k, (v, _) in cells.items()], "cell_id int, lines array<string>, period_from date, period_to date")
    found, problems = hours.hours_of_cells(frame, spark.createDataFrame([], "date date"), spark.createDataFrame([], f"weekday int, ranges {hours.RANGES}"))
    got = {r.cell_id: r.problem for r in problems.collect()}
    # 4: Monday stands in a list, so the pair of days is these two, and Monday is given twice; 13: so is Tuesday's span
    assert got == {k: p for k, (_, p) in cells.items() if p} | {4: "a weekday given twice"}
    assert sorted((r.key, r.ranges[0]["from"]) for r in found.collect()) == [("1", "08:00"), ("2", "09:00"), ("3", "08:00")]
