"""Queries of the interval, status, schedule and calendar operators over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orarium.functions.calendar import holiday_rows, orthodox_easter
from orarium.functions.geo import sun_elevation
from orarium.functions.timez import duty_date, is_proper_range, iso_weekday, local_to_instant, normalize_time, time_of, zoned_date, zoned_minutes
from orarium.operators import intervals, periods, schedules, status, visits
from orarium.plans.registry import register
from orarium.sources.tables import table

HOUR = 3_600_000_000
#: A fixed instant inside the events, as microseconds (2024-01-15 12:00 UTC).
AT = 1_705_320_000_000_000
ZONE = "Europe/Athens"


def acts(spark: SparkSession, d: str) -> DataFrame:
    """An interval for each event: from its time on, one to four hours."""
    start = F.unix_micros("ts")
    return table(spark, d, "events").select("user_id", "event_id", "event_type", start.alias("start_us"), (start + (F.col("event_id") % 4 + 1) * HOUR).alias("end_us"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge(acts(spark, d), ["user_id"], "start_us", "end_us")


ACTS = "acts AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + (event_id % 4 + 1) * 3600000000 AS e FROM events)"
NUMBERED = f"""{ACTS},
reached AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM acts),
numbered AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM reached)"""
RUNS = f"{NUMBERED}, runs AS (SELECT user_id, min(s) AS start_us, max(e) AS end_us, count(*)::BIGINT AS n_parts FROM numbered GROUP BY user_id, run)"

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = register(QUERIES, ORACLE_SQL)


def at_instant():
    return F.timestamp_micros(F.lit(AT))


def opened(spark: SparkSession, d: str) -> DataFrame:
    """The intervals as openings with instants and a reason."""
    own = acts(spark, d)
    return own.select(F.col("user_id").alias("entity_id"), F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), F.col("event_type").alias("reason"))


def listed(spark: SparkSession, d: str) -> DataFrame:
    """Errors are listings without hours on their duty day; signups are on call for three hours, from their minute on."""
    ts = F.col("ts")
    begin, end = zoned_minutes(ts, ZONE), zoned_minutes(ts, ZONE) + 180
    calling = F.col("event_type") == "signup"
    return table(spark, d, "events").where("event_type IN ('error', 'signup')").select(
        F.col("user_id").alias("entity_id"),
        F.when(calling, zoned_date(ts, ZONE)).otherwise(duty_date(ts, ZONE)).alias("date"),
        F.col("event_type").alias("kind"),
        F.col("event_id").alias("position"),
        F.when(calling, time_of(begin)).alias("from"),
        F.when(calling, time_of(end)).alias("to"),
        (end >= 1440).alias("next_day"),
        calling.alias("on_call"),
    )


def statuses(spark: SparkSession, d: str, past: bool = False) -> DataFrame:
    """Every user, and one that nobody knows, at the fixed instant."""
    entities = table(spark, d, "events").select(F.col("user_id").alias("entity_id")).distinct().union(spark.range(-1, 0).toDF("entity_id"))
    return status.status_at(entities, opened(spark, d), listed(spark, d), at_instant(), ZONE, past)


@query(f"WITH {RUNS} SELECT * FROM runs")
def merge_intervals(spark, d):
    return runs(spark, d)


@query(f"""WITH {RUNS} SELECT user_id, greatest(start_us, {AT}) AS start_us, least(end_us, {AT + 24 * HOUR}) AS end_us, n_parts FROM runs
WHERE least(end_us, {AT + 24 * HOUR}) > greatest(start_us, {AT})""")
def clip_intervals(spark, d):
    return intervals.clip(runs(spark, d), F.lit(AT), F.lit(AT + 24 * HOUR), "start_us", "end_us")


@query(f"WITH {ACTS} SELECT user_id, count(*)::BIGINT AS n_open, max(e) AS latest_end_us FROM acts WHERE s <= {AT} AND {AT} < e GROUP BY user_id")
def open_at_instant(spark, d):
    return acts(spark, d).where(intervals.contains(F.lit(AT), "start_us", "end_us")).groupBy("user_id").agg(F.count("*").alias("n_open"), F.max("end_us").alias("latest_end_us"))


@query(f"""WITH {RUNS}, ahead AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_us) AS n FROM runs WHERE end_us > {AT} AND start_us < {AT + 168 * HOUR})
SELECT user_id, greatest(start_us, {AT}) AS next_us, least(end_us, {AT + 168 * HOUR}) AS until_us FROM ahead WHERE n = 1""")
def next_open(spark, d):
    ahead = acts(spark, d).where((F.col("end_us") > AT) & (F.col("start_us") < AT + 168 * HOUR))
    ahead = intervals.clip(intervals.merge(ahead, ["user_id"], "start_us", "end_us"), F.lit(AT), F.lit(AT + 168 * HOUR), "start_us", "end_us")
    return ahead.groupBy("user_id").agg(F.min("start_us").alias("next_us"), F.min_by("end_us", "start_us").alias("until_us"))


STATUSES = f"""{RUNS}, ahead AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_us) AS n FROM runs WHERE end_us > {AT} AND start_us < {AT + 168 * HOUR}),
first_run AS (SELECT user_id, start_us, least(end_us, {AT + 168 * HOUR}) AS until_us FROM ahead WHERE n = 1),
local AS (SELECT user_id, event_type, ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens' AS at FROM events),
now AS (SELECT make_timestamp({AT}) AS ts, (make_timestamp({AT}) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens' AS at),
known AS (SELECT DISTINCT user_id FROM events UNION ALL SELECT -1),
on_list AS (SELECT user_id, bool_or(event_type = 'error' AND (l.at - INTERVAL 8 HOUR)::DATE = (now.at - INTERVAL 8 HOUR)::DATE) AS unread,
  bool_or(event_type = 'signup' AND date_trunc('minute', l.ts) <= now.ts AND now.ts < date_trunc('minute', l.ts) + INTERVAL 3 HOUR) AS calling FROM local l, now GROUP BY user_id),
statuses AS (SELECT user_id, start_us, until_us, coalesce(start_us <= {AT}, false) AS is_open, coalesce(unread, false) AS unread, coalesce(calling, false) AS calling
  FROM known LEFT JOIN first_run USING (user_id) LEFT JOIN on_list USING (user_id))"""


@query(f"WITH {STATUSES} SELECT user_id, until_us - {AT} AS left_us FROM statuses WHERE is_open AND until_us - {AT} <= 1800000000")
def closing_soon(spark, d):
    soon = statuses(spark, d).where("closing_soon")
    return soon.select(F.col("entity_id").alias("user_id"), (F.unix_micros("until") - AT).alias("left_us"))


@query(f"""WITH {ACTS}, moments AS (SELECT unnest([s, e, e - 1800000000, s - {168 * HOUR} + 1000]) AS t FROM acts UNION ALL SELECT unnest([{AT + 12 * HOUR}, {AT + 20 * HOUR}])
UNION ALL SELECT unnest([s, s + {3 * HOUR}]) FROM acts WHERE event_type = 'signup')
SELECT min(t) AS next_us FROM moments WHERE t > {AT}""")
def next_status_change(spark, d):
    """In UTC, so that the day's own clock is midnight and 8 in the morning there."""
    calls = opened(spark, d).where("reason = 'signup'").select("start", (F.col("start") + F.expr("INTERVAL 3 HOURS")).alias("end"))
    return status.next_change(opened(spark, d), calls, at_instant(), "UTC").select(F.unix_micros("next_change").alias("next_us"))


@query(f"""WITH {RUNS}, x AS (SELECT unnest([start_us, end_us]) AS at_us, unnest([1, 0]) AS opened FROM runs), g AS (SELECT at_us, sum(opened)::BIGINT AS opened, (count(*) - sum(opened))::BIGINT AS closed FROM x GROUP BY at_us)
SELECT *, (sum(opened - closed) OVER (ORDER BY at_us))::BIGINT AS n_open FROM g""")
def state_changes(spark, d):
    """Every instant at which a user opens or closes, and how many are open from then on."""
    return status.state_changes(opened(spark, d)).select(F.unix_micros("at").alias("at_us"), "opened", "closed", "n_open")


@query(f"""WITH {ACTS}, moments AS (SELECT unnest([s, e, e - 1800000000, s - {168 * HOUR} + 1000]) AS t FROM acts UNION SELECT unnest([s, s + {3 * HOUR}]) FROM acts WHERE event_type = 'signup'),
now AS (SELECT event_id, epoch_us(ts) AS n FROM events)
SELECT event_id, least(t, (n // {24 * HOUR} + 1) * {24 * HOUR}, ((n - {8 * HOUR}) // {24 * HOUR} + 1) * {24 * HOUR} + {8 * HOUR}) AS next_us FROM now ASOF LEFT JOIN moments ON n < t""")
def next_changes(spark, d):
    """The next instant at which any answer can change, at every event; in UTC."""
    calls = opened(spark, d).where("reason = 'signup'").select("start", (F.col("start") + F.expr("INTERVAL 3 HOURS")).alias("end"))
    asked = table(spark, d, "events").select("event_id", F.col("ts").alias("at"))
    return status.next_changes(asked, opened(spark, d), calls, "UTC").select("event_id", F.unix_micros("next_change").alias("next_us"))


SECONDS = "acts AS (SELECT epoch_us(ts) AS s, epoch_us(ts) + event_id % 40 * 1000000 AS e FROM events WHERE event_id % 40 > 0), reached AS (SELECT *, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM acts), numbered AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM reached)"


@query(f"WITH {SECONDS} SELECT min(s) AS start_us, max(e) AS end_us, count(*)::BIGINT AS n_parts FROM numbered GROUP BY run")
def merge_hot_key(spark, d):
    """All events as intervals of one key, spread over tasks."""
    start = F.unix_micros("ts")
    one = table(spark, d, "events").select(F.lit("all").alias("key"), start.alias("start_us"), (start + F.col("event_id") % 40 * 1_000_000).alias("end_us"))
    return intervals.merge(one, ["key"], "start_us", "end_us", hot=0).drop("key")


@query(f"""WITH {STATUSES} SELECT user_id, CASE WHEN is_open THEN 'open' WHEN unread OR calling THEN 'duty-hours-unknown' ELSE 'closed' END AS state,
CASE WHEN is_open THEN until_us END AS until_us, CASE WHEN NOT is_open THEN start_us END AS next_us,
CASE WHEN NOT is_open AND (unread OR calling) THEN NOT unread END AS on_call FROM statuses""")
def status_classify(spark, d):
    found = statuses(spark, d)
    return found.select(F.col("entity_id").alias("user_id"), "state", F.unix_micros("until").alias("until_us"), F.unix_micros("next_open").alias("next_us"), "on_call")


@query(f"""WITH {NUMBERED}, parts AS (SELECT *, min(s) OVER w AS rs, max(e) OVER w AS re FROM numbered WINDOW w AS (PARTITION BY user_id, run)),
first_run AS (SELECT *, min(run) OVER (PARTITION BY user_id) AS f FROM parts WHERE re > {AT} AND rs < {AT + 168 * HOUR}),
shown AS (SELECT *, CASE WHEN rs <= {AT} THEN s <= {AT} AND {AT} < e ELSE greatest(s, {AT}) = greatest(rs, {AT}) END AS now FROM first_run WHERE run = f),
kinds AS (SELECT user_id, event_type, min((s, e)) AS place, min((s, e)) FILTER (WHERE now) AS place_now FROM shown GROUP BY ALL)
SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY place_now, event_type) FILTER (WHERE place_now IS NOT NULL), '') AS reasons,
string_agg(event_type, ',' ORDER BY place, event_type) AS run_reasons FROM kinds GROUP BY user_id""")
def status_reasons(spark, d):
    """Why just now (or why the next opening), and why in the whole run; in the order of their first appearance."""
    text = lambda c: F.array_join(c, ",").alias(c)
    return statuses(spark, d, past=True).where("run_reasons IS NOT NULL").select(F.col("entity_id").alias("user_id"), text("reasons"), text("run_reasons"))


DAY = AT // (24 * HOUR) * 24 * HOUR


@query(f"""WITH {RUNS}, known AS (SELECT DISTINCT user_id FROM events), spine AS (SELECT user_id, unnest(range({DAY}, {DAY + 24 * HOUR}, {HOUR // 2})) AS t FROM known)
SELECT s.user_id, t AS at_us, r.end_us IS NOT NULL AS is_open, r.end_us AS until_us, coalesce(r.end_us - t <= 1800000000, false) AS closing_soon
FROM spine s LEFT JOIN runs r ON s.user_id = r.user_id AND r.start_us <= t AND t < r.end_us""")
def status_grid(spark, d):
    """Every user at every half hour of a day."""
    known = table(spark, d, "events").select(F.col("user_id").alias("entity_id")).distinct()
    low, high = (F.timestamp_micros(F.lit(x)) for x in (DAY, DAY + 24 * HOUR))
    grid = status.status_grid(known, opened(spark, d), low, high, "INTERVAL 30 MINUTES")
    return grid.select(F.col("entity_id").alias("user_id"), F.unix_micros("at").alias("at_us"), "is_open", F.unix_micros("until").alias("until_us"), "closing_soon")


@query(f"""WITH {RUNS} SELECT count(*)::BIGINT AS n_runs, count(*) FILTER (WHERE start_us <= {AT} AND {AT} < end_us)::BIGINT AS n_open,
count(*) FILTER (WHERE start_us > {AT})::BIGINT AS n_later, count(*) FILTER (WHERE n_parts > 1)::BIGINT AS n_merged FROM runs""")
def status_counts(spark, d):
    return runs(spark, d).agg(
        F.count("*").alias("n_runs"),
        F.count_if(intervals.contains(F.lit(AT), "start_us", "end_us")).alias("n_open"),
        F.count_if(F.col("start_us") > AT).alias("n_later"),
        F.count_if(F.col("n_parts") > 1).alias("n_merged"),
    )


@query(f"""WITH {NUMBERED} SELECT user_id, min(s) AS start_us, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS reasons FROM numbered GROUP BY user_id, run""")
def run_reasons(spark, d):
    merged = intervals.merge(acts(spark, d), ["user_id"], "start_us", "end_us", reasons=F.array_join(F.array_sort(F.collect_set("event_type")), ","))
    return merged.select("user_id", "start_us", "reasons")


@query(f"""WITH {ACTS}, o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM acts)
SELECT user_id, count(*)::BIGINT AS n_overlaps FROM o WHERE s < reached GROUP BY user_id""")
def overlap_check(spark, d):
    return intervals.overlapping_neighbours(acts(spark, d), ["user_id"], "start_us", "end_us").groupBy("user_id").agg(F.count("*").alias("n_overlaps"))


@query("""WITH i AS (SELECT user_id % 10 AS k, event_id, ts AS s, ts + INTERVAL 1 HOUR * (event_id % 4 + 1) AS e FROM events WHERE event_type = 'purchase'),
q AS (SELECT user_id % 10 AS k, event_id AS q_id, ts AS t FROM events WHERE event_type = 'signup')
SELECT q_id, count(*)::BIGINT AS n_covering, min(i.event_id) AS first_id FROM q JOIN i ON q.k = i.k AND i.s <= q.t AND q.t < i.e GROUP BY q_id""")
def interval_join(spark, d):
    e = table(spark, d, "events").withColumn("k", F.col("user_id") % 10)
    spans = e.where("event_type = 'purchase'").select("k", "event_id", F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 4 + 1).cast("int"))).alias("end"))
    asked = e.where("event_type = 'signup'").select("k", F.col("event_id").alias("q_id"), F.col("ts").alias("t"))
    return intervals.covering(spans, asked, "t", ["k"]).groupBy("q_id").agg(F.count("*").alias("n_covering"), F.min("event_id").alias("first_id"))


SPLIT = f"days AS (SELECT user_id, day, greatest(start_us, day * {24 * HOUR}) AS s, least(end_us, (day + 1) * {24 * HOUR}) AS e FROM (SELECT user_id, start_us, end_us, unnest(range(start_us // {24 * HOUR}, (end_us - 1) // {24 * HOUR} + 1)) AS day FROM runs))"


def day_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The runs cut at midnight, with the number of the day."""
    whole = intervals.merge(opened(spark, d).withColumnRenamed("entity_id", "user_id"), ["user_id"])
    return intervals.split_days(whole).withColumn("day", F.unix_date("day").cast("long"))


@query(f"WITH {RUNS}, {SPLIT} SELECT user_id, day, count(*)::BIGINT AS n_ranges, sum(e - s)::BIGINT AS open_us FROM days GROUP BY user_id, day")
def split_days(spark, d):
    length = F.unix_micros("end") - F.unix_micros("start")
    return day_ranges(spark, d).groupBy("user_id", "day").agg(F.count("*").alias("n_ranges"), F.sum(length).alias("open_us"))


FIRST_DAY = AT // (24 * HOUR) - 3


@query(f"""WITH RECURSIVE {RUNS}, {SPLIT}, spine AS (SELECT user_id, unnest(range({FIRST_DAY}, {FIRST_DAY + 7})) AS day FROM (SELECT DISTINCT user_id FROM events)),
d AS (SELECT user_id, day, count(s) AS n, min(s) AS f_s, min(e) AS f_e, max(e) AS l_e FROM spine LEFT JOIN days USING (user_id, day) GROUP BY ALL),
walk AS (SELECT user_id, day, n, l_e, false AS taken FROM d WHERE day = {FIRST_DAY}
  UNION ALL SELECT d.user_id, d.day, d.n, d.l_e, coalesce(w.n - w.taken::INT > 0 AND d.n > 0 AND w.l_e = d.f_s AND d.f_e - d.f_s < {23 * HOUR}, false) FROM walk w JOIN d ON d.user_id = w.user_id AND d.day = w.day + 1)
SELECT w.user_id, w.day, (w.n - w.taken::INT)::BIGINT AS n_ranges, CASE WHEN w.n - w.taken::INT > 0 THEN CASE WHEN x.taken THEN d.f_e ELSE w.l_e END END AS last_end_us
FROM walk w LEFT JOIN walk x ON x.user_id = w.user_id AND x.day = w.day + 1 LEFT JOIN d ON d.user_id = w.user_id AND d.day = w.day + 1""")
def overnight_join(spark, d):
    """Seven days of ranges; what touches across midnight is shown on the day it starts, unless the next range lasts all day."""
    users = table(spark, d, "events").select("user_id").distinct()
    spine = users.withColumn("day", F.explode(F.sequence(F.lit(FIRST_DAY), F.lit(FIRST_DAY + 6))))
    day = day_ranges(spark, d).groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    full = spine.join(day, ["user_id", "day"], "left").withColumn("ranges", F.coalesce("ranges", F.array().cast("array<struct<start:timestamp,end:timestamp>>")))
    week = full.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "ranges"))), lambda x: x["ranges"]).alias("days"))
    shown = week.select("user_id", F.posexplode(intervals.join_overnight(F.col("days"))).alias("k", "ranges"))
    return shown.select("user_id", (F.col("k") + FIRST_DAY).cast("long").alias("day"), F.size("ranges").cast("long").alias("n_ranges"), F.unix_micros(F.try_element_at("ranges", F.lit(-1))["end"]).alias("last_end_us"))


@query("""SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens', '%Y-%m-%d') AS local_date,
(hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens') * 60 + minute((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens'))::INT AS minutes,
isodow((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens')::INT AS weekday FROM events""")
def zoned_parts(spark, d):
    at = F.col("ts")
    return table(spark, d, "events").select("event_id", zoned_date(at, ZONE).cast("string").alias("local_date"), zoned_minutes(at, ZONE).alias("minutes"), iso_weekday(zoned_date(at, ZONE)).alias("weekday"))


@query("""SELECT o_orderkey, epoch_us((o_orderdate + INTERVAL 12 HOUR) AT TIME ZONE 'Europe/Athens') AS instant_us FROM orders""")
def local_to_instant_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(local_to_instant(F.to_date("o_orderdate"), F.lit("12:00"), ZONE)).alias("instant_us"))


@query("""SELECT event_id, strftime(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens') - INTERVAL 8 HOUR, '%Y-%m-%d') AS duty_date FROM events""")
def duty_day(spark, d):
    return table(spark, d, "events").select("event_id", duty_date(F.col("ts"), ZONE).cast("string").alias("duty_date"))


EASTER = """years AS (SELECT DISTINCT year(o_orderdate)::INT AS y FROM orders),
c AS (SELECT y, (y % 19 * 19 + 15) % 30 AS moon FROM years),
w AS (SELECT y, moon, (y % 4 * 2 + y % 7 * 4 - moon + 34) % 7 AS week FROM c),
easter AS (SELECT y, make_date(y, ((moon + week + 114) // 31)::INT, ((moon + week + 114) % 31 + 1)::INT) + 13 AS easter FROM w)"""
HOLIDAYS = f"""{EASTER}, holidays AS (
SELECT y, unnest([make_date(y,1,1), make_date(y,1,6), make_date(y,3,25), make_date(y,5,1), make_date(y,8,15), make_date(y,10,28), make_date(y,12,25), make_date(y,12,26), easter - 48, easter - 2, easter, easter + 1, easter + 50]) AS date,
unnest(['New Year''s Day','Epiphany','Independence Day','Labour Day','Dormition of the Theotokos','Ohi Day','Christmas Day','Boxing Day','Clean Monday','Good Friday','Easter Sunday','Easter Monday','Whit Monday']) AS name FROM easter)"""


def order_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()


@query(f"""WITH {EASTER.replace("SELECT DISTINCT year(o_orderdate)::INT AS y FROM orders", "SELECT y::INT AS y FROM range(1900, 2100) t(y) UNION SELECT year(o_orderdate)::INT FROM orders")}
SELECT y AS year, CASE WHEN y BETWEEN 1900 AND 2099 THEN strftime(easter, '%Y-%m-%d') END AS easter FROM easter""")
def easter_dates(spark, d):
    """Easter of all years that the rule holds for; orders of other years have none."""
    rule = spark.range(1900, 2100).select(F.col("id").cast("int").alias("year"))
    years = rule.union(order_years(spark, d)).distinct()
    return years.select("year", orthodox_easter(F.col("year")).cast("string").alias("easter"))


@query(f"WITH {HOLIDAYS} SELECT strftime(date, '%Y-%m-%d') AS date, name, name IN ('Good Friday', 'Whit Monday') AS soft FROM holidays")
def holiday_calendar(spark, d):
    return holiday_rows(order_years(spark, d)).select(F.col("date").cast("string").alias("date"), "name", "soft")


@query(f"WITH {HOLIDAYS} SELECT name, count(*)::BIGINT AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN holidays ON o_orderdate::DATE = date GROUP BY name")
def holiday_orders(spark, d):
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice")
    days = holiday_rows(order_years(spark, d))
    return orders.join(F.broadcast(days), "date").groupBy("name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


PERIODS = "(VALUES (1, DATE '1996-01-01', DATE '1997-06-30', 'a'), (2, DATE '1997-01-01', DATE '1999-12-31', 'b'), (3, DATE '1995-01-01', NULL, 'c'))"


def three_periods(spark):
    return spark.sql(f"SELECT * FROM {PERIODS.replace('NULL', 'CAST(NULL AS DATE)')} AS p(seq, valid_from, valid_to, label)")


@query(f"""WITH p AS (SELECT * FROM {PERIODS} t(seq, valid_from, valid_to, label)),
m AS (SELECT o_orderkey, label, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq) AS n FROM orders JOIN p ON valid_from <= o_orderdate::DATE AND (valid_to IS NULL OR o_orderdate::DATE <= valid_to))
SELECT label, count(*)::BIGINT AS n_orders FROM m WHERE n = 1 GROUP BY label""")
def period_first_match(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    found = periods.first_period(orders, three_periods(spark), "date", "valid_from", "valid_to", "seq")
    return found.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n_orders"))


SPANS = "p AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_suppkey % 50 AS g, l_shipdate::DATE AS f, CASE WHEN l_linenumber = 7 AND l_quantity > 40 THEN NULL ELSE l_shipdate::DATE + floor(l_quantity * l_quantity / 10)::INT - 2 END AS t FROM lineitem)"


def line_periods(spark: SparkSession, d: str) -> DataFrame:
    """A validity period for each line: from its ship date on, some none at all, some for most of a year, some open."""
    length = F.floor(F.col("l_quantity") * F.col("l_quantity") / 10).cast("int") - 2
    start = F.to_date("l_shipdate")
    end = F.when(~((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 40)), F.date_add(start, length))
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_suppkey") % 50).alias("g"), start.alias("valid_from"), end.alias("valid_to"))


@query(f"""WITH {SPANS}, o AS (SELECT DISTINCT o_custkey % 60 AS g, o_orderdate::DATE AS d FROM orders), m AS (SELECT o.g, o.d, min(seq) AS seq FROM o JOIN p ON p.g = o.g AND f <= d AND (t IS NULL OR d <= t) GROUP BY ALL)
SELECT o_orderkey, seq FROM orders LEFT JOIN m ON m.g = o_custkey % 60 AND m.d = o_orderdate::DATE""")
def first_line_period(spark, d):
    """Every order with the first of its group's validity periods that holds its date: as many periods as lines."""
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 60).alias("g"), F.to_date("o_orderdate").alias("date"))
    return periods.first_period(orders, line_periods(spark, d), "date", "valid_from", "valid_to", "seq", ["g"]).select("o_orderkey", "seq")


LISTS = "(VALUES (DATE '1996-01-01', DATE '1998-12-31', 'weekly', '1,2,3'), (DATE '1997-06-01', DATE '1999-06-30', 'weekly', '3,6,7'), (DATE '1997-01-01', DATE '1997-12-31', 'dates', '1997-03-25,1997-07-01'))"


@query(f"""WITH p AS (SELECT *, string_split(keys, ',') AS k FROM {LISTS} t(list_from, list_to, type, keys)), days AS (SELECT DISTINCT o_custkey AS c, o_orderdate::DATE AS d FROM orders),
m AS (SELECT c, d, list_from, row_number() OVER (PARTITION BY c, d ORDER BY list_from DESC, list_to DESC) AS n FROM days JOIN p ON d BETWEEN list_from AND list_to
  AND CASE WHEN type = 'dates' THEN list_contains(k, strftime(d, '%Y-%m-%d')) ELSE c % 11 <> 0 AND list_contains(k, isodow(d)::VARCHAR) END)
SELECT strftime(list_from, '%Y-%m-%d') AS list_from, count(*)::BIGINT AS n_days FROM m WHERE n = 1 GROUP BY list_from""")
def extended_priority(spark, d):
    """Newest list in force that names the day; one that doesn't falls through to the older. Holidays end weekly lists only."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.to_date("o_orderdate").alias("date")).distinct()
    days = orders.withColumn("is_holiday", F.col("entity_id") % 11 == 0)
    lists = spark.sql(f"SELECT list_from, list_to, type, explode(split(keys, ',')) AS key FROM {LISTS} AS t(list_from, list_to, type, keys)")
    ranges = F.array(F.struct(F.col("list_from").cast("string").alias("from"), F.lit("00:00").alias("to")))
    extended = orders.select("entity_id").distinct().join(F.broadcast(lists)).select("entity_id", "list_from", "list_to", F.lit(0).alias("position"), "type", "key", ranges.alias("ranges"))  # nine rows of keys
    # a second row of a list, with other hours, is not read
    again = extended.withColumns({"position": F.lit(1), "ranges": F.array(F.struct(F.lit("second").alias("from"), F.lit("00:00").alias("to")))})
    found = schedules.extended_ranges(days, extended.unionByName(again))
    return found.groupBy(F.get("ranges", F.lit(0))["from"].alias("list_from")).agg(F.count("*").alias("n_days"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey AS c, o_orderdate::DATE AS d, isodow(o_orderdate)::INT AS wd FROM orders)
SELECT o_orderkey, CASE WHEN c % 5 = 0 AND d = DATE '1996-01-06' + (c % 40)::INT THEN '' WHEN d = DATE '1995-01-01' + (c % 900)::INT THEN '10:00-12:00' WHEN wd <= 5 AND (c + wd) % 3 <> 0 THEN '08:00-14:30' WHEN wd = 6 AND c % 2 = 0 THEN '09:00-13:00' END AS hours FROM o""")
def schedule_expand(spark, d):
    """The hours of each order's day in its customer's schedule: weekly ranges, and dated ones that replace them."""
    c = F.col("o_custkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"))
    entry = lambda key, hours: F.struct(key.alias("key"), hours.alias("value"))
    week = [F.when((c + k) % 3 != 0, entry(F.lit(str(k)), F.array(F.lit("08:00-14:30")))) for k in range(1, 6)] + [F.when(c % 2 == 0, entry(F.lit("6"), F.array(F.lit("09:00-13:00"))))]
    day = lambda first, n: F.date_add(F.lit(first).cast("date"), (c % n).cast("int")).cast("string")
    closed, short = F.when(c % 5 == 0, entry(day("1996-01-06", 40), F.array().cast("array<string>"))), entry(day("1995-01-01", 900), F.array(F.lit("10:00-12:00")))
    dated = F.when(day("1996-01-06", 40) == day("1995-01-01", 900), F.array(F.coalesce(closed, short))).otherwise(F.array(closed, short))
    maps = orders.withColumns({"weekly": F.map_from_entries(F.array_compact(F.array(*week))), "dated": F.map_from_entries(F.array_compact(dated))})
    return schedules.expand_schedule(maps, F.col("weekly"), F.col("dated")).select("o_orderkey", F.array_join("ranges", ",").alias("hours"))


@query("""WITH r AS (SELECT event_id, printf('%02d:%02d', (event_id * 7) % 24, (event_id * 13) % 60) AS f, CASE WHEN event_id % 5 = 0 THEN '00:00' ELSE printf('%02d:%02d', (event_id * 11) % 24, (event_id * 17) % 60) END AS t FROM events)
SELECT (CASE WHEN t = '00:00' THEN f <> '00:00' ELSE f < t END) AS proper, count(*)::BIGINT AS n FROM r GROUP BY 1""")
def range_validity(spark, d):
    i = F.col("event_id")
    start, end = time_of(i * 7 % 24 * 60 + i * 13 % 60), F.when(i % 5 == 0, "00:00").otherwise(time_of(i * 11 % 24 * 60 + i * 17 % 60))
    return table(spark, d, "events").groupBy(is_proper_range(start, end).alias("proper")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_id % 26 AS h, event_id % 61 AS m FROM events)
SELECT h || ':' || printf('%02d', m) AS raw, CASE WHEN (h < 24 AND m < 60) OR (h = 24 AND m = 0) THEN printf('%02d:%02d', h % 24, m) END AS time, count(*)::BIGINT AS n FROM r GROUP BY 1, 2""")
def time_normalize(spark, d):
    i = F.col("event_id")
    raw = F.concat((i % 26).cast("string"), F.lit(":"), F.lpad((i % 61).cast("string"), 2, "0"))
    return table(spark, d, "events").groupBy(raw.alias("raw")).agg(F.count("*").alias("n")).select("raw", normalize_time(F.col("raw")).alias("time"), "n")


@query("""WITH e AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM e)
SELECT user_id, max(visit)::BIGINT AS visits, epoch_us(max(ts)) AS latest_us FROM s GROUP BY user_id""")
def sessionize_visits(spark, d):
    return visits.visit_counts(table(spark, d, "events"), ["user_id"], "ts").select("user_id", "visits", F.unix_micros("latest").alias("latest_us"))


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM e),
c AS (SELECT user_id, max(visit) AS visits, max(ts) AS latest FROM s GROUP BY user_id)
SELECT user_id, visits::BIGINT AS visits, row_number() OVER (ORDER BY visits DESC, latest DESC, user_id)::INT AS rank FROM c WHERE visits >= 2 AND user_id % 7 <> 0 ORDER BY rank LIMIT 10""")
def topk_frequent(spark, d):
    from pyspark.sql import Window

    counts = visits.visit_counts(table(spark, d, "events"), ["user_id"], "ts")
    favourites = counts.where("user_id % 7 = 0").select("user_id")
    top = visits.frequent(counts, "user_id", favourites, shown=10)
    return top.select("user_id", "visits", F.row_number().over(Window.orderBy(F.desc("visits"), F.desc("latest"), "user_id")).alias("rank"))


@query("""WITH RECURSIVE e AS (SELECT user_id % 20 AS client, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS n FROM events),
walk AS (SELECT client, 0::BIGINT AS n, []::BIGINT[] AS held, 0::BIGINT AS n_allowed FROM (SELECT DISTINCT client FROM e)
  UNION ALL SELECT e.client, e.n, CASE WHEN len(k) < 5 THEN list_append(k, e.us) ELSE k END, w.n_allowed + (len(k) < 5)::INT
  FROM (SELECT w.*, e.us, e.n AS m, list_filter(w.held, lambda x: e.us - x < 600000000) AS k FROM walk w JOIN e ON e.client = w.client AND e.n = w.n + 1) w JOIN e ON e.client = w.client AND e.n = w.m)
SELECT client, max(n)::BIGINT AS n, max(n_allowed)::BIGINT AS n_allowed FROM walk GROUP BY client""")
def rate_limit(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("client"), "ts")
    return visits.rate_limit(e, "client", "ts", "event_id").groupBy("client").agg(F.count("*").alias("n"), F.count_if("allowed").alias("n_allowed"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) SELECT event_type, event_id FROM n WHERE n <= 60""")
def cache_limits(spark, d):
    return visits.newest(table(spark, d, "events"), "event_type", "ts", 60).select("event_type", "event_id")


@query("""WITH d AS (SELECT event_id, epoch_us(ts) / 86400000000.0 - 10957.5 AS d FROM events),
g AS (SELECT *, radians(357.529 + 0.98560028 * d) AS g, 280.459 + 0.98564736 * d AS q, radians(23.439 - 0.00000036 * d) AS o FROM d),
e AS (SELECT *, radians(q + 1.915 * sin(g) + 0.020 * sin(2 * g)) AS l FROM g),
h AS (SELECT *, asin(sin(o) * sin(l)) AS dec, radians(((18.697374558 + 24.06570982441908 * d) % 24) * 15 + 22.94) - atan2(cos(o) * sin(l), cos(l)) AS ha FROM e)
SELECT event_id, round(degrees(asin(sin(radians(40.64)) * sin(dec) + cos(radians(40.64)) * cos(dec) * cos(ha))), 2) AS elevation FROM h""")
def sun_elevation_events(spark, d):
    return table(spark, d, "events").select("event_id", F.round(sun_elevation(F.col("ts"), F.lit(40.64), F.lit(22.94)), 2).alias("elevation"))
