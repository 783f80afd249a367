"""Who is open at an instant, until when and why; what is published; when an answer can change next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orarium.functions.timez import duty_date, local_to_instant, zoned_date
from orarium.operators.intervals import contains, islands, merge, window_span
from orarium.operators.ranges import Run, running

HORIZON = "INTERVAL 7 DAYS"
CLOSING_SOON = "INTERVAL 30 MINUTES"


def status_at(entities: DataFrame, openings: DataFrame, listings: DataFrame, at: Column, zone: str, past: bool = True) -> DataFrame:
    """entity_id -> state (open, duty-hours-unknown, closed), until, closing_soon, next_open, reasons, run_reasons.

    openings: those of the dates from the day before `at` to the last day of the horizon; entities: every id asked for
    (unknown ones are closed). In this order: open; listed on the duty day without hours; on call just now; closed.
    `until` and `next_open` look 7 x 24 hours ahead, and a run that goes on is cut there. past: whether the reasons of a run
    include those of its parts that have ended; without them only openings that touch the horizon are read, so a long history
    costs a filter, and state, until and next_open are the same."""
    if not past:
        openings = openings.where((F.col("end") > at) & (F.col("start") < at + F.expr(HORIZON)))
    numbered = islands(openings, ["entity_id"])
    run = Window.partitionBy("entity_id", "run")
    whole = numbered.withColumns({"run_start": F.min("start").over(run), "run_end": F.max("end").over(run)})
    high = at + F.expr(HORIZON)
    whole = whole.where((F.col("run_end") > at) & (F.col("run_start") < high))
    first = Window.partitionBy("entity_id")
    parts = whole.withColumn("_first", F.min("run").over(first)).where("run = _first")
    sorted_reasons = lambda keep: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("start", "end", "reason")))), lambda x: x["reason"]))
    runs = parts.groupBy("entity_id").agg(
        F.greatest(F.min("run_start"), at).alias("from"),
        F.least(F.max("run_end"), high).alias("until"),
        sorted_reasons(contains(at)).alias("now"),
        sorted_reasons(F.greatest(F.col("start"), at) == F.greatest(F.col("run_start"), at)).alias("opening"),
        sorted_reasons(F.lit(True)).alias("run_reasons"),
    )
    today = zoned_date(at, zone)
    start, end = window_span(F.col("date"), F.col("from"), F.col("to"), F.col("next_day"), zone)
    held = listings.withColumn("unread", F.col("from").isNull() & (F.col("date") == duty_date(at, zone)))
    held = held.withColumn("calling", F.col("on_call") & F.col("from").isNotNull() & F.col("date").isin(today, F.date_sub(today, 1)) & (start <= at) & (at < end))
    held = held.where("unread OR calling").withColumn("_n", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("unread"), F.desc("date"), "position")))
    held = held.where("_n = 1").select("entity_id", F.col("date").alias("duty_date"), F.col("kind").alias("duty_kind"), F.col("on_call").alias("duty_on_call"))
    out = entities.join(runs, "entity_id", "left").join(held, "entity_id", "left")
    is_open = F.coalesce(F.col("from") <= at, F.lit(False))
    state = F.when(is_open, "open").when(F.col("duty_date").isNotNull(), "duty-hours-unknown").otherwise("closed")
    return out.select(
        "entity_id",
        state.alias("state"),
        F.when(is_open, F.col("until")).alias("until"),
        F.when(is_open, F.col("until") <= at + F.expr(CLOSING_SOON)).alias("closing_soon"),
        F.when(~is_open, F.col("from")).alias("next_open"),
        F.when(is_open, F.col("now")).otherwise(F.col("opening")).alias("reasons"),
        "run_reasons",
        F.when(~is_open, F.col("duty_date")).alias("duty_date"),
        F.when(~is_open, F.col("duty_kind")).alias("duty_kind"),
        F.when(~is_open, F.col("duty_on_call")).alias("on_call"),
    )


def ranked(statuses: DataFrame, distance: str | None = None, name: str = "name") -> DataFrame:
    """What isn't closed, nearest first (nulls last), then by name in Greek order."""
    keys = ([F.col(distance).asc_nulls_last()] if distance else []) + [F.expr(f"{name} COLLATE el")]
    return statuses.where("state <> 'closed'").orderBy(*keys)


def published_dates(listed_groups: DataFrame, needed: DataFrame) -> DataFrame:
    """needed: entity_id, group_id, first, last -> entity_id, published: every date of the span has the group's list."""
    spine = needed.select("entity_id", "group_id", F.explode(F.sequence("first", "last")).alias("date"))
    there = listed_groups.select("date", "group_id").distinct().withColumn("there", F.lit(True))
    return spine.join(there, ["date", "group_id"], "left").groupBy("entity_id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("published"))


def coverage(listed_groups: DataFrame, known_groups: DataFrame, day: Column) -> DataFrame:
    """One row: duties (a list for the duty day), first and last published date, published and missing groups."""
    lists = listed_groups.agg(
        F.coalesce(F.max(F.col("date") == day), F.lit(False)).alias("duties"),
        F.min("date").alias("duties_from"),
        F.max("date").alias("duties_to"),
        F.array_sort(F.collect_set(F.when(F.col("date") == day, F.col("group_id")))).alias("published"),
        F.collect_set("group_id").alias("seen"),
    )
    known = known_groups.agg(F.collect_set("group_id").alias("known"))
    both = lists.join(F.broadcast(known))  # one row each
    return both.select("duties", "duties_from", "duties_to", "published", F.array_sort(F.array_except(F.array_union("seen", "known"), "published")).alias("missing"))


def next_change(openings: DataFrame, on_call: DataFrame, at: Column, zone: str) -> DataFrame:
    """One row: the next instant at which any answer can change: midnight, the duty day's start, the edges of openings,
    half an hour before they end, their coming within the horizon, and the edges of on-call windows (start, end)."""
    micro = F.expr("INTERVAL 1 MILLISECOND")
    today = zoned_date(at, zone)
    clock = [local_to_instant(F.date_add(today, k), F.lit(t), zone) for k in (0, 1) for t in ("00:00", "08:00")]
    edges = F.array("start", "end", F.col("end") - F.expr(CLOSING_SOON), F.col("start") - F.expr(HORIZON) + micro)
    moments = openings.where("end > start").select(F.explode(edges).alias("t")).unionByName(on_call.select(F.explode(F.array("start", "end")).alias("t")))
    own = F.array_min(F.filter(F.array(*clock), lambda t: t > at))
    return moments.where(F.col("t") > at).agg(F.least(F.min("t"), F.first(own)).alias("t")).select(F.coalesce("t", own).alias("next_change"))


def state_changes(openings: DataFrame) -> DataFrame:
    """at, opened, closed, n_open: every instant at which an entity opens or closes, and how many are open from then on.

    A sweep over the edges of the merged runs: +1 where one starts, -1 where it ends, summed by instant, then a running sum
    over range partitions."""
    edge = lambda at, opened: F.struct(F.col(at).alias("at"), F.lit(opened).alias("opened"), F.lit(1 - opened).alias("closed"))
    edges = merge(openings, ["entity_id"]).select(F.inline(F.array(edge("start", 1), edge("end", 0))))
    moments = edges.groupBy("at").agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))
    return running(moments, [F.col("at").asc()], n_open=F.col("opened") - F.col("closed"))


def next_changes(asked: DataFrame, openings: DataFrame, on_call: DataFrame, zone: str, at: str = "at") -> DataFrame:
    """Each row of asked with next_change, as `next_change` finds it for one instant.

    Instants and edges are put in one order from the last to the first; the latest edge passed is the next one to come. So
    no instant meets all edges, and no task holds them."""
    step = F.expr("INTERVAL 1 MILLISECOND")
    edges = F.array("start", "end", F.col("end") - F.expr(CLOSING_SOON), F.col("start") - F.expr(HORIZON) + step)
    moments = openings.where("end > start").select(F.explode(edges).alias("_t")).unionByName(on_call.select(F.explode(F.array("start", "end")).alias("_t"))).distinct()
    # an edge at the very instant is no change to come: it stands after the instant
    rows = asked.select(F.col(at).alias("_t"), F.lit(0).alias("_edge"), F.struct(*asked.columns).alias("_row")).unionByName(moments.select("_t", F.lit(1).alias("_edge")), allowMissingColumns=True)
    order = [F.col("_t").desc(), F.col("_edge").asc()]
    passed = running(rows, order, _next=Run(F.when(F.col("_edge") == 1, F.col("_t")), "min", before=True)).where("_edge = 0")
    today = zoned_date(F.col("_t"), zone)
    clock = F.array(*[local_to_instant(F.date_add(today, k), F.lit(t), zone) for k in (0, 1) for t in ("00:00", "08:00")])
    own = F.array_min(F.filter(clock, lambda t: t > F.col("_t")))
    return passed.select("_row.*", F.least("_next", own).alias("next_change"))


def status_grid(entities: DataFrame, openings: DataFrame, low: Column, high: Column, step: str) -> DataFrame:
    """entity_id, at, is_open, until, closing_soon of every entity at every `step` from low to before high.

    Runs are spread over the instants they hold, which makes one equi join with the spine of entities and instants; only
    openings that touch the range, or the horizon after it, are merged, so a long history costs a filter."""
    spine = entities.select("entity_id", F.explode(F.sequence(low, high - F.expr("INTERVAL 1 MICROSECOND"), F.expr(step))).alias("at"))
    runs = merge(openings.where((F.col("end") > low) & (F.col("start") < high + F.expr(HORIZON))), ["entity_id"])
    length = F.unix_micros(low + F.expr(step)) - F.unix_micros(low)
    first = F.greatest(F.ceil((F.unix_micros("start") - F.unix_micros(low)) / length), F.lit(0))
    last = F.floor((F.unix_micros(F.least("end", high)) - F.unix_micros(low) - 1) / length)
    held = runs.withColumns({"_f": first, "_l": last}).where("_f <= _l").select("entity_id", F.col("end").alias("until"), F.explode(F.sequence("_f", "_l")).alias("_k"))
    held = held.select("entity_id", F.timestamp_micros(F.unix_micros(low) + F.col("_k") * length).alias("at"), "until")
    out = spine.join(held, ["entity_id", "at"], "left")
    soon = F.coalesce(F.col("until") <= F.col("at") + F.expr(CLOSING_SOON), F.lit(False))
    return out.select("entity_id", "at", F.col("until").isNotNull().alias("is_open"), "until", soon.alias("closing_soon"))
