"""Duty lists, regular and extended hours: from nested documents to openings of each entity and date.

Frames (see orarium.sources.tables for the documents' schemas):

    listings   entity_id, date, group_id, kind, heading, position, from, to, next_day, on_call, extra (array of
               weekdays, from, to, except_holidays)
    regular    area_id, seq, valid_from, valid_to, groups (null: all), weekday, ranges
    extended   entity_id, list_from, list_to, position, type (weekly or dates), key (weekday or date), ranges
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orarium.functions.timez import iso_weekday
from orarium.operators.intervals import range_span, window_span
from orarium.operators.periods import first_fitting

RANGES = "array<struct<`from`:string,`to`:string>>"


def flatten_duty_days(days: DataFrame) -> DataFrame:
    """Duty-day documents -> listings; positions keep the order of groups, sections and entries."""
    groups = days.select(F.to_date("date").alias("date"), F.posexplode("groups").alias("g", "group"))
    sections = groups.select("date", "g", F.col("group.id").alias("group_id"), F.posexplode("group.sections").alias("s", "section"))
    entries = sections.select("date", "g", "s", "group_id", "section", F.posexplode("section.entries").alias("e", "entry"))
    return entries.select(
        F.col("entry.pharmacyId").alias("entity_id"),
        "date",
        "group_id",
        F.col("section.kind").alias("kind"),
        F.col("section.heading").alias("heading"),
        F.struct("g", "s", "e").alias("position"),
        F.col("section.hours.from").alias("from"),
        F.col("section.hours.to").alias("to"),
        F.col("section.hours.toNextDay").alias("next_day"),
        F.coalesce("section.onCall", F.lit(False)).alias("on_call"),
        F.transform(F.coalesce("section.extraHours", F.array()), lambda x: F.struct(x["weekdays"].alias("weekdays"), x["from"].alias("from"), x["to"].alias("to"), x["exceptHolidays"].alias("except_holidays"))).alias("extra"),
    )


def in_period(date: Column, start: Column, end: Column) -> Column:
    """Inclusive, with an open end."""
    return (start <= date) & (end.isNull() | (date <= end))


def regular_ranges(days: DataFrame, regular: DataFrame) -> DataFrame:
    """entity_id, date, group_id -> ranges of the first area-wide or fitting period; none without a period.

    A null group matches area-wide periods only."""
    every = F.lit("all")
    periods = regular.groupBy("seq", "valid_from", "valid_to", "groups").agg(F.map_from_entries(F.collect_list(F.struct("weekday", "ranges"))).alias("week"))
    own = lambda g: F.concat(F.lit("group "), g)
    by_group = periods.select("seq", "valid_from", "valid_to", F.explode(F.coalesce(F.transform("groups", own), F.array(every))).alias("whose"))
    # groups and dates are few, whatever the number of entities
    seen = days.select("group_id", "date").distinct().select("group_id", "date", F.explode(F.array_compact(F.array(every, own(F.col("group_id"))))).alias("whose"))
    first = seen.join(first_fitting(seen, by_group, "date", "valid_from", "valid_to", "seq", ["whose"]), ["whose", "date"]).groupBy("group_id", "date").agg(F.min("seq").alias("seq"))
    weeks = first.join(periods.select("seq", "week").dropDuplicates(["seq"]), "seq").select(F.col("group_id").alias("_g"), F.col("date").alias("_d"), "seq", "week")
    found = days.join(weeks, F.col("group_id").eqNullSafe(F.col("_g")) & (F.col("date") == F.col("_d")), "left")
    return found.select("entity_id", "date", F.try_element_at("week", iso_weekday(F.col("date"))).alias("ranges"), F.col("seq").isNotNull().alias("regular_known"))


def extended_ranges(days: DataFrame, extended: DataFrame) -> DataFrame:
    """entity_id, date, is_holiday -> the ranges that replace the regular ones, where a list in force names the day.

    Newest list first; a list that doesn't name the day falls through; an empty array closes. Weekly schedules don't
    apply on holidays, dated ones do. Of an entity's rows in one list only the first is read."""
    first = Window.partitionBy("entity_id", "list_from", "list_to")
    rows = extended.withColumn("_first", F.min("position").over(first)).where(F.col("position") == F.col("_first")).drop("_first")
    named = F.when(F.col("type") == "dates", F.col("key") == F.col("date").cast("string")).otherwise(~F.col("is_holiday") & (F.col("key") == iso_weekday(F.col("date")).cast("string")))
    hits = days.join(rows, "entity_id").where(F.col("date").between(F.col("list_from"), F.col("list_to")) & named)
    newest = Window.partitionBy("entity_id", "date").orderBy(F.desc("list_from"), F.desc("list_to"))
    return hits.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("entity_id", "date", "ranges")


def expand_schedule(days: DataFrame, weekly: Column, dated: Column) -> DataFrame:
    """date with a weekday map and a map of dated overrides -> ranges: a dated key wins, also with an empty array."""
    own = F.try_element_at(dated, F.col("date").cast("string"))
    return days.withColumn("ranges", F.when(F.map_contains_key(dated, F.col("date").cast("string")), own).otherwise(F.try_element_at(weekly, iso_weekday(F.col("date")).cast("string"))))


def openings(days: DataFrame, regular: DataFrame, extended: DataFrame, listings: DataFrame, holidays_of_group: DataFrame, zone: str) -> DataFrame:
    """Everything that starts on a date: entity_id, date, start, end, reason.

    days: entity_id, date, group_id, is_holiday. Extended hours replace regular ones; regular ones don't apply on
    holidays; duties are added on top, but those on call never open. holidays_of_group: date, group_id, is_holiday, for
    the listings' own groups."""
    longer = extended_ranges(days, extended).withColumnRenamed("ranges", "extended")
    usual = regular_ranges(days, regular)
    day = days.join(longer, ["entity_id", "date"], "left").join(usual, ["entity_id", "date"], "left")
    ranges = F.when(F.col("extended").isNotNull(), F.col("extended")).when(~F.col("is_holiday"), F.col("ranges"))
    reason = F.when(F.col("extended").isNotNull(), "extended").otherwise("regular")
    spans = day.select("entity_id", "date", reason.alias("reason"), F.explode(ranges.cast(RANGES)).alias("r"))
    start, end = range_span(F.col("date"), F.col("r.from"), F.col("r.to"), zone)
    own = spans.select("entity_id", "date", start.alias("start"), end.alias("end"), "reason")

    duty = listings.where("NOT on_call").join(days.select("entity_id", "date"), ["entity_id", "date"], "left_semi")
    start, end = window_span(F.col("date"), F.col("from"), F.col("to"), F.col("next_day"), zone)
    name = F.concat_ws("|", F.lit("duty"), "kind", F.col("date").cast("string"), "group_id", "heading")
    listed = duty.where(F.col("from").isNotNull()).select("entity_id", "date", start.alias("start"), end.alias("end"), name.alias("reason"))

    more = duty.join(holidays_of_group, ["date", "group_id"], "left").select("*", F.explode("extra").alias("x"))
    more = more.where(F.array_contains("x.weekdays", iso_weekday(F.col("date"))) & ~(F.coalesce("x.except_holidays", F.lit(False)) & F.coalesce("is_holiday", F.lit(False))))
    start, end = range_span(F.col("date"), F.col("x.from"), F.col("x.to"), zone)
    name = F.concat_ws("|", F.lit("duty-extra"), "kind", F.col("date").cast("string"), "group_id")
    extra = more.select("entity_id", "date", start.alias("start"), end.alias("end"), name.alias("reason"))
    return own.unionByName(listed).unionByName(extra).where("end > start")


def with_mornings(days: DataFrame, mornings: DataFrame) -> DataFrame:
    """entity_id, date, ranges; where none starts before noon the regular morning (weekday, from, to) is put first."""
    early = F.exists("ranges", lambda r: r["from"] < "12:00")
    keyed = days.withColumn("weekday", iso_weekday(F.col("date"))).join(mornings.select("weekday", F.struct("from", "to").alias("morning")), "weekday", "left")
    fuller = F.when(early | F.col("morning").isNull() | (F.size("ranges") == 0), F.col("ranges")).otherwise(F.concat(F.array("morning"), F.col("ranges")))
    return keyed.withColumn("ranges", fuller).drop("weekday", "morning")


def regular_known(asked: DataFrame, regular: DataFrame) -> DataFrame:
    """area_id, date -> area_id, date, regular_known: whether any period of the area's regular hours holds the date. Without
    one only what is on duty is known to be open; the rest is not closed, its hours aren't known.

    regular: area_id, seq, valid_from, valid_to."""
    found = first_fitting(asked, regular, "date", "valid_from", "valid_to", "seq", ["area_id"])
    return asked.select("area_id", "date").distinct().join(found, ["area_id", "date"], "left").select("area_id", "date", F.col("seq").isNotNull().alias("regular_known"))
