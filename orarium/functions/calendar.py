"""Public holidays of Greece as generated rows, and the test whether a date is one for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orarium.functions.timez import iso_weekday

# Month and day, or days from Orthodox Easter; English names; soft ones hold only
# where a published list says so.
FIXED_HOLIDAYS = ((1, 1, "New Year's Day"), (1, 6, "Epiphany"), (3, 25, "Independence Day"), (5, 1, "Labour Day"), (8, 15, "Dormition of the Theotokos"), (10, 28, "Ohi Day"), (12, 25, "Christmas Day"), (12, 26, "Boxing Day"))
EASTER_HOLIDAYS = ((-48, "Clean Monday", False), (-2, "Good Friday", True), (0, "Easter Sunday", False), (1, "Easter Monday", False), (50, "Whit Monday", True))
LOCAL_HOLIDAYS = (("thessaloniki", "metro", 10, 26, "Feast of Saint Demetrius"), ("attiki", "attiki", 9, 14, "Exaltation of the Holy Cross"))
HOLIDAY_HEADING = r"αργι(εσ|α)(?!\p{L})"


def orthodox_easter(year: Column) -> Column:
    """The Gregorian date of Orthodox Easter, 1900 to 2099 (null beyond): the Julian date from the year's place in the
    lunar, leap and week cycles, moved by the calendars' 13 days."""
    moon = (year % 19 * 19 + 15) % 30
    week = (year % 4 * 2 + year % 7 * 4 - moon + 34) % 7
    days = moon + week + 114
    julian = F.make_date(year, F.floor(days / 31).cast("int"), (days % 31 + 1).cast("int"))
    return F.when(year.between(1900, 2099), F.date_add(julian, 13))


def holiday_rows(years: DataFrame, area: str | None = None) -> DataFrame:
    """year -> date, name, group_id (null: national), soft."""
    easter = orthodox_easter(F.col("year"))
    entry = lambda date, name, group, soft: F.struct(date.alias("date"), F.lit(name).alias("name"), F.lit(group).cast("string").alias("group_id"), F.lit(soft).alias("soft"))
    fixed = lambda m, d: F.make_date(F.col("year"), F.lit(m), F.lit(d))
    rows = [entry(fixed(m, d), n, None, False) for m, d, n in FIXED_HOLIDAYS]
    rows += [entry(F.date_add(easter, k), n, None, soft) for k, n, soft in EASTER_HOLIDAYS]
    rows += [entry(fixed(m, d), n, g, False) for a, g, m, d, n in LOCAL_HOLIDAYS if a == area]
    return years.where(F.col("year").between(1900, 2099)).select(F.explode(F.array(*rows)).alias("h")).select("h.*")


def years_between(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def listed_holidays(sections: DataFrame) -> DataFrame:
    """date, group_id, heading of published sections -> date, group_id, listed (its headings announce a holiday).

    The heading stands on every weekend's list, so it counts from Monday to Friday only."""
    from orarium.functions.text import strip_accents

    says = strip_accents(F.col("heading")).rlike(HOLIDAY_HEADING) & (iso_weekday(F.col("date")) <= 5)
    return sections.groupBy("date", "group_id").agg(F.coalesce(F.max(says), F.lit(False)).alias("listed"))


def with_holiday(days: DataFrame, holidays: DataFrame, listed: DataFrame, default_group: str) -> DataFrame:
    """Adds is_holiday to rows with date and group_id (null: the default group).

    A published list decides soft holidays, and may announce one that the calendar lacks."""
    keyed = days.withColumn("_group", F.coalesce("group_id", F.lit(default_group)))
    keys = keyed.select("date", "_group").distinct()
    known = keys.join(holidays.withColumnRenamed("group_id", "_of"), "date").where(F.col("_of").isNull() | (F.col("_of") == F.col("_group")))
    known = known.groupBy("date", "_group").agg(F.min("soft").alias("_soft"))
    lists = listed.select("date", F.col("group_id").alias("_group"), F.col("listed").alias("_listed"))
    found = keys.join(known, ["date", "_group"], "left").join(lists, ["date", "_group"], "left")
    by_list = F.coalesce("_listed", F.lit(False))
    decided = F.when(F.col("_soft") & F.col("_listed").isNotNull(), by_list).otherwise(F.col("_soft").isNotNull() | by_list)
    found = found.select("date", "_group", decided.alias("is_holiday"))
    return keyed.join(found, ["date", "_group"], "left").drop("_group")
