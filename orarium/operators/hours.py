"""Free-typed hours cells: lines of weekdays or dates, each followed by a line of hours, read whole or not at all.

A line can be read as weekdays, as dates or as hours; two weekdays with a hyphen are a range or just these two. A cell is
accepted only if every line has one reading, and days and hours follow each other: anything else leaves it out, with the
first problem found. Lines are rows, so a cell of any length, and any number of cells, is spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orarium.functions.grammars import WEEKDAYS
from orarium.functions.text import match_key, squash
from orarium.functions.timez import iso_weekday, strict_date
from orarium.functions.titles import MONTH_STEMS
from orarium.operators.ranges import settled

RANGES = "array<struct<`from`:string,`to`:string>>"
# Weekdays that a cell may name (no Sunday), a note that only repeats what a schedule does, and the forms of
# a date (weekday, day, month in figures, year, month in words) and of a range.
NAMED_DAYS = tuple(w.upper() for w in WEEKDAYS[:6])
NAMED_MONTHS = tuple((s + ("ου" if s in ("μαι", "αυγουστ") else "ιου")).upper() for s in MONTH_STEMS)
IGNORABLE = "^(ΕΚΤΟΣ|ΠΛΗΝ) (ΕΠΙΣΗΜΩΝ )?ΑΡΓΙΩΝ$"
DATE = r"^(?:(\p{L}+)\s+)?(\d{1,2})(?:/(\d{1,2})(?:/(\d{2,4}))?|\s+(\p{L}+))$"
RANGE = r"^(\d{1,2})[:.](\d{2})-(\d{1,2})[:.](\d{2})$"


def weekday_number(word: Column) -> Column:
    return F.nullif(F.array_position(F.lit(list(NAMED_DAYS)), match_key(word)), F.lit(0)).cast("int")


def month_number(word: Column) -> Column:
    return F.nullif(F.array_position(F.lit(list(NAMED_MONTHS)), match_key(word)), F.lit(0)).cast("int")


def as_weekdays(line: Column) -> Column:
    """The weekdays that a line joins by hyphens; null for any other line."""
    days = F.transform(F.split(line, "-"), weekday_number)
    return F.when(F.forall(days, lambda d: d.isNotNull()), days)


def as_dates(line: Column, year: Column) -> Column:
    """The dates that a line joins by &; null unless each part is a date that exists, on the weekday that it names."""

    def date(part: Column) -> Column:
        group = lambda k: F.nullif(F.regexp_extract(F.trim(part), DATE, k), F.lit(""))
        month = F.coalesce(group(3).cast("int"), F.when(group(5).isNotNull(), month_number(group(5))))
        own = group(4).cast("int")
        found = strict_date(F.format_string("%04d-%02d-%02d", F.coalesce(F.when(own < 100, own + 2000).otherwise(own), year), month, group(2).cast("int")))
        return F.when(group(2).isNotNull() & month.isNotNull() & (group(1).isNull() | (weekday_number(group(1)) == iso_weekday(found))), found)

    dates = F.transform(F.split(line, "&"), date)
    return F.when(line.rlike(r"\d") & F.forall(dates, lambda d: d.isNotNull()), dates)


def as_ranges(line: Column) -> Column:
    """The ranges that a line joins by &; null unless each is one of a day's clock, forwards."""

    def read(part: Column) -> Column:
        group = lambda k: F.nullif(F.regexp_extract(part, RANGE, k), F.lit(""))
        clock = lambda h, m: F.when((h.cast("int") < 24) & (m.cast("int") < 60), F.concat(F.lpad(h, 2, "0"), F.lit(":"), m))
        start, end = clock(group(1), group(2)), clock(group(3), group(4))
        return F.when(start < end, F.struct(start.alias("from"), end.alias("to")))

    ranges = F.transform(F.split(F.regexp_replace(line, r"\s+", ""), "&"), read)
    return F.when(F.forall(ranges, lambda r: r.isNotNull()), ranges)


def read_lines(cells: DataFrame) -> DataFrame:
    """cell_id, nth (from 1), weekdays, dates, ranges of the lines that count: hints in brackets are taken out, empty lines and
    notes that say nothing new left out."""
    text = squash(F.regexp_replace("raw", r"\([^)]*\)", " "))
    lines = cells.select("cell_id", F.year("period_from").alias("year"), F.posexplode("lines").alias("at", "raw")).select("cell_id", "year", "at", F.explode(F.array(text)).alias("line"))  # once a line
    lines = lines.where((F.col("line") != "") & ~match_key(F.col("line")).rlike(IGNORABLE))
    read = lines.select("cell_id", "at", as_weekdays(F.col("line")).alias("weekdays"), as_dates(F.col("line"), F.col("year")).alias("dates"), as_ranges(F.col("line")).alias("ranges"))
    return read.withColumn("nth", F.row_number().over(Window.partitionBy("cell_id").orderBy("at"))).drop("at")


def hours_of_cells(cells: DataFrame, holidays: DataFrame, mornings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(schedules, problems): cell_id, type, key, ranges of the cells that are read (type weekly: a row a weekday; dates: a
    row a date of the period, once a cell names any date), and cell_id, problem of the others.

    Weekly hours don't apply on holidays, dated ones do; days without hours before noon get the regular morning. cells:
    cell_id, lines, period_from, period_to; holidays: date; mornings: weekday, ranges."""
    lines = settled(read_lines(cells), "lines")
    spec = F.col("weekdays").isNotNull() | F.col("dates").isNotNull()
    fault = F.when(~spec & F.col("ranges").isNull(), "a line that is neither days nor hours").when(spec != (F.col("nth") % 2 == 1), "days and hours don't follow each other")
    order = Window.partitionBy("cell_id").orderBy("nth")
    pairs = lines.withColumns({"fault": fault, "hours": F.lead("ranges").over(order), "last": F.lead("nth").over(order).isNull()}).where(spec | F.col("fault").isNotNull())
    # reported where hours are missed, after what is said of a line that stands there
    pairs = pairs.withColumn("nth", F.when(F.col("fault").isNull() & F.col("hours").isNull(), F.col("nth") + 1).otherwise(F.col("nth")))
    pairs = pairs.withColumn("fault", F.coalesce("fault", F.when(F.col("hours").isNull(), "days without hours")))
    # days that lists of one, three or more weekdays give
    lists = pairs.where(F.size("weekdays") != 2).select("cell_id", F.explode("weekdays").alias("day")).groupBy("cell_id").agg(F.collect_set("day").alias("taken"))
    pairs = pairs.join(lists, "cell_id", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>")))
    first, second = (F.get("weekdays", F.lit(k)) for k in (0, 1))
    two = F.coalesce(F.size("weekdays") == 2, F.lit(False))
    span = F.when(two & (first < second), F.sequence(first, second))
    crossed = F.coalesce(F.arrays_overlap(span, F.col("taken")), F.lit(False))
    unsettled = two & ~crossed & ((first >= second) | ((second == 6) & (second - first > 1)))
    days = F.when(two & ~crossed, span).otherwise(F.col("weekdays"))
    pairs = pairs.withColumn("fault", F.coalesce("fault", F.when(unsettled, "a range of weekdays with more than one reading"))).withColumn("days", F.when(~unsettled, days))
    pairs = settled(pairs.select("cell_id", "nth", "fault", "days", "dates", "hours"), "days-and-hours")
    period = cells.select("cell_id", "period_from", "period_to")
    weekly = pairs.where("fault IS NULL").select("cell_id", F.explode("days").alias("weekday"), F.col("hours").alias("ranges"))
    dated = pairs.where("fault IS NULL").select("cell_id", F.explode("dates").alias("date"), F.col("hours").alias("ranges")).join(period, "cell_id")
    twice = lambda df, key: df.groupBy("cell_id", key).agg(F.count("*").alias("n")).where("n > 1").select("cell_id", F.lit(f"a {key} given twice").alias("problem"))
    outside = dated.where(~F.col("date").between(F.col("period_from"), F.col("period_to"))).select("cell_id", F.lit("a date outside of the period").alias("problem"))
    empty = cells.join(lines, "cell_id", "left_anti").select("cell_id", F.lit("no hours").alias("problem"))
    faults = pairs.where("fault IS NOT NULL").select("cell_id", F.col("fault").alias("problem"), "nth")
    found = faults.unionByName(twice(weekly, "weekday").unionByName(twice(dated, "date")).unionByName(outside).unionByName(empty).withColumn("nth", F.lit(1 << 30)))
    problems = found.groupBy("cell_id").agg(F.min_by("problem", F.struct("nth", "problem")).alias("problem"))
    weekly, dated = weekly.join(problems, "cell_id", "left_anti"), dated.join(problems, "cell_id", "left_anti").drop("period_from", "period_to")
    with_dates = dated.select("cell_id").distinct()
    plain = weekly.join(with_dates, "cell_id", "left_anti").select("cell_id", F.lit("weekly").alias("type"), F.col("weekday").cast("string").alias("key"), "weekday", F.lit(False).alias("holiday"), "ranges")
    spine = period.join(with_dates, "cell_id").select("cell_id", F.explode(F.sequence("period_from", "period_to")).alias("date")).withColumn("weekday", iso_weekday(F.col("date")))
    spine = spine.join(holidays.select("date").distinct().withColumn("holiday", F.lit(True)), "date", "left").withColumn("holiday", F.coalesce("holiday", F.lit(False)))
    over = spine.join(dated.withColumnRenamed("ranges", "own"), ["cell_id", "date"], "left").join(weekly, ["cell_id", "weekday"], "left")
    every = over.select("cell_id", F.lit("dates").alias("type"), F.col("date").cast("string").alias("key"), "weekday", "holiday", F.coalesce("own", F.when(~F.col("holiday"), F.col("ranges"))).alias("ranges")).where("ranges IS NOT NULL")
    rows = plain.unionByName(every).join(mornings.select("weekday", F.col("ranges").alias("morning")), "weekday", "left")
    early = F.exists("ranges", lambda r: r["from"] < "12:00")
    fuller = F.when(early | F.col("holiday") | F.col("morning").isNull(), F.col("ranges")).otherwise(joined(F.concat(F.col("morning").cast(RANGES), F.col("ranges").cast(RANGES))))
    return rows.select("cell_id", "type", "key", fuller.alias("ranges")), problems


def joined(ranges: Column) -> Column:
    """Ranges of a day in order, those that touch or overlap joined."""

    def step(out: Column, r: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(last["from"].alias("from"), F.greatest(last["to"], r["to"]).alias("to"))
        return F.when(r["from"] <= last["to"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(r)))

    order = F.array_sort(ranges)
    return F.aggregate(F.slice(order, 2, F.greatest(F.size(order) - 1, F.lit(0))), F.slice(order, 1, 1).cast(RANGES), step)
