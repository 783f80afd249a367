"""Dates and validity periods of any number, met by dyadic blocks.

A period of days falls into aligned blocks of 1, 2, 4, ... days, at most two of each size; a date lies in one block of each
size. So what would be a join by range is an equi join on (size, block), with some thirty rows for a period however long it
is, and a date probes only the sizes that occur. Days are those of the years 1 to 11,000 or so; others fit no period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orarium.operators.ranges import settled

#: Sizes up to 2 ** TOP days; the number of 1970-01-01 among the days from year 1 on.
TOP, SHIFT = 22, 719_163


def day_number(date: Column) -> Column:
    return F.unix_date(date) + SHIFT


def with_blocks(periods: DataFrame, start: str, end: str) -> DataFrame:
    """A row (level, block added) for each block of each period, both days included; no end: for ever; none for a period
    without a start."""
    top = (1 << TOP) - 1
    low = F.greatest(day_number(F.col(start)), F.lit(0))
    high = F.least(F.coalesce(day_number(F.col(end)), F.lit(top)), F.lit(top)) + 1
    spans = periods.withColumns({"_low": low, "_high": high}).where(F.col(start).isNotNull() & (F.col("_low") < F.col("_high")))
    # a block is no longer than its period; rounding up costs no block, as the ones that are none go below
    sized = spans.withColumn("level", F.explode(F.sequence(F.lit(0), F.least(F.ceil(F.log2(F.col("_high") - F.col("_low"))).cast("int"), F.lit(TOP)))))
    edges = sized.withColumns({"_a": F.expr("shiftright(_low + shiftleft(1, level) - 1, level)"), "_b": F.expr("shiftright(_high, level)")}).where("_a < _b")
    return edges.withColumn("block", F.explode(F.expr("array(CASE WHEN _a % 2 = 1 THEN _a END, CASE WHEN _b % 2 = 1 THEN _b - 1 END)"))).where("block IS NOT NULL").drop("_low", "_high", "_a", "_b")


def date_blocks(date: Column, levels: list[int]) -> Column:
    """The block of each of these sizes that holds a date."""
    at = day_number(date)
    blocks = F.transform(F.array(*map(F.lit, levels)).cast("array<int>"), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", at, level).alias("block")))
    return F.when((at >= 0) & (at < 1 << TOP), blocks)


def levels_of(marks: DataFrame) -> list[int]:
    return sorted(r.level for r in marks.select("level").distinct().collect())


def first_fitting(asked: DataFrame, periods: DataFrame, date: str, start: str, end: str, seq: str, on: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """on, date, seq: the smallest seq of the periods of equal `on` that hold each date asked for, where one does.

    Of the periods that share a block only the first counts, so as many rows as there are blocks meet the dates, each date
    once: the work is linear in periods and dates, however many periods hold a date."""
    marks = settled(with_blocks(periods.select(*on, seq, start, end), start, end).groupBy(*on, "level", "block").agg(F.min(seq).alias(seq)), "period-blocks")
    probes = asked.select(*on, date).distinct().select(*on, date, F.inline(date_blocks(F.col(date), levels_of(marks))))
    return probes.join(marks, [*on, "level", "block"]).groupBy(*on, date).agg(F.min(seq).alias(seq))


def first_period(days: DataFrame, periods: DataFrame, date: str, start: str, end: str, seq: str, on: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Each row of days with the columns of the first period (by seq, a period's own) of equal `on` that holds its date;
    nulls without one."""
    found = first_fitting(days, periods, date, start, end, seq, on)
    return days.join(found, [*on, date], "left").join(periods.drop(*on).dropDuplicates([seq]), seq, "left")


def held(asked: DataFrame, ranges: DataFrame, date: str, start: str, end: str, on: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """on, date: the dates asked for that lie in a range (both ends given) of equal `on`; each once."""
    given = ranges.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*on, start, end)
    marks = settled(with_blocks(given, start, end).select(*on, "level", "block").distinct(), "range-blocks")
    probes = asked.select(*on, date).distinct().select(*on, date, F.inline(date_blocks(F.col(date), levels_of(marks))))
    return probes.join(marks, [*on, "level", "block"], "left_semi").select(*on, date).distinct()
