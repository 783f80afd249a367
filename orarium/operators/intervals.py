"""Interval algebra over rows of (keys, start, end): half-open, merged where they overlap or touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orarium.functions.timez import is_proper_range, local_to_instant
from orarium.operators.ranges import Run, in_order, running, settled

#: Intervals of one key from which on they are spread over tasks.
HOT = 1_000_000


def range_span(date: Column, start: Column, end: Column, zone: Column | str) -> tuple[Column, Column]:
    """Instants of a local range that rolls over only at 00:00; nulls for an empty or reversed one."""
    fine = is_proper_range(start, end)
    last = F.when(end == "00:00", F.date_add(date, 1)).otherwise(date)
    return F.when(fine, local_to_instant(date, start, zone)), F.when(fine, local_to_instant(last, end, zone))


def window_span(date: Column, start: Column, end: Column, next_day: Column, zone: Column | str) -> tuple[Column, Column]:
    """Instants of a window that says itself whether it ends the next day."""
    return local_to_instant(date, start, zone), local_to_instant(F.when(next_day, F.date_add(date, 1)).otherwise(date), end, zone)


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", name: str = "run", hot: int | None = None) -> DataFrame:
    """Numbers the runs of overlapping or touching intervals of each key; empty intervals go.

    A run starts where no earlier interval reaches: a running maximum of the ends, in the order of the starts. Keys of up to
    `hot` intervals take one sort by key. The intervals of others are range-sorted, so that a key is spread over tasks, and
    the maximum and the number of runs are carried from partition to partition. Both give the same runs."""
    hot = HOT if hot is None else hot
    rows = df.where(F.col(end) > F.col(start))
    crowded = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).drop("_n")
    if crowded.isEmpty():
        return sorted_islands(rows, keys, start, end, name)
    crowded = settled(crowded, "hot-keys")
    having = lambda how: rows.alias("a").join(crowded.alias("b"), F.expr(" AND ".join(f"a.`{k}` <=> b.`{k}`" for k in keys)), how)
    return sorted_islands(having("left_anti"), keys, start, end, name).unionByName(spread_islands(having("left_semi"), keys, start, end, name))


def fresh_run(reached: Column, start: str) -> Column:
    return F.when(reached.isNull() | (F.col(start) > reached), 1).otherwise(0)


def sorted_islands(rows: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_fresh", fresh_run(reached, start)).withColumn(name, F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def spread_islands(rows: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    order = [F.col(start).asc(), F.col(end).asc()]
    reached = running(in_order(rows, order, keys), order, keys, _reached=Run(F.col(end), "max", before=True))
    numbered = running(reached.withColumn("_fresh", fresh_run(F.col("_reached"), start)), order, keys, **{name: F.col("_fresh")})
    return numbered.select(*rows.columns, name)


def merge(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", hot: int | None = None, **aggregates: Column) -> DataFrame:
    """keys, start, end, n_parts of the merged runs, with further aggregates of their parts."""
    return (
        islands(df, keys, start, end, hot=hot)
        .groupBy(*keys, "run")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_parts"), *[c.alias(n) for n, c in aggregates.items()])
        .drop("run")
    )


def clip(df: DataFrame, low: Column, high: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Runs inside [low, high): merged before they are clipped, so that their parts may lie outside."""
    return df.withColumn(start, F.greatest(F.col(start), low)).withColumn(end, F.least(F.col(end), high)).where(F.col(end) > F.col(start))


def contains(at: Column, start: str = "start", end: str = "end") -> Column:
    return (F.col(start) <= at) & (at < F.col(end))


def reasons_in_order(key: str, position: str) -> Column:
    """Distinct keys of a run's parts, by first appearance: the parts sorted once, then distinct."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(key).alias("k")))), lambda x: x.k))


def by_day(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row for each day that an interval touches, as an equi key: what turns an interval join into a hash join."""
    last = F.to_date(F.col(end) - F.expr("INTERVAL 1 MICROSECOND"))
    return df.withColumn("day", F.explode(F.sequence(F.to_date(F.col(start)), last)))


def covering(intervals: DataFrame, instants: DataFrame, at: str, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Instants joined with the intervals that hold them, by key and day."""
    spread = by_day(intervals, start, end)
    return instants.withColumn("day", F.to_date(at)).join(spread, [*keys, "day"]).where(contains(F.col(at), start, end)).drop("day")


def overlapping_neighbours(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Intervals that start before an earlier one of their key has ended."""
    order = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("reached", F.max(end).over(order)).where(F.col(start) < F.col("reached"))


def split_days(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Runs cut at midnight, one row a day."""
    spread = by_day(df, start, end)
    low, high = F.col("day").cast("timestamp"), F.date_add("day", 1).cast("timestamp")
    return spread.withColumns({start: F.greatest(F.col(start), low), end: F.least(F.col(end), high)})


def join_overnight(days: Column, all_day_minutes: int = 1380) -> Column:
    """An array of days, each an array of (start, end), in order -> the same, where a last range that touches the next
    day's first is shown whole on the day it starts, unless that next range lasts all day.

    Each step may take the next day's first range, so days are folded in order."""
    kind = "array<array<struct<start:timestamp,end:timestamp>>>"

    def step(out: Column, day: Column) -> Column:
        before = F.element_at(out, -1)
        last, first = F.element_at(before, -1), F.get(day, F.lit(0))
        long = (F.unix_micros(first["end"]) - F.unix_micros(first["start"])) >= all_day_minutes * 60_000_000
        joins = (F.size(out) > 0) & (F.size(before) > 0) & (F.size(day) > 0) & (last["end"] == first["start"]) & ~long
        longer = F.concat(F.slice(before, 1, F.size(before) - 1), F.array(F.struct(last["start"].alias("start"), first["end"].alias("end"))))
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer), F.array(F.slice(day, 2, F.greatest(F.size(day) - 1, F.lit(0)))))
        return F.when(F.coalesce(joins, F.lit(False)), joined).otherwise(F.concat(out, F.array(day)))

    return F.aggregate(F.slice(days, 2, F.greatest(F.size(days) - 1, F.lit(0))), F.slice(days, 1, 1).cast(kind), step)


def merge_windows(windows: Column) -> Column:
    """An array of windows (from_sec, to_sec, printed) of a day, in seconds from midnight, in any order -> those that touch
    or overlap joined, in order, with all that was printed of each (printed: an array)."""
    kind = "array<struct<from_sec:bigint,to_sec:bigint,printed:array<string>>>"
    single = F.transform(F.array_sort(windows), lambda w: F.struct(w["from_sec"].cast("bigint").alias("from_sec"), w["to_sec"].cast("bigint").alias("to_sec"), F.array(w["printed"]).alias("printed")))

    def step(out: Column, w: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(last["from_sec"].alias("from_sec"), F.greatest(last["to_sec"], w["to_sec"]).alias("to_sec"), F.concat(last["printed"], w["printed"]).alias("printed"))
        return F.when(w["from_sec"] <= last["to_sec"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(w)))

    return F.aggregate(F.slice(single, 2, F.greatest(F.size(single) - 1, F.lit(0))), F.slice(single, 1, 1).cast(kind), step)
