"""Data-quality rules: one frame of (severity, code, message); errors block the write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule(rows: DataFrame, severity: str, code: str, broken: Column, message: Column) -> DataFrame:
    return rows.where(broken).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))


def unknown(rows: DataFrame, known: DataFrame, key: str, code: str = "unknown-entity") -> DataFrame:
    """References without a row."""
    missing = rows.select(key).distinct().join(known.select(key), key, "left_anti")
    return rule(missing, "error", code, F.lit(True), F.col(key).cast("string"))


def duplicates(rows: DataFrame, keys: list[str], code: str = "duplicate-extended", severity: str = "warn") -> DataFrame:
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return rule(twice, severity, code, F.lit(True), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys], F.col("n").cast("string")))


def out_of_range(counts: DataFrame, limits: DataFrame, keys: list[str], n: str, code: str = "count") -> DataFrame:
    """keys, n against a table of low and high."""
    both = counts.join(limits, keys)
    return rule(both, "error", code, ~F.col(n).between(F.col("low"), F.col("high")), F.format_string("%s: %d", F.concat_ws(" ", *keys), F.col(n).cast("long")))


def share(rows: DataFrame, broken: Column, most: float, code: str, severity: str = "warn") -> DataFrame:
    """Warns where more than a share of all rows breaks a condition."""
    found = rows.agg(F.avg(F.when(broken, 1.0).otherwise(0.0)).alias("share"))
    return rule(found, severity, code, F.col("share") > most, F.format_string("%.0f %%", F.col("share") * 100))


def missing_groups(expected: DataFrame, present: DataFrame, code: str = "missing-group") -> DataFrame:
    """Expected (date, group_id) without a list."""
    gone = expected.join(present.select("date", "group_id").distinct(), ["date", "group_id"], "left_anti")
    return rule(gone, "warn", code, F.lit(True), F.concat_ws(" ", F.col("date").cast("string"), "group_id"))


def report(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "code").agg(F.count("*").alias("n"))


def passes(found: DataFrame) -> bool:
    """Whether nothing blocks the write."""
    return found.where("severity = 'error'").isEmpty()
