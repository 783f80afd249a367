"""Change capture: upserts, ordered folds, registries, diffs, dictionaries and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orarium.operators.ranges import numbered


def upsert_latest(stored: DataFrame, fetched: DataFrame, keys: list[str], version: str, content: list[str]) -> DataFrame:
    """One row a key: the later version wins, fetched before stored at the same one; unchanged content keeps the stored row."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fetched.withColumn("_new", F.lit(1))).withColumn("_hash", F.sha2(F.to_json(F.struct(*content)), 256))
    key = Window.partitionBy(*keys)
    same = F.max(F.when(F.col("_new") == 0, F.col("_hash"))).over(key)
    both = both.withColumn("_same", (F.col("_new") == 1) & F.coalesce(F.col("_hash") == same, F.lit(False))).where("NOT _same")
    latest = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_new", "_hash", "_same")


def repeats_of_yesterday(lists: DataFrame, group: str, date: str, content: list[str]) -> DataFrame:
    """Lists equal to the same group's list of the day before (a gap of days doesn't count)."""
    order = Window.partitionBy(group).orderBy(date)
    hashed = lists.withColumn("_hash", F.sha2(F.to_json(F.struct(*content)), 256))
    hashed = hashed.withColumns({"_before": F.lag(date).over(order), "_was": F.lag("_hash").over(order)})
    return hashed.where((F.col("_before") == F.date_sub(date, 1)) & (F.col("_was") == F.col("_hash"))).drop("_hash", "_before", "_was")


def fold(rows: DataFrame, key: str, seq: str, last: list[str], keep: list[str]) -> DataFrame:
    """An ordered fold by key: `last` columns from the last row; `keep` columns from the last row that has one (not null, not blank)."""
    present = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    values = [F.max_by(c, seq).alias(c) for c in last] + [F.max_by(F.when(present(c), F.col(c)), F.when(present(c), F.col(seq))).alias(c) for c in keep]
    return rows.groupBy(key).agg(*values)


def changes(rows: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    order = Window.partitionBy(key).orderBy(seq)
    return rows.withColumn("before", F.lag(value).over(order)).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def build_registry(listings: DataFrame, key: str, seq: str, date: str, last: list[str], carry: list[str], first: list[str], sources: str) -> DataFrame:
    """One row an entity: first and last seen, the set of sources, last values, last and first known ones."""
    return listings.groupBy(key).agg(
        F.min(date).alias("first_seen"),
        F.max(date).alias("last_seen"),
        F.array_sort(F.collect_set(sources)).alias("sources"),
        *[F.max_by(c, seq).alias(c) for c in last],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in carry],
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in first],
    )


def union_preferring(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All of the first, and of the second what the first lacks."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def keyed_diff(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, change (add, remove, update) of two snapshots."""
    a = before.select(key, F.struct(*values).alias("_a"))
    b = after.select(key, F.struct(*values).alias("_b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "add").when(F.col("_b").isNull(), "remove").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def diff_summary(before: DataFrame, after: DataFrame, diff: DataFrame) -> DataFrame:
    """One row: counts, and whether to replace the whole (an empty side, or more than half changed)."""
    sizes = before.agg(F.count("*").alias("n_before")).crossJoin(after.agg(F.count("*").alias("n_after")))  # one row each
    counts = diff.agg(*[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("add", "remove", "update")])
    total = F.col("n_add") + F.col("n_remove") + F.col("n_update")
    mode = F.when(total == 0, "none").when((F.col("n_before") == 0) | (F.col("n_after") == 0) | (2 * total > F.greatest("n_before", "n_after")), "replace").otherwise("diff")
    return sizes.crossJoin(counts).withColumn("mode", mode)


def dictionary(rows: DataFrame, value: str, position: str, code: str = "code") -> DataFrame:
    """value, code: codes from 0 by first appearance. The distinct values are numbered over range partitions, not the rows."""
    first = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(position).alias("_first"))
    return numbered(first, [F.col("_first").asc(), F.col(value).asc()], code).withColumn(code, F.col(code).cast("int")).drop("_first")


def encode(rows: DataFrame, value: str, codes: DataFrame, code: str) -> DataFrame:
    return rows.join(codes.withColumnRenamed("code", code), value, "left").drop(value)


def check_version(found: int, known: int) -> None:
    """A dictionary of another version can't be decoded."""
    if found != known:
        raise ValueError(f"version {found} of the dictionary, not {known}")


def decode(rows: DataFrame, code: str, codes: DataFrame, value: str, version: tuple[int, int] = (1, 1)) -> DataFrame:
    """Codes as values again; version: the dictionary's and the one that can be read."""
    check_version(*version)
    return rows.join(codes.withColumnRenamed("code", code), code, "left").drop(code)


def flags(*bits: Column) -> Column:
    """Bit 1 for the first flag, 2 for the second, and so on; null counts as not set."""
    out = F.lit(0)
    for k, bit in enumerate(bits):
        out = out.bitwiseOR(F.when(bit, 1 << k).otherwise(0))
    return out


def rotation(groups: DataFrame, keys: list[str], members: str, date: str) -> DataFrame:
    """Sets of members that come again, with the days since the last time."""
    same = Window.partitionBy(*keys, "members").orderBy(date)
    sets = groups.groupBy(*keys, date).agg(F.array_join(F.array_sort(F.collect_set(members)), ",").alias("members"))
    return sets.withColumn("gap", F.date_diff(F.col(date), F.lag(date).over(same)))


def stale(rows: DataFrame, key: str, checked: str, now: Column, hours: int = 36) -> DataFrame:
    """What was last checked more than `hours` ago, or never: unknown age first, then the oldest."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(checked))) / 3_600_000_000
    late = rows.withColumn("age_hours", F.floor(age)).where(F.col(checked).isNull() | (age > hours))
    return late.orderBy(F.col("age_hours").desc_nulls_first(), key)


def group_equal_days(days: DataFrame, key: str, weekday: str, pattern: str) -> DataFrame:
    """Weekdays with the same hours together: key, pattern, days (joined in order)."""
    return days.groupBy(key, pattern).agg(F.array_join(F.transform(F.array_sort(F.collect_list(weekday)), lambda d: d.cast("string")), ",").alias("days"))


def bundle_version(files: DataFrame, path: str, digest: str) -> DataFrame:
    """One digest of a sorted list of files and their digests."""
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", path, digest))), "\n"), 256).alias("version"))
