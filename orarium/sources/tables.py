"""Readers: the shared test tables, and documents with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orarium.session import prepared

WINDOW = "STRUCT<`from`: STRING, `to`: STRING, toNextDay: BOOLEAN>"
EXTRA = "STRUCT<weekdays: ARRAY<INT>, `from`: STRING, `to`: STRING, exceptHolidays: BOOLEAN>"
ENTRY = "STRUCT<pharmacyId: STRING, name: STRING, address: STRING, locality: STRING, phone: STRING>"
SECTION = f"STRUCT<kind: STRING, heading: STRING, hours: {WINDOW}, onCall: BOOLEAN, extraHours: ARRAY<{EXTRA}>, notes: ARRAY<STRING>, entries: ARRAY<{ENTRY}>>"
DUTY_DAY = f"schemaVersion INT, date STRING, groups ARRAY<STRUCT<id: STRING, name: STRING, source: STRUCT<url: STRING, uploadedAt: TIMESTAMP>, sections: ARRAY<{SECTION}>>>"
META = "schemaVersion INT, city STRING, updatedAt TIMESTAMP, checkedAt TIMESTAMP, duties STRUCT<`from`: STRING, `to`: STRING>, extendedHours ARRAY<STRUCT<`from`: STRING, `to`: STRING, file: STRING>>"
LOCATION = "STRUCT<lat: DOUBLE, lon: DOUBLE, source: STRING, precision: STRING, ref: STRING>"
REGISTRY = f"schemaVersion INT, pharmacies ARRAY<STRUCT<id: STRING, name: STRING, address: STRING, locality: STRING, postcode: STRING, phone: STRING, groupId: STRING, location: {LOCATION}, sources: ARRAY<STRING>, firstSeen: STRING, lastSeen: STRING>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table; times without a zone are read as UTC instants."""
    df = prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a known schema, one to a file, with area_id and file from the path (<root>/<area>/...).

    A file that isn't valid JSON fails the read."""
    df = prepared(spark).read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.withColumn("file", F.col("_metadata.file_path")).withColumn("area_id", F.regexp_extract("file", r"/([^/]+)/(?:duties/|extended-hours/)?[^/]+$", 1))


def duty_days(spark: SparkSession, root: str) -> DataFrame:
    """All areas' duty days in one read."""
    return documents(spark, f"{root}/*/duties/*.json", DUTY_DAY)


def wanted(df: DataFrame, dates: list[str], published: DataFrame) -> DataFrame:
    """Only the dates asked for, and only those the manifest names."""
    return df.where(F.col("date").isin(dates)).join(published, ["area_id", "date"], "left_semi")


def missing(spine: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    return spine.join(there.select(*keys).distinct(), keys, "left_anti")


def unread(found: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What no earlier run has read with this version."""
    return found.join(cache.select(*keys), keys, "left_anti")


def latest_linked(posts: DataFrame, title: str, pattern: str) -> DataFrame:
    """The newest post whose title fits and that links a document."""
    return posts.where(F.col(title).rlike(pattern) & F.col("link").isNotNull()).agg(F.max_by(F.struct("*"), "date").alias("p")).select("p.*")


def search_windows(first: Column, last: Column, days: int) -> Column:
    """Consecutive spans of at most `days` days."""
    starts = F.sequence(first, last, F.expr(f"INTERVAL {days} DAYS"))
    return F.transform(starts, lambda d: F.struct(d.alias("from"), F.least(F.date_add(d, days - 1), last).alias("to")))


def places_in_box(spark: SparkSession, path: str, west: float, south: float, east: float, north: float, digits: int = 6, lat: str = "lat", lon: str = "lon", where: Column | None = None) -> DataFrame:
    """The places of a box (edges included), coordinates rounded. The four bounds, and an equality that `where` asks for,
    are filters of the scan: row groups and pages outside are not read."""
    inside = F.col(lat).between(south, north) & F.col(lon).between(west, east)
    rows = prepared(spark).read.parquet(path).where(inside if where is None else inside & where)
    return rows.withColumns({c: F.round(c, digits) for c in (lat, lon)})
