"""Everything that a site publishes, as lines of files, from one plan.

    areas     area, from, to (the duty dates its source gives; null where it has none), extended (array of listed files)
    places    area, id, lat, lon and any other columns
    duties    area, date, id and any other columns
    extended  area, file, id and any other columns

A file is rows (path, nth, line) and never one value: a national file may hold all rows of the tables, so its lines are
spread over tasks and put in order where they are written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orarium.sources.sinks import is_published_path, national_window, published_window, write_changed

NATIONAL = "national"


def row_lines(rows: DataFrame, path: Column, order: list[str]) -> DataFrame:
    """path, at, line: a JSON array with a row on each line. Rows that are equal in all columns are one row.

    The opening bracket stands before a file's first row, a comma before each other one: only the first row of each file
    has to be known, and a map-side minimum gives it."""
    columns = [c for c in rows.columns if not c.startswith("_")]
    made = rows.select(path.alias("path"), F.struct(*[F.col(c).cast("string").alias(f"k{i}") if c == "date" else F.col(c).alias(f"k{i}") for i, c in enumerate(order)]).alias("key"), F.to_json(F.struct(*columns)).alias("json")).distinct()
    first = made.groupBy("path").agg(F.min(F.struct("key", "json")).alias("first"), F.max("key").alias("last"))
    lines = made.join(first.drop("last"), "path").withColumn("opens", F.struct("key", "json").eqNullSafe(F.col("first")))
    last = first.select("path", F.lit(2).alias("part"), F.col("last").alias("key"), F.lit("]").alias("line"))
    return lines.select("path", F.lit(1).alias("part"), "key", F.concat(F.when(F.col("opens"), "[").otherwise(","), "json").alias("line")).unionByName(last)


def metas(areas: DataFrame, days: DataFrame) -> DataFrame:
    """Each area's description with the dates of its published files that lie in the source's range, in order."""
    listed = days.join(areas.select("area", "from", "to"), "area").where(F.col("date").between(F.col("from"), F.col("to")))
    listed = listed.groupBy("area").agg(F.array_sort(F.collect_set("date")).alias("dates"))
    duties = F.when(F.col("from").isNotNull(), F.struct("from", "to", F.coalesce("dates", F.array().cast("array<date>")).alias("dates")))
    return areas.join(listed, "area", "left").select(F.concat_ws("/", "area", F.lit("meta.json")).alias("path"), F.to_json(F.struct("area", duties.alias("duties"), F.col("extended").alias("extendedHours"))).alias("line"))


def plan(areas: DataFrame, places: DataFrame, duties: DataFrame, extended: DataFrame, today: Column, past: int = 7) -> DataFrame:
    """path, part, key (text; lines of a file are ordered by part, then key) and line of every published file.

    Of each area: its description, its places, duty days from `past` days before today on, the extended hours that its
    description lists. Of the nation: located places, days from yesterday to 14 days on, and an index of those days with
    the number of areas and rows. A listed file outside the allowed paths is an error, as it would publish what isn't meant
    to be; a listed file without rows, and rows of unknown areas, are left out."""
    known = areas.select("area")
    places, duties, extended = (df.join(known, "area", "left_semi") for df in (places, duties, extended))
    kept = published_window(duties, today, past)
    at = lambda *parts: F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    file_of = lambda c: F.concat(c.cast("string"), F.lit(".json"))
    listed = areas.select("area", F.explode("extended").alias("file")).distinct()
    listed = listed.withColumn("file", F.when(is_published_path(at(F.col("area"), F.col("file"))) & F.col("file").startswith("extended-hours/"), F.col("file")).otherwise(F.raise_error(F.concat(F.lit("not a path to publish: "), F.col("file")))))
    hours = extended.join(listed, ["area", "file"], "left_semi")
    national = national_window(duties, today)
    index = national.groupBy("date").agg(F.count_distinct("area").alias("areas"), F.count("*").alias("rows"))
    files = [
        row_lines(places, at(F.col("area"), "pharmacies.json"), ["id"]),
        row_lines(kept, at(F.col("area"), "duties", file_of(F.col("date"))), ["id"]),
        row_lines(hours, at(F.col("area"), F.col("file")), ["id"]),
        row_lines(places.where("lat IS NOT NULL AND lon IS NOT NULL"), at(NATIONAL, "places.json"), ["area", "id"]),
        row_lines(national, at(NATIONAL, file_of(F.col("date"))), ["area", "id"]),
        row_lines(index, at(NATIONAL, "index.json"), ["date"]),
    ]
    # a key as text that sorts as its parts do: numbers are padded
    sortable = lambda df: F.array_join(F.array(*[_padded(df, f"key.{f.name}") for f in df.schema["key"].dataType.fields]), "\t")
    lines = [df.select("path", "part", sortable(df).alias("key"), "line") for df in files]
    lines.append(metas(areas, kept.select("area", "date").distinct()).select("path", F.lit(1).alias("part"), F.lit("").alias("key"), "line"))
    return reduce(DataFrame.unionByName, lines)


def _padded(df: DataFrame, column: str) -> Column:
    kind = df.select(column).dtypes[0][1]
    value = F.col(column).cast("string")
    return F.coalesce(F.lpad(value, 20, "0") if kind in ("int", "bigint", "smallint", "tinyint") else value, F.lit(""))


def write(lines: DataFrame, folder: str) -> None:
    """Writes lines below folder/area=/kind=/file=, each with its place. Files whose lines are the same as those there are
    not touched, those that are no longer published are removed; no file is gathered to compare it."""
    parts = F.split("path", "/")
    placed = lines.select("part", "key", "line", parts[0].alias("area"), F.when(F.size(parts) > 2, parts[1]).otherwise("root").alias("kind"), F.element_at(parts, -1).alias("file"))
    write_changed(placed, folder, ["area", "kind", "file"])
