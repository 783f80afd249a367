"""Writers: only what changed, published windows, calendar files, GeoJSON, sitemaps, JSON-LD."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orarium.functions.geo import curve


def changed_partitions(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """The keys whose rows differ, either way: what has to be written again."""
    digest = lambda df: df.groupBy(*keys).agg(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("digest"), F.count("*").alias("n"))
    a, b = digest(new), digest(old).withColumnsRenamed({"digest": "_digest", "n": "_n"})
    both = a.join(b, keys, "full_outer")
    return both.where(~(F.col("digest").eqNullSafe(F.col("_digest")) & F.col("n").eqNullSafe(F.col("_n")))).select(*keys)


def write_changed(new: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrites only the partitions that differ from what lies at the path, and deletes those that have no rows any
    more; equal input writes nothing."""
    spark = new.sparkSession
    try:
        old = spark.read.schema(new.schema).parquet(path)
        keys_changed = changed_partitions(new, old, keys)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        new.write.partitionBy(*keys).parquet(path)
        return
    fresh = new.join(keys_changed, keys, "left_semi")
    gone = keys_changed.join(new.select(*keys).distinct(), keys, "left_anti").select(*[F.col(k).cast("string") for k in keys]).collect()  # one row a partition
    if fresh.head(1):
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    for row in gone:
        delete(spark, "/".join([path, *(f"{k}={row[k]}" for k in keys)]))


def write_places(places: DataFrame, path: str, lat: str = "lat", lon: str = "lon", group_bytes: int = 16 << 20) -> None:
    """Writes places in the order of a space-filling curve, range-sorted over files and sorted in each, in row groups of
    `group_bytes`: their smallest and largest coordinates then let a reader of a box skip most of them."""
    rows = places.withColumn("_curve", curve(F.col(lat), F.col(lon)))
    rows.repartitionByRange("_curve").sortWithinPartitions("_curve").drop("_curve").write.mode("overwrite").option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", 2000).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder or a file, wherever Spark can reach it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def published_window(days: DataFrame, today: Column, past: int = 7) -> DataFrame:
    return days.where(F.col("date") >= F.date_sub(today, past))


def national_window(days: DataFrame, today: Column) -> DataFrame:
    return days.where(F.col("date").between(F.date_sub(today, 1), F.date_add(today, 14)))


def manifest(days: DataFrame, area: str = "area_id") -> DataFrame:
    """Each area with its published dates in order."""
    return days.groupBy(area).agg(F.array_sort(F.collect_set("date")).alias("dates"), F.min("date").alias("from"), F.max("date").alias("to"))


def is_published_path(path: Column) -> Column:
    """Whether area/path is a file that may be published; nothing that leaves its folder is."""
    return path.rlike(r"^[a-z0-9-]+/(meta\.json|pharmacies\.json|duties/\d{4}-\d{2}-\d{2}\.json|extended-hours/[A-Za-z0-9_.-]+\.json)$") & ~path.contains("..")


def features(pins: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature a row, as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return pins.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), "id", geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def feature_collections(pins: DataFrame, by: str, properties: list[str]) -> DataFrame:
    """One collection for each area, ordered by id."""
    rows = pins.select(by, "id", F.struct(F.lit("Feature").alias("type"), "id", F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")).alias("f"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("id", "f"))), lambda x: x["f"])
    return rows.groupBy(by).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), listed.alias("features"))).alias("geojson"))


def fold(line: str, octets: int = 75) -> str:
    """A content line cut so that no piece has more than 75 octets; later pieces begin with a space. No character is cut."""
    pieces, at = [bytearray()], octets
    for c in line:
        data = c.encode()
        if len(pieces[-1]) + len(data) > at:
            pieces.append(bytearray(b" "))
        pieces[-1] += data
    return "\r\n".join(p.decode() for p in pieces)


@F.pandas_udf(T.StringType())
def fold_lines(text: pd.Series) -> pd.Series:
    return text.map(lambda t: "\r\n".join(map(fold, t.split("\r\n"))), na_action="ignore")


def escape(x: Column) -> Column:
    out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for c in (";", ","):
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return F.regexp_replace(out, r"\r?\n", r"\\n")


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def calendar(events: DataFrame, by: str, now: Column, product: str = "-//orarium//EN") -> DataFrame:
    """uid, start, end, summary, location -> one iCalendar text for each `by`, events in order of start."""
    lines = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "uid"), F.concat(F.lit("DTSTAMP:"), stamp(now)), F.concat(F.lit("DTSTART:"), stamp(F.col("start"))), F.concat(F.lit("DTEND:"), stamp(F.col("end"))), F.concat(F.lit("SUMMARY:"), escape(F.col("summary"))), F.concat(F.lit("LOCATION:"), escape(F.col("location"))), F.lit("END:VEVENT"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "uid", lines.alias("text")))), lambda x: x["text"]), "\r\n")
    head = f"BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:{product}\r\nCALSCALE:GREGORIAN\r\n"
    return events.groupBy(by).agg(body.alias("body")).select(by, fold_lines(F.concat(F.lit(head), "body", F.lit("\r\nEND:VCALENDAR"))).alias("ics"))


def xml_text(x: Column) -> Column:
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(c), F.lit(e))
    return x


#: Fixed value: urls that the format allows in one file.
SITEMAP_URLS = 50_000


def sitemap(pages: DataFrame, by: str, most: int = SITEMAP_URLS) -> DataFrame:
    """path_url, lastmod -> by, file, xml: a sitemap for each `by` and each `most` of its urls, in order; files from 0."""
    entry = F.concat(F.lit("<url><loc>"), xml_text(F.col("path_url")), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), F.date_format("lastmod", "yyyy-MM-dd"), F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path_url", entry.alias("e")))), lambda x: x["e"]), "\n")
    nth = F.row_number().over(Window.partitionBy(by).orderBy("path_url", "lastmod")) - 1
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    return pages.withColumn("file", F.floor(nth / most).cast("int")).groupBy(by, "file").agg(F.concat(F.lit(head), rows, F.lit("\n</urlset>\n")).alias("xml"))


def sitemap_index(maps: DataFrame) -> DataFrame:
    """loc of each area's sitemap -> the one index of them."""
    entries = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<sitemap><loc>"), xml_text(F.col("loc")), F.lit("</loc></sitemap>")))), "\n")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    return maps.agg(F.concat(F.lit(head), entries, F.lit("\n</sitemapindex>\n")).alias("xml"))


def robots(spark: SparkSession, index: str, hidden: tuple[str, ...] = ()) -> DataFrame:
    """One text that lets readers in, but for hidden paths, and names the index."""
    lines = ["User-agent: *", "Allow: /", *(f"Disallow: {p}" for p in hidden), f"Sitemap: {index}"]
    return spark.range(1).select(F.lit("\n".join(lines) + "\n").alias("text"))


def json_schema(df: DataFrame) -> DataFrame:
    """One JSON Schema of a frame's rows: names, types and which columns may be null."""
    kinds = {"string": "string", "bigint": "integer", "int": "integer", "double": "number", "boolean": "boolean", "date": "string", "timestamp": "string"}

    def described(kind: T.DataType) -> dict:
        if isinstance(kind, T.StructType):
            return {"type": "object", "properties": {f.name: described(f.dataType) for f in kind}, "required": [f.name for f in kind if not f.nullable]}
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": described(kind.elementType)}
        if isinstance(kind, T.MapType):
            return {"type": "object", "additionalProperties": described(kind.valueType)}
        return {"type": kinds.get(kind.simpleString(), "number")}

    text = json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema"} | described(df.schema), ensure_ascii=False)
    return df.sparkSession.range(1).select(F.lit(text).alias("schema"))


def json_ld(rows: DataFrame) -> DataFrame:
    """id, name, phone, street, locality, lat, lon -> a schema.org document each."""
    address = F.struct(F.lit("PostalAddress").alias("@type"), F.col("street").alias("streetAddress"), F.col("locality").alias("addressLocality"), F.lit("GR").alias("addressCountry"))
    place = F.when(F.col("lat").isNotNull(), F.struct(F.lit("GeoCoordinates").alias("@type"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude")))
    return rows.select("id", F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Pharmacy").alias("@type"), "name", F.concat(F.lit("+30"), F.col("phone")).alias("telephone"), address.alias("address"), place.alias("geo"))).alias("document"))


def issue_text(stale: DataFrame, total: int, url: str) -> DataFrame:
    """One text about all stale areas."""
    line = F.format_string("- %s: %s", F.col("area"), F.coalesce(F.concat(F.col("age_hours").cast("string"), F.lit(" h")), F.lit("unknown")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("age_hours", F.lit(1 << 30))).alias("k"), "area", line.alias("line")))), lambda x: x["line"]), "\n")
    return stale.agg(F.count("*").alias("n"), body.alias("lines")).select(F.format_string(f"%d of {total} areas are stale.\n\n%s\n\n{url}", "n", "lines").alias("body"))
