"""Duty lists out of landed pages (page_id, html): cards, forms, articles and a map's data, as column expressions.

A page is cut where a pattern begins a part, and each field is the first group of its own pattern inside the part, so a
page that lacks a field gives an empty text and no error. The patterns are the pages' formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orarium.functions.text import clean_display, squash, strip_accents
from orarium.functions.titles import address_and_phone, month_number, numeric_date, unescape_js
from orarium.sources.html import all_of, table_cells, text_of

#: A duty in the data of a map page: two windows in seconds from midnight.
MAP_DUTY = "STRUCT<duty_name: STRING, start_time: INT, end_time: INT, start_time2: INT, end_time2: INT>"
MAP_DATA = f"STRUCT<features: ARRAY<STRUCT<geometry: STRUCT<coordinates: ARRAY<DOUBLE>>, properties: STRUCT<pharmacy_id: BIGINT, city_name: STRING, city_short_name: STRING, pharmacy_name: STRING, pharmacy_address: STRING, duties: MAP<STRING, {MAP_DUTY}>>>>>"


def first(x: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(x, f"(?s){pattern}", group)


def parts(pages: DataFrame, start: str, name: str = "part") -> DataFrame:
    """page_id, position and each part of a page from where `start` fits to the next such place."""
    return pages.select("page_id", F.posexplode(F.slice(F.split("html", start), 2, 1 << 30)).alias("position", name))


def printed_phone(x: Column) -> Column:
    """The digits of a printed phone without the country's code; of several numbers the first."""
    digits = F.regexp_replace(F.regexp_replace(x, r"\D", ""), r"^(?:00)?30(?=[26]\d{9})", "")
    return F.when(digits.rlike(r"^[26]\d{9}"), F.substring(digits, 1, 10)).otherwise(digits)


def spot(lat: Column, lon: Column) -> Column:
    """Coordinates from two texts; null where one is missing, or for 0, 0, which stands for an unplaced entity."""
    y, x = F.nullif(lat, F.lit("")).cast("double"), F.nullif(lon, F.lit("")).cast("double")
    return F.when(y.isNotNull() & x.isNotNull() & ((y != 0) | (x != 0)), F.struct(y.alias("lat"), x.alias("lon")))


def offered(pages: DataFrame, select: str, value: str = r"\d{4}-\d{2}-\d{2}") -> DataFrame:
    """page_id, position, value: what a form's field offers, in order."""
    field = first(F.col("html"), rf'<select[^>]*name="{select}"[^>]*>(.*?)</select>')
    return pages.select("page_id", F.posexplode(all_of(field, f'<option[^>]*value="({value})"')).alias("position", "value")).withColumn("value", text_of(F.col("value")))


def chosen(pages: DataFrame) -> DataFrame:
    """page_id and the date that the page shows; null where none is selected."""
    return pages.select("page_id", F.to_date(F.nullif(first(F.col("html"), r'<option selected="selected" value="(\d{4}-\d{2}-\d{2})"'), F.lit(""))).alias("date"))


def duty_cards(pages: DataFrame) -> DataFrame:
    """Cards of a duty page, in order: heading, name, address, locality, phone, details_id. A part without header or body,
    such as the footer, is no card."""
    found = parts(pages, r'<div class="col-sm-6 col-xl-4\b').withColumns(
        {"head": first(F.col("part"), '<div class="card-header[^"]*"[^>]*>(.*?)<div class="card-body'), "body": first(F.col("part"), '<div class="card-body[^"]*"[^>]*>(.*?)<div class="card-footer')}
    )
    rows = all_of(F.col("body"), r'(?s)<div class="col-10[^"]*">(.*?)</div>')
    row = lambda k: F.coalesce(F.get(rows, F.lit(k)), F.lit(""))
    sector = first(F.col("body"), "<strong>(.*?)</strong>")
    return found.where("head <> '' AND body <> ''").select(
        "page_id",
        "position",
        text_of(F.col("head")).alias("heading"),
        clean_display(text_of(first(F.col("body"), r'class="card-title"[^>]*>(.*?)</(?:div|h\d)>'))).alias("name"),
        clean_display(text_of(row(0))).alias("address"),
        clean_display(text_of(F.when(sector != "", sector).otherwise(row(1)))).alias("locality"),
        printed_phone(text_of(row(2))).alias("phone"),
        F.nullif(first(F.col("part"), r"/Home/Details/(\d+)"), F.lit("")).alias("details_id"),
    )


def details_spot(pages: DataFrame) -> DataFrame:
    """page_id and the coordinates in a details page's script."""
    number = r"\s*=\s*(-?\d+(?:\.\d+)?)"
    return pages.select("page_id", spot(first(F.col("html"), "var _lat" + number), first(F.col("html"), "var _lng" + number)).alias("location"))


def portal_cards(pages: DataFrame) -> DataFrame:
    """Cards of a portal's results: heading (the hours), name, address, locality, phone, location."""
    found = parts(pages, r'<div id="\d+" class="card\b')
    text = first(F.col("part"), r'<div class="[^"]*\bcard-text\b[^"]*"[^>]*>(.*?)</div>')
    spans = all_of(text, "(?s)<span[^>]*>(.*?)</span>")
    span = lambda k: F.coalesce(F.get(spans, F.lit(k)), F.lit(""))
    map_link = r"maps/search/\?api=1&(?:amp;)?query=(-?\d+(?:\.\d+)?)%2C(-?\d+(?:\.\d+)?)"
    return found.select(
        "page_id",
        "position",
        text_of(span(1)).alias("heading"),
        clean_display(text_of(span(0))).alias("name"),
        clean_display(text_of(first(F.col("part"), r'<div class="card-title[^"]*"[^>]*>\s*<h6[^>]*>(.*?)</h6>'))).alias("address"),
        clean_display(text_of(first(F.col("part"), '<div class="card-subtitle[^"]*"[^>]*>(.*?)</div>'))).alias("locality"),
        printed_phone(text_of(first(text, "<h6[^>]*>(.*?)</h6>"))).alias("phone"),
        spot(first(F.col("part"), map_link, 1), first(F.col("part"), map_link, 2)).alias("location"),
    )


def labelled(line: Column, label: str) -> Column:
    """What follows a label in an address line, up to the next icon."""
    return F.regexp_replace(text_of(first(line, rf"{label}(.*?)(?:<i\b|$)")), ",$", "")


ADDRESS, TELEPHONE = "Διεύθυνση:", "Τηλέφωνο:"


def island_days(pages: DataFrame) -> DataFrame:
    """Duties of an answer's own date and of the days that follow: date, place, name, address, phone, location, follows."""
    heading = r"Εφημερεύον Φαρμακείο για\s*<strong>\s*([^<]*?)\s*</strong>\s*στην τοποθεσία:\s*<strong>([^<]*)</strong>"
    heads = pages.select("page_id", "html", numeric_date(text_of(first(F.col("html"), heading, 1))).alias("own_date"), F.nullif(text_of(first(F.col("html"), heading, 2)), F.lit("")).alias("place"))
    block = F.get(F.split(F.col("part"), r'<div class="next-pharmacy">|<h3>\s*Επόμενες', 2), F.lit(0))
    own = parts(pages, '<div class="pharmacy-duty">').withColumn("block", block).withColumn("line", first(F.col("block"), "<h3[^>]*>(.*?)</h3>"))
    number = r"parseFloat\('(-?\d+(?:\.\d+)?)'\)"
    pair = rf"lat:\s*{number},\s*lng:\s*{number}"
    today = own.select("page_id", "position", F.lit(None).cast("date").alias("date"), text_of(first(F.col("block"), "<h2[^>]*>(.*?)</h2>")).alias("name"), "line", spot(first(F.col("block"), pair, 1), first(F.col("block"), pair, 2)).alias("location"), F.lit(False).alias("follows"))
    later = parts(pages, '<div class="next-pharmacy">').withColumn("block", F.substring_index("part", "</div>", 1)).withColumn("title", first(F.col("block"), "<h3[^>]*>(.*?)</h3>"))
    dated = numeric_date(F.regexp_extract(text_of(F.col("title")), r"(\d{1,2}/\d{1,2}/\d{4})", 1))
    strong = first(F.col("title"), "<strong>(.*?)</strong>")
    coming = later.select("page_id", "position", dated.alias("date"), text_of(strong).alias("name"), first(F.col("block"), "<h4[^>]*>(.*?)</h4>").alias("line"), F.lit(None).cast("struct<lat: double, lon: double>").alias("location"), F.lit(True).alias("follows")).where("date IS NOT NULL AND name <> ''")
    every = today.unionByName(coming).join(heads.drop("html"), "page_id")
    return every.select("page_id", "position", F.when(F.col("follows"), F.col("date")).otherwise(F.col("own_date")).alias("date"), "place", clean_display(F.col("name")).alias("name"), clean_display(labelled(F.col("line"), ADDRESS)).alias("address"), printed_phone(labelled(F.col("line"), TELEPHONE)).alias("phone"), "location", "follows")


def article_index(pages: DataFrame) -> DataFrame:
    """page_id, section, month, path of the monthly articles that an index links to, each path once; other links are left out."""
    link = r'<a href="((?:/[a-z]+)/(\d+-[a-z]+)/\d+-efimereuonta-famakeia-[a-z-]+)"[^>]*>\s*([^<]*?)\s*</a>'
    fields = [all_of(F.col("html"), link, k) for k in (1, 2, 3)]
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(*[f.alias(n) for f, n in zip(fields, ("path", "section", "title"), strict=True)])).alias("position", "a"))
    last = F.regexp_extract(strip_accents(F.col("a.title")), r"(\p{L}+)\s*$", 1)
    rows = rows.select("page_id", "position", F.col("a.section").alias("section"), month_number(last).alias("month"), F.col("a.path").alias("path")).where("month IS NOT NULL")
    return rows.groupBy("page_id", "path").agg(F.min_by("section", "position").alias("section"), F.min_by("month", "position").alias("month"))


def article_days(pages: DataFrame) -> DataFrame:
    """page_id, date, name, address, phone, hours (array of printed windows) of an article's table, in either layout: a
    row for each day under a header; or blocks of rows beside a date, whose columns alternate an entity and its hours."""
    cells = table_cells(pages).where("`table` = 0")
    plain = cells.where("`row` = 0 AND `column` = 0").select("page_id", F.col("text").startswith("Ημερομηνία").alias("plain"))
    cells = cells.join(plain, "page_id")
    wide = cells.where("plain AND `row` > 0").groupBy("page_id", "row").agg(*[F.max(F.when(F.col("column") == k, F.col("text"))).alias(n) for k, n in enumerate(("d", "name", "address", "phone"))])
    none = F.array().cast("array<string>")
    flat = wide.select("page_id", numeric_date(F.col("d")).alias("date"), clean_display(F.col("name")).alias("name"), clean_display(F.col("address")).alias("address"), printed_phone(F.col("phone")).alias("phone"), none.alias("hours")).where("date IS NOT NULL")
    # a cell that spans rows stands in each of them: of equal neighbours in a column the first counts
    blocks = cells.where("NOT plain")
    dates = blocks.where("`column` = 0").select("page_id", "row", numeric_date(F.col("text")).alias("date")).where("date IS NOT NULL")
    body = blocks.where("`column` > 0 AND text <> ''").join(dates, ["page_id", "row"])
    down = Window.partitionBy("page_id", "date", "column").orderBy("row")
    body = body.withColumn("above", F.lag("text").over(down)).where(~F.col("text").eqNullSafe(F.col("above"))).drop("above")
    entity = r"^(.*?)\s+(?i:Τηλ\.?)\s*:?\s*([\d .-]+)$"
    body = body.withColumns({"phone": printed_phone(first(F.col("text"), entity, 2)), "who": first(F.col("text"), entity, 1)})
    body = body.withColumn("nth", F.count_if(F.col("phone") != "").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    body = body.withColumn("own", F.max(F.when(F.col("phone") != "", F.col("phone"))).over(Window.partitionBy("page_id", "date", "column", "nth")))
    hours = F.transform(F.array_sort(F.collect_list(F.when((F.col("phone") == "") & F.col("text").rlike(r"\d{1,2}[:.]\d{2}"), F.struct("column", "row", "text")))), lambda x: x["text"])
    grouped = body.where("nth > 0").groupBy("page_id", "date", F.col("own").alias("phone")).agg(F.min_by("who", F.when(F.col("phone") != "", F.struct("column", "row"))).alias("who"), hours.alias("hours"))
    split = grouped.select("page_id", "date", clean_display(F.substring_index("who", ",", 1)).alias("name"), clean_display(F.trim(F.regexp_replace("who", "^[^,]*,?", ""))).alias("address"), "phone", "hours")
    return flat.unionByName(split)


def map_entities(pages: DataFrame) -> DataFrame:
    """page_id, id, name, address, phone, town, town_key, lat, lon, windows (from_sec, to_sec, printed) of the features in
    a map page's script."""
    # up to the first quote that isn't escaped; a lazy dot, as a repeated group would recurse over a long literal
    data = F.from_json(unescape_js(first(F.col("html"), r"var data = '(.*?)(?<!\\)'")), MAP_DATA)
    rows = pages.select("page_id", F.posexplode(data["features"]).alias("position", "f"))
    p = F.col("f.properties")
    pairs = F.flatten(F.transform(F.map_values(p["duties"]), lambda d: F.array(F.struct(d["start_time"].alias("from_sec"), d["end_time"].alias("to_sec"), d["duty_name"].alias("printed")), F.struct(d["start_time2"].alias("from_sec"), d["end_time2"].alias("to_sec"), d["duty_name"].alias("printed")))))
    windows = F.filter(pairs, lambda w: w["from_sec"].isNotNull() & w["to_sec"].isNotNull())
    printed = address_and_phone(p["pharmacy_address"])
    at = F.col("f.geometry.coordinates")
    return rows.select("page_id", "position", p["pharmacy_id"].alias("id"), text_of(p["pharmacy_name"]).alias("name"), printed["address"].alias("address"), printed["phone"].alias("phone"), text_of(p["city_name"]).alias("town"), p["city_short_name"].alias("town_key"), F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lon"), windows.alias("windows"))


def map_extras(pages: DataFrame) -> DataFrame:
    """page_id, nth, hours (lines), entities (name, address): groups of a page's block of longer hours. Lines of hours
    that follow an entity begin the next group."""
    block = F.element_at(F.split("html", 'id="extras"', 2), 2)
    token = r'<span class="glyphicon[^"]*" aria-hidden="true"></span>\s*<strong>([^<]+)</strong>|<span class="pharmacy_name">([^<]*)</span><br /><span class="pharmacy_address"><strong>([^<]*)</strong>'
    zipped = F.arrays_zip(*[all_of(block, token, k).alias(n) for k, n in ((1, "hours"), (2, "name"), (3, "address"))])
    rows = pages.where(F.contains("html", F.lit('id="extras"'))).select("page_id", F.posexplode(zipped).alias("position", "t")).select("page_id", "position", "t.*")
    order = Window.partitionBy("page_id").orderBy("position")
    opens = (F.col("hours") != "") & (F.coalesce(F.lag("hours").over(order), F.lit("")) == "")
    rows = rows.withColumn("opens", opens).withColumn("nth", F.count_if("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("nth > 0")
    listed = lambda keep, value: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("position", value.alias("v"))))), lambda x: x["v"])
    return rows.groupBy("page_id", "nth").agg(listed(F.col("hours") != "", text_of(F.col("hours"))).alias("hours"), listed(F.col("hours") == "", F.struct(text_of(F.col("name")).alias("name"), text_of(F.col("address")).alias("address"))).alias("entities"))


def town_duties(pages: DataFrame) -> DataFrame:
    """page_id, date, heading, position, name, address, phone of a town's page: entities (blue) under the last heading
    (red) before them; what stands before any heading is left out."""
    date = numeric_date(F.regexp_extract(first(F.col("html"), r"(?i)<h3[^>]*>\s*[^<\d]*(\d{1,2}/\d{1,2}/\d{4})\s*</h3>"), r"(.*)", 1))
    # the date is read once a page, before the page is cut: beside the parts it would be read, and the page copied, for each
    dated = pages.select("page_id", "html", date.alias("date"))
    rows = dated.select("page_id", "date", F.posexplode(all_of(F.col("html"), "(?is)<center>(.*?)</center>")).alias("position", "inner"))
    is_heading, is_entity = (F.col("inner").rlike(rf"(?i)color:\s*{c}") for c in ("#800000", "#000080"))
    order = Window.partitionBy("page_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("heading", F.last(F.when(is_heading, text_of(F.col("inner"))), ignorenulls=True).over(order)).where(is_entity & F.col("heading").isNotNull())
    lines = F.split("inner", r"(?i)<br\s*/?>")
    printed = address_and_phone(text_of(F.coalesce(F.get(lines, F.lit(1)), F.lit(""))))
    return rows.select("page_id", "date", "heading", "position", text_of(F.get(lines, F.lit(0))).alias("name"), printed["address"].alias("address"), printed["phone"].alias("phone"))


def town_members(pages: DataFrame) -> DataFrame:
    """page_id, position, name, address, phone of the members' table: rows of two cells."""
    rows = pages.select("page_id", F.posexplode(all_of(F.col("html"), "(?is)<tr>(.*?)</tr>")).alias("position", "row"))
    cells = all_of(F.col("row"), "(?is)<td[^>]*>(.*?)</td>")
    printed = address_and_phone(text_of(F.get(cells, F.lit(1))))
    return rows.where(F.size(cells) == 2).select("page_id", "position", text_of(F.get(cells, F.lit(0))).alias("name"), printed["address"].alias("address"), printed["phone"].alias("phone")).where("name <> ''")


def page_stamp(pages: DataFrame, pattern: str) -> DataFrame:
    """page_id and the page's own date and time, by a pattern with a date (d/m/yyyy) and a clock."""
    return pages.select("page_id", numeric_date(first(F.col("html"), pattern, 1)).alias("date"), squash(first(F.col("html"), pattern, 2)).alias("time"))
