"""Queries of page and layout readers: rows are written as pages and printed tables, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orarium.functions.display import MONTHS, fill, named
from orarium.functions.timez import clock_of_seconds
from orarium.plans.registry import register
from orarium.sources import html, layout, pages, publication, sheets, sinks, yearly
from orarium.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = register(QUERIES, ORACLE_SQL)


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def page_of(rows: DataFrame, by: str, part: Column, order: str, head: Column | str = "", tail: str = "") -> DataFrame:
    """page_id, html: the parts of each `by`, in order, between a head and a tail."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda x: x["p"]), "\n")
    start = F.lit(head) if isinstance(head, str) else head
    return rows.groupBy(F.col(by).alias("page_id")).agg(parts.alias("parts")).select("page_id", F.concat(start, "parts", F.lit(tail)).alias("html"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    """page, key, name, address, phone: a page of entities for each nation."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("page"), k.alias("key"), F.concat(F.lit("ΦΑΡΜΑΚΕΙΟ "), text("s_suppkey")).alias("name"), F.concat(F.lit("Οδός & "), text("s_suppkey")).alias("address"), F.concat(F.lit("2310"), F.lpad(text("s_suppkey"), 6, "0")).alias("phone"))


S = "s AS (SELECT s_nationkey AS page_id, s_suppkey AS key, 'ΦΑΡΜΑΚΕΙΟ ' || s_suppkey AS name, 'Οδός & ' || s_suppkey AS address, '2310' || lpad(s_suppkey::VARCHAR, 6, '0') AS phone, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS nth FROM supplier)"


@query(f"WITH {S} SELECT page_id, nth::INT AS position, 'ΔΙΑΝ. 21:00 - 08:00' AS heading, name, address, 'Τομέας ' || page_id AS locality, phone, CASE WHEN key % 2 = 0 THEN key::VARCHAR END AS details_id FROM s")
def duty_cards(spark, d):
    card = '<div class="col-sm-6 col-xl-4 mb"><div class="card-header x"> ΔΙΑΝ. <b>21:00</b> - 08:00</div><div class="card-body"><h5 class="card-title">{name}</h5><div class="col-10 a">Οδός &amp; {key}</div><div class="col-10"><strong>Τομέας {page}</strong></div><div class="col-10">+30 {phone} κιν</div></div><div class="card-footer">{link}</div></div>'
    link = F.when(F.col("key") % 2 == 0, F.concat(F.lit('<a href="/Home/Details/'), text("key"), F.lit('">'))).otherwise("")
    rows = suppliers(spark, d)
    made = page_of(rows, "page", fill(card, name=F.col("name"), key=F.col("key"), page=F.col("page"), phone=F.col("phone"), link=link), "key", "<html>", '<div class="col-sm-6 col-xl-4">footer</div>')
    return pages.duty_cards(made)


@query(f"WITH {S} SELECT page_id, nth::INT AS position, '08:00 - 21:00' AS heading, name, address, 'Τόπος' AS locality, phone, CASE WHEN key % 3 <> 0 THEN key / 8.0 END AS lat FROM s")
def portal_cards(spark, d):
    card = '<div id="{key}" class="card m-1"><div class="card-title"><h6>Οδός &amp; {key}</h6></div><div class="card-subtitle">Τόπος</div><div class="x card-text"><span>{name}</span><span> 08:00 - 21:00</span><h6>{phone}</h6></div><a href="https://x/maps/search/?api=1&amp;query={lat}%2C{lat}">'
    lat = F.when(F.col("key") % 3 != 0, text(F.col("key") / 8)).otherwise("0")
    rows = suppliers(spark, d)
    found = pages.portal_cards(page_of(rows, "page", fill(card, key=F.col("key"), name=F.col("name"), phone=F.col("phone"), lat=lat), "key"))
    return found.select("page_id", "position", "heading", "name", "address", "locality", "phone", "location.lat")


@query("""WITH s AS (SELECT DISTINCT s_nationkey AS page_id FROM supplier) SELECT page_id, 0 AS position, '2026-11-0' || page_id % 7 + 1 AS value, '2026-11-0' || page_id % 7 + 2 AS shown, CASE WHEN page_id % 2 = 0 THEN page_id / 4.0 END AS lat FROM s WHERE page_id % 2 < 2
UNION ALL SELECT page_id, 1, '2026-11-0' || page_id % 7 + 2, '2026-11-0' || page_id % 7 + 2, CASE WHEN page_id % 2 = 0 THEN page_id / 4.0 END FROM s""".replace("page_id % 7 + 1", "(page_id % 7 + 1)").replace("page_id % 7 + 2", "(page_id % 7 + 2)").replace("CASE WHEN page_id % 2 = 0 THEN page_id / 4.0 END", "CASE WHEN page_id % 2 = 0 AND page_id > 0 THEN page_id / 4.0 END"))
def form_dates(spark, d):
    """The dates a form offers, the one shown, and the place in a details page's script."""
    p = F.col("page_id")
    form = '<select id="d" name="date"><option value="2026-11-0{a}">x</option><option selected="selected" value="2026-11-0{b}">y</option></select><script>var _lat = {lat}; var _lng = {lat};</script>'
    lat = F.when(p % 2 == 0, text(p / 4)).otherwise("0")
    made = table(spark, d, "supplier").select(F.col("s_nationkey").alias("page_id")).distinct().select("page_id", fill(form, a=p % 7 + 1, b=p % 7 + 2, lat=lat).alias("html"))
    shown = pages.chosen(made).select("page_id", text("date").alias("shown"))
    return pages.offered(made, "date").join(shown, "page_id").join(pages.details_spot(made), "page_id").select("page_id", "position", "value", "shown", F.col("location.lat").alias("lat"))


@query(f"WITH {S} SELECT page_id, CASE WHEN key % 2 = 0 THEN '2026-11-02' ELSE '2026-11-0' || (3 + key % 5) END AS date, 'Νησί & ' || page_id AS place, name, address, phone, key % 2 = 1 AS follows FROM s")
def island_days(spark, d):
    own = '<div class="pharmacy-duty"><h2>{name}</h2><h3><i></i>Διεύθυνση: Οδός &amp; {key},<i class="p"></i>Τηλέφωνο: {phone}</h3></div>'
    later = '<div class="next-pharmacy"><h3>{day}/11/2026 <strong>{name}</strong></h3><h4>Διεύθυνση: Οδός &amp; {key}<i></i> Τηλέφωνο: {phone}</h4></div>'
    rows = suppliers(spark, d)
    part = F.when(F.col("key") % 2 == 0, fill(own, name=F.col("name"), key=F.col("key"), phone=F.col("phone"))).otherwise(fill(later, name=F.col("name"), key=F.col("key"), phone=F.col("phone"), day=F.col("key") % 5 + 3))
    head = F.concat(F.lit("<p>Εφημερεύον Φαρμακείο για <strong> 02/11/2026 </strong> στην τοποθεσία: <strong>Νησί &amp; "), text("page_id"), F.lit("</strong></p>"))
    ordered = rows.withColumn("o", (F.col("key") % 2) * 1_000_000 + F.col("key"))
    found = pages.island_days(page_of(ordered, "page", part, "o", head))
    return found.select("page_id", text("date").alias("date"), "place", "name", "address", "phone", "follows")


@query(f"WITH {S} SELECT page_id, '2026-11-' || lpad((1 + nth % 28)::VARCHAR, 2, '0') AS date, name, address, phone, CASE WHEN page_id % 2 = 1 THEN '08:00 - 14:30|17:30 - 21:00' ELSE '' END AS hours FROM s WHERE nth < 28")
def article_days(spark, d):
    """Monthly tables, plain ones in even pages, and blocks of rows beside each date in odd ones."""
    rows = suppliers(spark, d).withColumn("nth", F.row_number().over(Window.partitionBy("page").orderBy("key")) - 1).where("nth < 28")
    day = F.lpad(text(F.col("nth") + 1), 2, "0")
    plain = "<tr><td>{day}/11/2026</td><td>{name}</td><td>Οδός &amp; {key}</td><td>{phone}</td></tr>"
    block = '<tr><td rowspan="3">{day}/11/2026</td><td>{name}, Οδός &amp; {key} Τηλ. {phone}</td></tr><tr><td>08:00 - 14:30</td></tr><tr><td>17:30 - 21:00</td></tr>'
    part = fill(F.when(F.col("page") % 2 == 0, plain).otherwise(block), day=day, name=F.col("name"), key=F.col("key"), phone=F.col("phone"))
    head = F.concat(F.lit("<table>"), F.when(F.col("page_id") % 2 == 0, "<tr><td>Ημερομηνία</td><td>Όνομα</td><td>Διεύθυνση</td><td>Τηλέφωνο</td></tr>").otherwise(""))
    found = pages.article_days(page_of(rows, "page", part, "nth", head, "</table>"))
    return found.select("page_id", text("date").alias("date"), "name", "address", "phone", F.array_join("hours", "|").alias("hours"))


@query("""SELECT n_nationkey AS page_id, '63-town' AS section, (n_nationkey % 12 + 1)::INT AS month, '/efimeries/63-town/' || n_nationkey || '-efimereuonta-famakeia-x' AS path FROM nation""")
def article_index(spark, d):
    k = F.col("n_nationkey")
    link = '<a href="/efimeries/63-town/{key}-efimereuonta-famakeia-x" class="l"> Εφημερεύοντα {month} </a> <a href="/efimeries/63-town/{key}-efimereuonta-famakeia-x">again {month}</a><a href="/efimeries/1-law/2-law">Νόμοι</a>'
    made = table(spark, d, "nation").select(k.alias("page_id"), fill(link, key=k, month=named(MONTHS["el"], (k % 12 + 1).cast("int"))).alias("html"))
    return pages.article_index(made).select("page_id", "section", "month", "path")


@query(f"WITH {S} SELECT page_id, key AS id, 'Φ \"' || key || '\"' AS name, 'Οδός ' || key AS address, phone, 'Πόλη' AS town, key / 8.0 AS lat, CASE WHEN key % 2 = 0 THEN '28800-52200,61200-75600' ELSE '28800-52200' END AS windows, CASE key % 3 WHEN 0 THEN '08:00' WHEN 1 THEN '14:30' ELSE '00:00' END AS clock FROM s")
def map_entities(spark, d):
    """Features in a map page's script, with two windows or one; and a clock from seconds."""
    feature = r'{"geometry": {"coordinates": [{lon}, {lat}]}, "properties": {"pharmacy_id": {key}, "city_name": "Πόλη", "city_short_name": "P", "pharmacy_name": "Φ \\"{key}\\"", "pharmacy_address": "Οδός {key} ΤΗΛ.: {phone}", "duties": {"1": {"duty_name": "d", "start_time": 28800, "end_time": 52200{more}}}}}'
    more = F.when(F.col("key") % 2 == 0, ', "start_time2": 61200, "end_time2": 75600').otherwise(', "start_time2": null')
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("key").alias("o"), fill(feature, key=F.col("key"), lat=F.col("key") / 8, lon=F.col("key") / 4, phone=F.col("phone"), more=more).alias("p")))), lambda x: x["p"]), ", ")
    made = suppliers(spark, d).groupBy(F.col("page").alias("page_id")).agg(parts.alias("p")).select("page_id", F.concat(F.lit("<script>var data = '{\"features\": ["), "p", F.lit("]}';</script>")).alias("html"))
    found = pages.map_entities(made)
    windows = F.array_join(F.transform("windows", lambda w: F.concat_ws("-", w["from_sec"], w["to_sec"])), ",")
    clock = clock_of_seconds(F.get(F.array(F.lit(28_800), F.lit(52_200), F.lit(86_400)), (F.col("id") % 3).cast("int")))
    return found.select("page_id", "id", "name", "address", "phone", "town", "lat", windows.alias("windows"), clock.alias("clock"))


@query(f"WITH {S} SELECT page_id, (nth // 2 + 1)::BIGINT AS nth, 'ώρες ' || nth // 2 AS hours, string_agg(name, ',' ORDER BY key) AS names, min('2026-11-02') AS date, '10:20' AS time FROM s GROUP BY page_id, nth // 2")
def map_extras(spark, d):
    """Groups of longer hours: lines of hours, then the entities that keep them; and the page's own time."""
    rows = suppliers(spark, d).withColumn("nth", F.row_number().over(Window.partitionBy("page").orderBy("key")) - 1)
    hours = F.when(F.col("nth") % 2 == 0, F.concat(F.lit('<span class="glyphicon x" aria-hidden="true"></span> <strong>ώρες '), text(F.floor(F.col("nth") / 2)), F.lit("</strong>"))).otherwise("")
    part = F.concat(hours, fill('<span class="pharmacy_name">{name}</span><br /><span class="pharmacy_address"><strong>x</strong>', name=F.col("name")))
    made = page_of(rows, "page", part, "nth", '<b>2/11/2026 10:20</b><div id="extras">')
    stamp = pages.page_stamp(made, r"<b>(\d+/\d+/\d{4}) (\d+:\d+)</b>").select("page_id", text("date").alias("date"), "time")
    names = F.array_join(F.transform("entities", lambda e: e["name"]), ",")
    return pages.map_extras(made).join(stamp, "page_id").select("page_id", "nth", F.array_join("hours", ",").alias("hours"), names.alias("names"), "date", "time")


@query(f"WITH {S} SELECT page_id, '2026-11-02' AS date, 'ΠΡΩΙ ' || nth // 3 AS heading, name, 'Οδός ' || key AS address, phone FROM s")
def town_duties(spark, d):
    rows = suppliers(spark, d).withColumn("nth", F.row_number().over(Window.partitionBy("page").orderBy("key")) - 1)
    heading = F.when(F.col("nth") % 3 == 0, F.concat(F.lit('<center><font style="color:#800000"> ΠΡΩΙ '), text(F.floor(F.col("nth") / 3)), F.lit("</font></center>"))).otherwise("")
    part = F.concat(heading, fill('<center><span style="color: #000080"><strong>{name}</strong></span><br>Οδός {key} - ΤΗΛ. {phone}<br/></center>', name=F.col("name"), key=F.col("key"), phone=F.col("phone")))
    found = pages.town_duties(page_of(rows, "page", part, "nth", "<h3> Δευτέρα 02/11/2026 </h3>"))
    return found.select("page_id", text("date").alias("date"), "heading", "name", "address", "phone")


@query(f"WITH {S} SELECT page_id, name, 'Οδός ' || key AS address, CASE WHEN key % 4 = 0 THEN '' ELSE phone END AS phone FROM s")
def town_members(spark, d):
    tail = F.when(F.col("key") % 4 == 0, "").otherwise(F.concat(F.lit(" THL. "), F.col("phone")))
    part = F.concat(F.lit("<tr><td>"), "name", F.lit("</td><td class='a'>Οδός "), text("key"), tail, F.lit("</td></tr><tr><td>one cell</td></tr>"))
    return pages.town_members(page_of(suppliers(spark, d), "page", part, "key")).select("page_id", "name", "address", "phone")


@query("""WITH n AS (SELECT n_nationkey AS page_id, n_name AS a FROM nation) SELECT page_id, r AS "row", c AS "column", CASE WHEN r = 0 THEN CASE WHEN c < 2 THEN a ELSE 'x & y' END ELSE CASE WHEN c = 0 THEN a || '0' WHEN c = 1 THEN 'mid' ELSE 'x & y' END END AS text FROM n, (VALUES (0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)) t(r, c)""")
def table_grid(spark, d):
    """Spans filled: a cell stands in each row and column that it covers."""
    made = table(spark, d, "nation").select(F.col("n_nationkey").alias("page_id"), fill('<table><tr><td colspan="2">{a}</td><th rowspan=2> x &amp;<br>y</th></tr><tr><td>{a}0</td><td>mid</td></tr></table>', a=F.col("n_name")).alias("html"))
    return html.table_cells(made).select("page_id", "row", "column", "text")


# --- printed tables ---


def printed(spark: SparkSession, d: str) -> DataFrame:
    """doc, key, nth, page: suppliers as rows of a printed list for each nation, 20 to a page."""
    rows = suppliers(spark, d).withColumn("nth", F.row_number().over(Window.partitionBy("page").orderBy("key")) - 1)
    return rows.select(F.col("page").alias("doc"), F.floor(F.col("nth") / 20).cast("int").alias("page"), (F.col("nth") % 20).cast("int").alias("at"), "nth", "key", "name", "phone")


def items(rows: DataFrame, *parts: tuple[Column, Column, Column, float]) -> DataFrame:
    """An item for each (x, y, text, height) of each row; what lies further up the page comes first."""
    made = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(10.0).alias("width"), F.lit(float(h)).alias("height"), t.alias("text")) for x, y, t, h in parts])
    flat = rows.select("doc", "page", F.explode(made).alias("i")).select("doc", "page", "i.*").where("text IS NOT NULL")
    return flat.withColumn("position", (-F.col("y") * 1000 + F.col("x")).cast("long"))


@query("""SELECT s_nationkey AS doc, 'ΟΜΑΔΑ ' || s_nationkey AS group_name, '2026-10-03' AS date, 'overnight' AS kind, '21:00' AS from_time, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey))::INT AS nth, 'Τόπος' AS locality, 'ΦΑΡΜΑΚΕΙΟ ' || s_suppkey AS name, 'Οδός ' || s_suppkey AS address, '2310' || lpad(s_suppkey::VARCHAR, 6, '0') AS phone FROM supplier""")
def printed_duty_list(spark, d):
    """Printed lists with a title, a heading and a header; names wrap over two lines around their phone."""
    rows, lit = printed(spark, d), F.lit
    y = 600 - 25 * F.col("at")
    body = items(rows, (lit(10), y, lit("Τόπος"), 8), (lit(60), y + 6, lit("ΦΑΡΜΑΚΕΙΟ"), 8), (lit(60), y - 6, text("key"), 8), (lit(120), y, F.concat(lit("Οδός "), text("key")), 8), (lit(190), y, F.col("phone"), 8))
    first = rows.where("nth = 0")
    heads = [(lit(c - 5), lit(630), lit(t), 8) for c, t in ((30, "Περιοχή"), (80, "Όνομα"), (150, "Διεύθυνση"), (210, "Τηλέφωνο"))]
    top = items(first, (lit(10), lit(700), F.concat(lit("ΟΜΑΔΑ "), text("doc")), 13), (lit(10), lit(680), lit("Εφημερεύοντα Σάββατο 03 Οκτ 2026"), 13), (lit(10), lit(650), lit("Διανυκτερεύοντα από 21:00 έως 08:00"), 11), *heads)
    found = layout.duty_list(top.unionByName(body), ("Περιοχή", "Όνομα", "Διεύθυνση", "Τηλέφωνο"), ("locality", "name", "address", "phone"))
    return found.select("doc", "group_name", text("date").alias("date"), "kind", F.col("hours.from").alias("from_time"), "nth", "locality", "name", "address", "phone")


def boxes(rows: DataFrame, *parts: tuple[Column, Column, Column, Column]) -> DataFrame:
    made = F.array(*[F.struct(*[c.cast("double").alias(n) for c, n in zip(p, ("x0", "y0", "x1", "y1"), strict=True)]) for p in parts])
    return rows.select("doc", "page", F.explode(made).alias("b")).select("doc", "page", "b.*")


@query("""WITH s AS (SELECT s_nationkey AS doc, s_suppkey AS key, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n FROM supplier) SELECT doc, (n + 1)::BIGINT AS nth, 'τόπος ' || key || '|2310' || lpad(key::VARCHAR, 6, '0') || '|08:00 ' || key || CASE WHEN n % 20 = 19 AND EXISTS (SELECT 1 FROM s o WHERE o.doc = s.doc AND o.n = s.n + 1) THEN ' next' ELSE '' END AS cells FROM s""")
def bordered_table(spark, d):
    """A table drawn with cell borders; the last row of a full page runs on over the next page's top."""
    rows, lit = printed(spark, d), F.lit
    y = 600 - 25 * F.col("at")
    over = rows.where("nth % 20 = 0 AND nth > 0")
    side = lambda x, low: (lit(x), low, lit(x + 1), low + 22)
    frame = boxes(rows, *[side(x, y) for x in (10, 60, 120, 200)]).unionByName(boxes(over, *[side(x, lit(630)) for x in (10, 60, 120, 200)]))
    words = items(rows, (lit(12), y + 10, F.concat(lit("τόπος "), text("key")), 8), (lit(62), y + 10, F.col("phone"), 8), (lit(122), y + 10, lit("08:00"), 8), (lit(140), y + 10, text("key"), 8)).unionByName(items(over, (lit(125), lit(640), lit("next"), 8)))
    found = layout.bordered_rows(words, frame, 3, (0, 1))
    return found.select("doc", "nth", F.array_join("cells", "|").alias("cells"))


@query("""WITH s AS (SELECT s_nationkey AS doc, s_suppkey AS key, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n FROM supplier) SELECT doc, (n + 1)::BIGINT AS nth, 'ΟΝΟΜΑ ' || key || '|δεύτερο' AS names, 'Δευ 08:00' || CASE WHEN n % 20 = 19 AND EXISTS (SELECT 1 FROM s o WHERE o.doc = s.doc AND o.n = s.n + 1) THEN '|next' ELSE '' END AS hours FROM s""")
def ruled_table(spark, d):
    """Two columns with rules between the rows; what runs on over a page joins its row."""
    rows, lit = printed(spark, d), F.lit
    y = 600 - 25 * F.col("at")
    over = rows.where("nth % 20 = 0 AND nth > 0")
    rule = lambda at: (lit(10), at, lit(210), at + 1)
    frame = boxes(rows, rule(y), rule(y + 25)).unionByName(boxes(over, rule(lit(650))))
    words = items(rows, (lit(12), y + 18, lit("ΟΝΟΜΑ"), 8), (lit(50), y + 17, text("key"), 8), (lit(12), y + 8, lit("δεύτερο"), 8), (lit(120), y + 12, lit("Δευ 08:00"), 8)).unionByName(items(over, (lit(120), lit(635), lit("next"), 8)))
    found = layout.ruled_rows(words, frame)
    return found.select("doc", "nth", F.array_join("names", "|").alias("names"), F.array_join("hours", "|").alias("hours"))


@query("""WITH s AS (SELECT s_nationkey AS doc, s_suppkey AS key, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n FROM supplier) SELECT doc, 'ΠΟΛΗ ' || n // 20 // 2 AS town, (n + 1)::INT AS nth, 'Δευ ' || (1 + n % 28) || '/11' AS date_text, 'ΟΝΟΜΑ ' || key || '|2310' || lpad(key::VARCHAR, 6, '0') AS cells FROM s""")
def yearly_table(spark, d):
    """Rows under a town that goes on over pages; a cell may wrap below its date."""
    rows, lit = printed(spark, d), F.lit
    y = 600 - 25 * F.col("at")
    date = F.concat(lit("Δευ "), text(F.col("nth") % 28 + 1), lit("/11"))
    words = items(rows, (lit(10), y, date, 8), (lit(60), y, lit("ΟΝΟΜΑ"), 8), (lit(60), y - 6, text("key"), 8), (lit(150), y, F.col("phone"), 8))
    towns = items(rows.where("nth % 40 = 0"), (lit(10), lit(650), F.concat(lit("ΠΟΛΗ "), text(F.floor(F.col("nth") / 40))), 11))
    found = layout.yearly_rows(words.unionByName(towns), (0.0, 55.0, 140.0))
    return found.select("doc", "town", "nth", "date_text", F.array_join("cells", "|").alias("cells"))


# A year's table of orders: ten rows a page, ten pages a town, two towns a document. What k % 13 does to a row is in `year_items`.
YEAR = """o AS (SELECT o_orderkey AS k, k % 13 AS v, k // 10 AS p, (k // 100) % 10 = 9 AS named, DATE '2026-01-01' + (k % 365)::INT AS day FROM orders),
tails AS (SELECT p, (8 - 10 * p % 13 + 13) % 13 < 10 AS has_cut FROM o WHERE k % 10 = 9 AND p % 3 = 0 AND v <> 3 AND NOT named),
filled AS (SELECT p FROM tails UNION SELECT p + 1 FROM tails WHERE NOT has_cut AND p % 10 <> 9)"""


@query(f"""WITH {YEAR}, r AS (SELECT *, NOT named AND v = 8 AS cut, p IN (FROM filled) AS mended FROM o)
SELECT k // 200 AS doc, 'ΠΟΛΗ ' || substr('ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ', ((k // 100) % 24 + 1)::INT, 1) AS town, p % 20 AS page, k AS key,
CASE WHEN v <> 10 THEN strftime(day, '%Y-%m-%d') END AS date, CASE WHEN NOT named AND v <> 6 THEN '08:00-14:30 & 17:30-08:00' END AS hours,
CASE WHEN named THEN true WHEN NOT cut THEN k % 2 = 0 WHEN mended THEN false END AS overnight, CASE WHEN NOT named AND v <> 5 THEN '26' || lpad(k::VARCHAR, 8, '0') END AS phone,
CASE WHEN named OR v <> 3 THEN 'ΟΝΟΜΑ ' || k END AS name, CASE WHEN NOT named AND v <> 3 THEN 'ΟΔΟΣ ' || k END AS address,
CASE WHEN v = 10 THEN 'date' WHEN v = 4 THEN 'weekday' WHEN named THEN '' WHEN v = 6 THEN 'hours' WHEN v = 5 THEN 'phone' WHEN cut AND NOT mended THEN 'flag' ELSE '' END AS reasons FROM r""")
def yearly_duties(spark, d):
    """Every order as a row of a year's table, printed badly and read by what the cells say; refused rows with reasons."""
    found = yearly.rows(year_items(spark, d))
    key = F.coalesce(F.regexp_extract("name", r"(\d+)$", 1), F.substring("phone", 3, 8)).cast("long")
    return found.select("doc", "town", "page", key.alias("key"), text("date").alias("date"), "hours", "overnight", "phone", "name", "address", F.array_join("reasons", ",").alias("reasons"))


def year_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of the printed year. By k % 13: 0 wrapped hours, 1 a weekday run into the phone, 2 a flag run into the name,
    3 all in one line, 4 another weekday, 5 two phones, 6 cut hours, 7 name and phone run into the date, 8 no flag, 9 the
    weekday below the date, 10 no such date. Last rows of pages go on on the next one; feet of pages hold another row's flag."""
    lit = F.lit
    k, v = F.col("k"), F.col("v")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).withColumns({"v": k % 13, "p": F.floor(k / 10), "doc": F.floor(k / 200), "named": F.floor(k / 100) % 10 == 9})
    rows = rows.withColumns({"page": F.col("p") % 20, "day": F.date_add(lit("2026-01-01").cast("date"), (k % 365).cast("int")), "y": 700 - 60 * (k % 10)})
    names = F.array(*[lit(w) for w in ("Δευτέρα", "Τρίτη", "Τετάρτη", "Πέμπτη", "Παρασκευή", "Σάββατο", "Κυριακή")])
    weekday = F.get(names, F.weekday(F.date_add("day", F.when(v == 4, 1).otherwise(0))))
    date = F.when(v == 10, "31/2/2026").otherwise(F.date_format("day", "d/M/yyyy"))
    phone, name, street = F.concat(lit("26"), F.lpad(text("k"), 8, "0")), F.concat(lit("ΟΝΟΜΑ "), text("k")), F.concat(lit("ΟΔΟΣ "), text("k"))
    flag = F.when(k % 2 == 0, yearly.YES).otherwise(yearly.NO)
    early, late, y = lit("08:00-14:30 &"), lit("17:30-08:00"), F.col("y")
    both = F.concat_ws(" ", early, late)
    goes_on = v.isin(11, 12) & (k % 10 == 9) & (k % 100 != 99)
    table_rows = rows.where("NOT named")
    first = F.when(v == 3, F.concat_ws(" ", F.concat(date, lit(",")), both, name, street, phone, flag, weekday)).when(v == 7, F.concat_ws(" ", F.concat(date, lit(",")), weekday, name, phone)).when(v.isin(1, 9), F.concat(date, lit(","))).otherwise(F.concat_ws(" ", F.concat(date, lit(",")), weekday))
    cell = lambda x, dy, t, on=lit(True): (lit(x), y + dy, F.when(on & (v != 3), t), 8)
    body = items(
        table_rows, (lit(30), y, first, 8), cell(32, -8, weekday, v == 9), cell(100, 0, F.when(v.isin(0, 6) | goes_on, early).otherwise(both)), cell(100, -9, late, v == 0),
        cell(200, 0, F.when(v == 2, F.concat_ws(" ", flag, name)).otherwise(name), v != 7), cell(300, 0, street),
        cell(400, 0, F.when(v == 1, F.concat_ws(" ", phone, weekday)).when(v == 5, F.concat_ws(" ", phone, phone)).otherwise(phone), v != 7), cell(450, 0, flag, ~v.isin(2, 8)),
        cell(450, -30, lit(yearly.NO), (k % 10 == 9) & (F.col("p") % 3 == 0)),
    )
    over = items(table_rows.where(goes_on).withColumn("page", F.col("page") + 1), (lit(100), lit(780), late, 8))
    letter = F.get(F.split(lit("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), ""), (F.floor(k / 100) % 24).cast("int"))
    town = F.concat(lit("ΠΟΛΗ "), letter)
    nights = items(rows.where("named"), (lit(30), y, F.concat_ws(" ", date, F.upper(weekday)), 8), (lit(100), y, F.when(k % 5 == 0, yearly.HOLIDAY), 8), (lit(200), y, name, 8), (lit(300), y, lit(yearly.OVERNIGHT), 8), (lit(400), y, town, 8))
    towns = items(rows.where("k % 100 = 0"), (lit(30), lit(790), F.concat(town, lit(" 2026")), 11), (lit(30), lit(770), lit("Ημερομηνία"), 8))
    return body.unionByName(over).unionByName(nights).unionByName(towns)


@query("""SELECT p_partkey % 5 || '' AS file, p_partkey AS row, p_name AS name, lpad(p_partkey::VARCHAR, 13, '5') AS barcode, p_retailprice AS price FROM part WHERE p_partkey % 9 <> 0""")
def price_sheets(spark, d):
    """Price rows of sheets whose columns stand in another order in each file."""
    k = F.col("p_partkey")
    price = F.replace(F.format_string("%.2f €", F.col("p_retailprice")), F.lit("."), F.lit(","))
    barcode = F.when(k % 9 == 0, "123").otherwise(F.lpad(text(k), 13, "5"))
    turned = lambda a: F.when(k % 5 < 2, F.array(*a)).otherwise(F.array(*reversed(a)))
    body = table(spark, d, "part").select(text(k % 5).alias("file"), k.alias("row"), turned([barcode, F.col("p_name"), price]).alias("cells"))
    heads = body.select("file").distinct().select("file", F.lit(-1).cast("long").alias("row"), F.when(F.col("file").cast("int") < 2, F.expr("array('BARCODE', 'Ονομασία', 'Τιμή  (€)')")).otherwise(F.expr("array('Τιμή  (€)', 'Ονομασία', 'BARCODE')")).alias("cells"))
    rows = sheets.by_header(heads.unionByName(body), F.array_contains("cells", "BARCODE"), {"barcode": "barcode", "name": "ονομασια", "price": "τιμη"})
    fine, _ = sheets.prices(rows)
    return fine.select("file", "row", "name", "barcode", F.col("price").cast("double").alias("price"))


# --- files that are written ---


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS area FROM supplier) SELECT area, (1 + count(*))::BIGINT AS n_lines, max(len(l)) <= 75 AS folded, bool_and(l LIKE 'SUMMARY:a\\, b\\; ' || k || '%') AS escaped FROM (SELECT *, 'SUMMARY:a\\, b\\; ' || k AS l FROM s) GROUP BY area""")
def calendars(spark, d):
    """One calendar an area: every event with its escaped summary, no line longer than 75 octets."""
    k = F.col("s_suppkey")
    start = F.timestamp_seconds(1_700_000_000 + k * 3600)
    events = table(spark, d, "supplier").select(F.col("s_nationkey").alias("area"), text(k).alias("uid"), start.alias("start"), (start + F.expr("INTERVAL 8 HOURS")).alias("end"), F.concat(F.lit("a, b; "), text(k)).alias("summary"), F.lit("ω" * 60).alias("location"))
    lines = F.split(F.col("ics"), "\r\n")
    made = sinks.calendar(events, "area", F.timestamp_seconds(F.lit(1_700_000_000))).select("area", F.explode(lines).alias("l"))
    summary = F.col("l").startswith("SUMMARY:")
    return made.groupBy("area").agg((F.count_if(summary) + F.count_if(F.col("l") == "END:VCALENDAR")).alias("n_lines"), (F.max(F.octet_length("l")) <= 75).alias("folded"), F.bool_and(~summary | F.col("l").startswith("SUMMARY:a\\, b\\; ")).alias("escaped"))


@query("""SELECT c_nationkey AS area, count(*)::BIGINT AS n, min(c_custkey) AS first, 'Point' AS kind, (count(*) + 1)::BIGINT AS n_urls FROM customer GROUP BY 1""")
def published_files(spark, d):
    """GeoJSON and sitemaps of areas, read back."""
    k = F.col("c_custkey")
    pins = table(spark, d, "customer").select(F.col("c_nationkey").alias("area"), k.alias("id"), (k % 90).cast("double").alias("lat"), (k % 180).cast("double").alias("lon"), F.col("c_name").alias("name"))
    read = F.from_json("geojson", "type STRING, features ARRAY<STRUCT<id: BIGINT, geometry: STRUCT<type: STRING>>>")
    geo = sinks.feature_collections(pins, "area", ["name"]).select("area", read.alias("g")).select("area", F.size("g.features").cast("long").alias("n"), F.get("g.features", F.lit(0))["id"].alias("first"), F.get("g.features", F.lit(0))["geometry"]["type"].alias("kind"))
    urls = pins.select("area", F.concat(F.lit("https://x/?a=1&b="), text("id")).alias("path_url"), F.lit("2024-01-01").cast("date").alias("lastmod"))
    maps = sinks.sitemap(urls, "area").select("area", (F.regexp_count("xml", F.lit("<url><loc>https://x/\\?a=1&amp;b=")) + 1).cast("long").alias("n_urls"))
    return geo.join(maps, "area")


@query("""SELECT n_nationkey AS area, 'https://x/sitemap-' || n_nationkey || '.xml' AS loc, 'Allow: /' AS rule, 'bigint' AS type FROM nation""")
def site_files(spark, d):
    """The index of sitemaps, robots and a schema, read back."""
    areas = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("area"))
    index = sinks.sitemap_index(areas.select(F.concat(F.lit("https://x/sitemap-"), text("area"), F.lit(".xml")).alias("loc"))).select(F.explode(F.regexp_extract_all("xml", F.lit("<loc>(.*?)</loc>"), F.lit(1))).alias("loc"))
    robots = sinks.robots(spark, "https://x/sitemap.xml").select(F.get(F.filter(F.split("text", "\n"), lambda x: x.startswith("Allow")), F.lit(0)).alias("rule"))
    schema = sinks.json_schema(areas).select(F.get_json_object("schema", "$.properties.area.type").alias("_t"))
    found = index.withColumn("area", F.regexp_extract("loc", r"-(\d+)\.xml", 1).cast("int"))
    return found.crossJoin(robots).crossJoin(schema).select("area", "loc", "rule", F.when(F.col("_t") == "integer", "bigint").alias("type"))  # one row each


@query("""WITH a AS (SELECT 'n' || n_nationkey AS area, n_nationkey AS k, CASE WHEN n_nationkey % 5 <> 0 THEN '2001-07-01' END AS f, CASE WHEN n_nationkey % 5 <> 0 THEN '2001-07-28' END AS t FROM nation),
p AS (SELECT 'n' || c_nationkey AS area, c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 90 END AS lat, c_custkey % 180 AS lon FROM customer),
d AS (SELECT 'n' || o_custkey % 25 AS area, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey AS id, o_custkey AS place FROM orders),
place AS (SELECT *, '{"area":"' || area || '","id":' || id || CASE WHEN lat IS NULL THEN '' ELSE ',"lat":' || lat END || ',"lon":' || lon || '}' AS j FROM p),
day AS (SELECT *, '{"area":"' || area || '","date":"' || date || '","id":' || id || ',"place":' || place || '}' AS j FROM d),
kept AS (SELECT * FROM day WHERE date >= '2001-07-13'), national AS (SELECT * FROM day WHERE date BETWEEN '2001-07-19' AND '2001-08-03'),
rows AS (SELECT area || '/pharmacies.json' AS path, lpad(id::VARCHAR, 20, '0') AS key, j FROM place UNION ALL SELECT area || '/duties/' || date || '.json', lpad(id::VARCHAR, 20, '0'), j FROM kept
UNION ALL SELECT 'n' || o_custkey % 25 || '/extended-hours/h.json', lpad(o_orderkey::VARCHAR, 20, '0'), '{"area":"n' || o_custkey % 25 || '","file":"extended-hours/h.json","id":' || o_orderkey || '}' FROM orders WHERE o_orderkey % 7 = 0 AND (o_custkey % 25) % 2 = 0
UNION ALL SELECT 'national/places.json', area || chr(9) || lpad(id::VARCHAR, 20, '0'), j FROM place WHERE lat IS NOT NULL
UNION ALL SELECT 'national/' || date || '.json', area || chr(9) || lpad(id::VARCHAR, 20, '0'), j FROM national
UNION ALL SELECT 'national/index.json', date, '{"date":"' || date || '","areas":' || count(DISTINCT area) || ',"rows":' || count(*) || '}' FROM national GROUP BY date)
SELECT path, 1 AS part, key, CASE WHEN key = min(key) OVER (PARTITION BY path) THEN '[' ELSE ',' END || j AS line FROM rows UNION ALL SELECT path, 2, max(key), ']' FROM rows GROUP BY path
UNION ALL SELECT area || '/meta.json', 1, '', '{"area":"' || area || '"' || CASE WHEN f IS NULL THEN '' ELSE ',"duties":{"from":"' || f || '","to":"' || t || '","dates":[' || coalesce((SELECT string_agg(DISTINCT '"' || date || '"', ',' ORDER BY '"' || date || '"') FROM kept WHERE kept.area = a.area AND date <= t), '') || ']}' END || ',"extendedHours":' || CASE WHEN k % 2 = 0 THEN '["extended-hours/h.json"]' ELSE '[]' END || '}' FROM a""")
def publication_plan(spark, d):
    """Every line of every file that a site of nations, customers and orders publishes on one day."""
    area = lambda c: F.concat(F.lit("n"), text(c))
    k, dated = F.col("n_nationkey"), lambda t: F.when(F.col("n_nationkey") % 5 != 0, F.lit(t).cast("date"))
    file = F.lit("extended-hours/h.json")
    areas = table(spark, d, "nation").select(area(k).alias("area"), dated("2001-07-01").alias("from"), dated("2001-07-28").alias("to"), F.when(k % 2 == 0, F.array(file)).otherwise(F.array().cast("array<string>")).alias("extended"))
    c = F.col("c_custkey")
    places = table(spark, d, "customer").select(area("c_nationkey").alias("area"), c.alias("id"), F.when(c % 4 != 0, c % 90).alias("lat"), (c % 180).alias("lon"))
    orders = table(spark, d, "orders").select(area(F.col("o_custkey") % 25).alias("area"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("place"))
    hours = orders.where("id % 7 = 0").select("area", file.alias("file"), "id")
    return publication.plan(areas, places, orders, hours, F.lit("2001-07-20").cast("date"))
