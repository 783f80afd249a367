"""Tables out of positioned text and drawn boxes, as joins and windows over items.

    items   doc, page, position (order in the page), x, y, width, height, text; y grows upward, as on paper
    boxes   doc, page, x0, y0, x1, y1

A document is read page by page and line by line; what a row takes from the row before (an open cell, a heading, a town)
is a window over that order, so documents are independent and a page is the largest unit that a sort holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orarium.functions.grammars import extra_hours, heading
from orarium.functions.text import clean_display, join_lines, squash
from orarium.functions.titles import weekday_date
from orarium.sources.sheets import text_lines

# Heights of a title's and a heading's letters; how far an item may lie from its row's phone; how thin a
# rule is, and how wide one between rows.
TITLE, HEADING, REACH, THIN, WIDE = 12.0, 10.0, 20.0, 2.5, 100.0


def lines(items: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """doc, page, line, y, height, text (words left to right) and items of each line, top to bottom."""
    numbered = text_lines(items.withColumns({"_y": F.col("y"), "y": -F.col("y")}), tolerance).withColumn("y", F.col("_y")).drop("_y")
    words = F.array_sort(F.collect_list(F.struct("x", "position", "y", "width", "height", "text")))
    found = numbered.groupBy("doc", "page", "line").agg(F.max("height").alias("height"), F.max("y").alias("y"), words.alias("items"))
    return found.withColumn("text", squash(F.array_join(F.transform("items", lambda i: i["text"]), " ")))


def carried(rows: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """Each column's last value that isn't null, in order: what a later row takes over from an earlier one."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})


def column_edges(left: Column, centres: list[Column]) -> list[Column]:
    """Edges of columns that touch and whose headers are centred: each lies as far right of its header as the one before
    lies left of it."""
    return reduce(lambda edges, c: [*edges, 2 * c - edges[-1]], centres, [left])


def duty_list(items: DataFrame, labels: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """doc, group_name, date, section, heading, kind, hours, extra, nth and the cells of each row of printed duty lists.

    Large letters are the title (the group, then the date), middle ones headings, and notes below them; then a header with
    all the labels, and rows. Every row has one cell in the last column (its phone); an item belongs to the nearest one of
    its page, at most REACH away, the first one where two are as near. A list whose date doesn't fit its weekday has none."""
    found = lines(items)
    order = Window.partitionBy("doc").orderBy("page", "line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    read = F.col("text")
    found = found.withColumn("level", F.when(F.col("height") >= TITLE, "title").when((F.col("height") >= HEADING) & heading(read)["kind"].isNotNull(), "heading").when(F.col("height") >= HEADING, "note").otherwise("row"))
    titles = found.where("level = 'title'").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "line", "text"))).alias("t"))
    titles = titles.select("doc", F.get("t", F.lit(0))["text"].alias("group_name"), weekday_date(F.array_join(F.transform(F.slice("t", 2, 9), lambda x: x["text"]), " ")).alias("date"))
    found = found.withColumn("section", F.count_if(F.col("level") == "heading").over(upto)).where("section > 0 AND level <> 'title'")
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == "note", F.struct("page", "line", "text")))), lambda x: x["text"]), " ")
    heads = found.groupBy("doc", "section").agg(F.max(F.when(F.col("level") == "heading", F.col("text"))).alias("heading"), notes.alias("note"))
    centre = lambda label: F.get(F.filter("items", lambda i: squash(i["text"]) == label), F.lit(0))
    spots = [centre(label) for label in labels]
    is_header = reduce(lambda a, b: a & b, [s.isNotNull() for s in spots])
    rows = found.where("level = 'row'").withColumn("is_header", is_header)
    centres = rows.where("is_header").groupBy("doc", "section").agg(*[F.min_by(s["x"] + s["width"] / 2, F.struct("page", "line")).alias(f"_c{k}") for k, s in enumerate(spots)])
    body = rows.where("NOT is_header").select("doc", "section", "page", "line", F.explode("items").alias("i")).select("doc", "section", "page", "line", "i.*")
    left = body.groupBy("doc", "section").agg((F.min("x") - 1).alias("_left"))
    edges = column_edges(F.col("_left"), [F.col(f"_c{k}") for k in range(len(labels))])
    body = body.join(centres, ["doc", "section"]).join(left, ["doc", "section"])
    column = reduce(lambda c, k: F.when(F.col("x") >= edges[k] - 1, k).otherwise(c), range(1, len(columns)), F.lit(0))
    body = body.withColumn("column", column).select("doc", "section", "page", "line", "position", "x", "y", "text", "column")
    anchors = body.where(F.col("column") == len(columns) - 1).select("doc", "section", "page", F.col("line").alias("at"), F.col("position").alias("anchor"), F.col("y").alias("anchor_y"))
    near = body.join(anchors, ["doc", "section", "page"]).withColumn("dy", F.abs(F.col("y") - F.col("anchor_y"))).where(F.col("dy") <= REACH)
    best = Window.partitionBy("doc", "section", "page", "position").orderBy("dy", "at", "anchor")
    near = near.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    cell = lambda k: join_lines(F.transform(F.array_sort(F.collect_list(F.when(F.col("column") == k, F.struct((-F.col("y")).alias("d"), "x", "text")))), lambda t: t["text"]))
    cells = near.groupBy("doc", "section", "page", "at", "anchor").agg(*[cell(k).alias(c) for k, c in enumerate(columns)])
    nth = Window.partitionBy("doc", "section").orderBy("page", "at", "anchor")
    cells = cells.withColumn("nth", F.row_number().over(nth)).join(heads, ["doc", "section"]).join(titles, "doc")
    read = heading(F.col("heading"))
    texts = [clean_display(F.col(c)).alias(c) for c in columns[:-1]] + [F.regexp_replace(columns[-1], r"\s", "").alias(columns[-1])]
    return cells.select("doc", "group_name", "date", "section", "heading", read["kind"].alias("kind"), read["hours"].alias("hours"), extra_hours(F.nullif(F.col("note"), F.lit(""))).alias("extra"), "nth", *texts)


def bordered_rows(items: DataFrame, boxes: DataFrame, columns: int, keys: tuple[int, ...] = (0, 3)) -> DataFrame:
    """doc, nth, cells (array of texts) of a table drawn with cell borders: thin upright boxes are sides, one at the far
    left for each row; what a row's sides leave between them are its cells. A row with none of its key cells continues the
    one before, also over a page. Rows with another number of cells are no rows of the table."""
    sides = boxes.where((F.col("x1") - F.col("x0") <= THIN) & (F.col("y1") - F.col("y0") >= 2))
    page = Window.partitionBy("doc", "page")
    sides = sides.withColumn("left", F.min("x0").over(page))
    starts = sides.where("x0 - left < 1").select("doc", "page", F.col("y0").alias("low"), F.col("y1").alias("high")).distinct()
    starts = starts.withColumn("row", F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.desc("high"))))
    met = starts.join(sides.select("doc", "page", "x0", "x1", "y0", "y1"), ["doc", "page"]).where("y0 < high - 1 AND y1 > low + 1")
    met = met.select("doc", "page", "row", "low", "high", ((F.col("x0") + F.col("x1")) / 2).alias("edge")).distinct()
    across = Window.partitionBy("doc", "page", "row").orderBy("edge")
    met = met.withColumn("gap", F.col("edge") - F.lag("edge").over(across)).where("gap IS NULL OR gap > 4")
    cells = met.withColumns({"end": F.lead("edge").over(across), "cell": F.row_number().over(across) - 1, "n": F.count("*").over(Window.partitionBy("doc", "page", "row")) - 1}).where(F.col("end").isNotNull() & (F.col("n") == columns))
    placed = cells.join(items.select("doc", "page", "position", "x", "y", "text"), ["doc", "page"], "left").where("position IS NULL OR (y >= low - 1 AND y <= high + 1 AND x >= edge - 1 AND x < end)")
    texts = placed.groupBy("doc", "page", "row", "cell").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("t"))
    grid = cells.select("doc", "page", "row", "cell").join(texts, ["doc", "page", "row", "cell"], "left")
    blank = F.max(F.when(F.col("cell").isin(*keys), F.coalesce(F.size("t"), F.lit(0)))) <= 0
    opened = grid.groupBy("doc", "page", "row").agg((~blank).alias("opens"))
    order = Window.partitionBy("doc").orderBy("page", "row").rowsBetween(Window.unboundedPreceding, 0)
    opened = opened.withColumn("nth", F.count_if("opens").over(order)).where("nth > 0")
    joined = grid.join(opened, ["doc", "page", "row"]).groupBy("doc", "nth", "cell").agg(F.array_sort(F.collect_list(F.struct("page", "row", "t"))).alias("p"))
    text = squash(F.array_join(F.flatten(F.transform("p", lambda p: F.transform(F.coalesce(p["t"], F.array()), lambda t: t["text"]))), " "))
    return joined.select("doc", "nth", "cell", text.alias("text")).groupBy("doc", "nth").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"]).alias("cells"))


def ruled_rows(items: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc, nth, names and hours (arrays of lines) of a two-column table with rules between its rows: the cells between
    two rules, cut in the middle. A row without names continues the hours of the one before, also over a page."""
    rules = boxes.where((F.col("y1") - F.col("y0") <= THIN) & (F.col("x1") - F.col("x0") >= WIDE))
    middle = rules.groupBy("doc", "page").agg(((F.min("x0") + F.max("x1")) / 2).alias("middle"))
    down = Window.partitionBy("doc", "page").orderBy(F.desc("at"))
    levels = rules.select("doc", "page", ((F.col("y0") + F.col("y1")) / 2).alias("at")).distinct()
    levels = levels.withColumn("gap", F.lag("at").over(down) - F.col("at")).where("gap IS NULL OR gap > 3")
    bands = levels.withColumns({"low": F.lead("at").over(down), "row": F.row_number().over(down)}).where("low IS NOT NULL").join(middle, ["doc", "page"])
    inside = bands.join(items.select("doc", "page", "position", "x", "y", "text"), ["doc", "page"]).where("y < at AND y > low")
    inside = inside.withColumn("side", (F.col("x") >= F.col("middle")).cast("int"))
    # within a cell a line is what lies at most 3 below the item before
    flow = Window.partitionBy("doc", "page", "row", "side").orderBy(F.desc("y"), "x")
    inside = inside.withColumn("line", F.count_if(F.coalesce(F.lag("y").over(flow) - F.col("y") > 3, F.lit(True))).over(flow.rowsBetween(Window.unboundedPreceding, 0)))
    written = inside.groupBy("doc", "page", "row", "side", "line").agg(F.array_sort(F.collect_list(F.struct("x", "position", "text"))).alias("w"))
    written = written.withColumn("text", squash(F.array_join(F.transform("w", lambda w: w["text"]), " "))).where("text <> ''")
    opened = written.groupBy("doc", "page", "row").agg((F.min("side") == 0).alias("opens"))
    order = Window.partitionBy("doc").orderBy("page", "row").rowsBetween(Window.unboundedPreceding, 0)
    opened = opened.withColumn("nth", F.count_if("opens").over(order)).where("nth > 0")
    side = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("page", "row", "line", "text")))), lambda x: x["text"])
    return written.join(opened, ["doc", "page", "row"]).groupBy("doc", "nth").agg(side(0).alias("names"), side(1).alias("hours"))


def yearly_rows(items: DataFrame, edges: tuple[float, ...], heading_height: float = HEADING, above: float = 7.0) -> DataFrame:
    """doc, town, nth, date_text and cells of a yearly table: headings name the town, until the next one, also over pages;
    each item belongs to the nearest date at or above it (at most `above` higher than the item), else to the row before,
    so wrapped cells come back to their row. edges: where the columns begin; the first one holds the dates."""
    found = items.withColumn("is_heading", F.col("height") >= heading_height)
    column = reduce(lambda c, e: c + F.when(F.col("x") >= e, 1).otherwise(0), edges, F.lit(-1))
    flow = Window.partitionBy("doc").orderBy("page", F.desc("y"), "x")
    found = found.withColumn("column", F.when(F.col("is_heading"), None).otherwise(column))
    found = found.withColumn("is_date", F.coalesce((F.col("column") == 0) & F.col("text").rlike(r"\d{1,2}/\d{1,2}"), F.lit(False)))
    # a date starts a row for what lies level with it too, wherever that stands on the line
    level = found.where("is_date").select("doc", "page", F.col("y").alias("row_y"), F.col("text").alias("date_text")).distinct()
    near = found.where("NOT is_heading").join(level, ["doc", "page"], "left").withColumn("dy", F.col("row_y") - F.col("y"))
    near = near.withColumn("dy", F.when((F.col("dy") >= -0.5) & (F.col("dy") <= above), F.col("dy")))
    best = Window.partitionBy("doc", "page", "position").orderBy(F.asc_nulls_last("dy"), "row_y")
    near = near.withColumn("_n", F.row_number().over(best)).where("_n = 1").withColumns({"row_y": F.when(F.col("dy").isNotNull(), F.col("row_y")), "date_text": F.when(F.col("dy").isNotNull(), F.col("date_text"))})
    towns = found.where("is_heading").select("doc", "page", "y", "x", "position", F.col("text").alias("town"))
    both = near.select("doc", "page", "y", "x", "position", "text", "column", "row_y", "date_text").unionByName(towns, allowMissingColumns=True)
    both = both.withColumn("opens", F.when(F.col("row_y").isNotNull(), F.concat_ws("|", "page", F.col("row_y").cast("string"))))
    both = carried(both, ["doc"], ["page", F.coalesce("row_y", "y").desc(), "x"], ["town", "opens", "date_text"]).where("`column` IS NOT NULL AND opens IS NOT NULL")
    cell = lambda k: squash(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("column") == k, F.struct("page", (-F.col("y")).alias("d"), "x", "text")))), lambda t: t["text"]), " "))
    rows = both.groupBy("doc", "town", "opens").agg(F.min(F.struct("page", (-F.coalesce("row_y", "y")).alias("d"))).alias("at"), F.first("date_text").alias("date_text"), F.array(*[cell(k) for k in range(1, len(edges))]).alias("cells"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc").orderBy("at"))).select("doc", "town", "nth", "date_text", "cells")
