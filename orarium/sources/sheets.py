"""Spreadsheets and positioned text as rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orarium.functions.text import squash, strip_accents

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def first_sheet(data: bytes) -> list[list[str]]:
    """The text of the first sheet's cells, row by row; empty cells are empty strings."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in item.iter(f"{SHEET}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f".//{SHEET}sheet")
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[sheet.get(RELATION)]
    path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    out = []
    for row in ElementTree.fromstring(book.read(path)).iter(f"{SHEET}row"):
        line: dict[int, str] = {}
        for n, cell in enumerate(row.iter(f"{SHEET}c")):
            letters = re.match("[A-Z]*", cell.get("r", ""))[0]
            at = n if not letters else sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters))) - 1
            value = cell.findtext(f"{SHEET}v") or ""
            kind = cell.get("t")
            line[at] = shared[int(value)] if kind == "s" and value else "".join(t.text or "" for t in cell.iter(f"{SHEET}t")) if kind == "inlineStr" else value
        out.append([line.get(k, "") for k in range(max(line, default=-1) + 1)])
    return out


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """file, row and cells of the first sheet of each workbook under a path; a file that isn't one gives a row with an error."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(name, k, cells, None) for k, cells in enumerate(first_sheet(bytes(data)))]
                except (zipfile.BadZipFile, KeyError, AttributeError, ElementTree.ParseError) as error:
                    rows.append((name, None, None, repr(error)))
            yield pd.DataFrame(rows, columns=["file", "row", "cells", "error"]).astype({"row": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, `row` int, cells array<string>, error string")


def by_header(rows: DataFrame, header: Column, columns: dict[str, str]) -> DataFrame:
    """Cells of a sheet by its header row, wherever that stands: file, row and the named columns.

    columns: name -> pattern that fits the header's text without accents."""
    heads = rows.where(header).groupBy("file").agg(F.min_by("cells", "row").alias("head"), F.min("row").alias("head_row"))
    plain = F.transform("head", lambda h: strip_accents(squash(h)))
    at = lambda p: F.array_position(F.transform(plain, lambda h: h.rlike(p)), True)
    body = rows.join(heads, "file").where(F.col("row") > F.col("head_row"))
    return body.select("file", "row", *[squash(F.get("cells", (at(p) - 1).cast("int"))).alias(n) for n, p in columns.items()])


def prices(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Price rows (barcode, name, price) and the rows left out: without 13 digits, a name, or a positive price of whole cents."""
    price = F.round(F.try_to_number(F.regexp_replace(F.replace("price", F.lit(","), F.lit(".")), "[^0-9.]", ""), F.lit("9999999.99")), 2).cast("decimal(10,2)")
    read = rows.withColumn("euros", price).withColumn("fine", F.coalesce(F.col("barcode").rlike(r"^\d{13}$") & (F.col("name") != "") & (F.col("euros") > 0), F.lit(False)))
    return read.where("fine").drop("fine", "price").withColumnRenamed("euros", "price"), read.where("NOT fine").drop("fine", "euros")


def text_lines(items: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """doc, page, x, y, text -> with `line`: items of a page whose y is within the tolerance of the line's first item.

    The anchor is the line's first item, so a page's items are taken in order; a page is a bounded piece of work."""
    schema = T.StructType([*items.schema.fields, T.StructField("line", T.IntegerType())])

    def number(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y", "x"])
        line, anchor, out = -1, None, []
        for y in page["y"]:
            if anchor is None or abs(y - anchor) > tolerance:
                line, anchor = line + 1, y
            out.append(line)
        return page.assign(line=out)[schema.names]

    return items.groupBy("doc", "page").applyInPandas(number, schema)


def nearest_anchor(items: DataFrame, anchors: DataFrame, limit: float = 20.0) -> DataFrame:
    """Each item with the anchor of its page that is nearest in y, at most `limit` away; the first anchor wins ties."""
    both = items.join(anchors.select("doc", "page", F.col("y").alias("anchor_y"), "anchor"), ["doc", "page"])
    both = both.withColumn("dy", F.abs(F.col("y") - F.col("anchor_y"))).where(F.col("dy") <= limit)
    best = Window.partitionBy("doc", "page", "x", "y", "text").orderBy("dy", "anchor_y")
    return both.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "dy")


def bands(marks: DataFrame, items: DataFrame) -> DataFrame:
    """Items by the band of the mark they belong to: bands end half-way between neighbouring marks of a page."""
    order = Window.partitionBy("doc", "page").orderBy("y")
    low = F.coalesce((F.lag("y").over(order) + F.col("y")) / 2, F.lit(float("-inf")))
    high = F.coalesce((F.lead("y").over(order) + F.col("y")) / 2, F.lit(float("inf")))
    cut = marks.select("doc", "page", "mark", low.alias("low"), high.alias("high"))
    return items.join(cut, ["doc", "page"]).where((F.col("low") <= F.col("y")) & (F.col("y") < F.col("high"))).drop("low", "high")


def upper_median(values: Column) -> Column:
    """The middle element, the upper one of two."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def consensus(rows: DataFrame, key: str, town: str) -> DataFrame:
    """One name and address a key: with an address first, then the most frequent, the longer name, Greek order."""
    counts = rows.groupBy(key, "name", "address").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.min_by(town, "position").alias(town))
    best = Window.partitionBy(key).orderBy((F.col("address") != "").desc(), F.desc("n"), F.length("name").desc(), F.expr("name COLLATE el"), "address")
    towns = rows.groupBy(key).agg(F.count_distinct(town).alias("n_towns"), F.min_by(town, "position").alias("_town"))
    picked = counts.withColumn("_k", F.row_number().over(best)).where("_k = 1").select(key, "name", "address")
    return picked.join(towns, key).select(key, "name", "address", F.col("_town").alias(town), "n_towns")
