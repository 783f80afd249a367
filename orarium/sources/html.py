"""Cards, links and grids from landed HTML pages."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def all_of(page: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(page, F.lit(pattern), F.lit(group))


def page_cards(pages: DataFrame) -> DataFrame:
    """page_id, title, n_links, first_link and n_paragraphs."""
    page = F.col("html")
    links = all_of(page, '<a href="([^"]*)"')
    return pages.select("page_id", F.regexp_extract(page, "<title>(.*?)</title>", 1).alias("title"), F.size(links).alias("n_links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"), F.size(all_of(page, "<p[ >]", 0)).alias("n_paragraphs"))


def cards(pages: DataFrame, start: str, fields: dict[str, str]) -> DataFrame:
    """One row for each card: the page is cut where `start` fits, and each field is the first group of its pattern."""
    cut = pages.select("page_id", F.posexplode(F.slice(F.split("html", start), 2, F.greatest(F.size(F.split("html", start)) - 1, F.lit(0)))).alias("position", "card"))
    return cut.select("page_id", "position", *[text_of(F.regexp_extract("card", p, 1)).alias(n) for n, p in fields.items()])


@F.pandas_udf(T.StringType())
def decode_entities(x: pd.Series) -> pd.Series:
    """Named and numeric entities."""
    return x.map(entities.unescape, na_action="ignore")


def text_of(x: Column) -> Column:
    """Tags off, entities decoded, white space squeezed."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(x, "<[^>]*>", " ")), r"\s+", " "))


def grid(table: str) -> list[list[str]]:
    """The cells of an HTML table, spans filled: a cell stands in each row and column that it covers."""
    out: list[list[str]] = []
    open_cells: dict[int, tuple[int, str]] = {}
    for row in re.findall(r"<tr\b.*?</tr>", table, re.S | re.I):
        line: dict[int, str] = {c: t for c, (_, t) in open_cells.items()}
        open_cells = {c: (n - 1, t) for c, (n, t) in open_cells.items() if n > 1}
        column = 0
        for tag, body in re.findall(r"<t[dh]\b([^>]*)>(.*?)</t[dh]>", row, re.S | re.I):
            span = {k.lower(): int(v) for k, v in re.findall(r"(rowspan|colspan)\s*=\s*[\"']?(\d+)", tag, re.I)}
            text = re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " ", body))).strip()
            while column in line:
                column += 1
            for k in range(span.get("colspan", 1)):
                line[column + k] = text
                if span.get("rowspan", 1) > 1:
                    open_cells[column + k] = (span["rowspan"] - 1, text)
            column += span.get("colspan", 1)
        out.append([line.get(c, "") for c in range(max(line, default=-1) + 1)])
    return out


def table_cells(pages: DataFrame) -> DataFrame:
    """page_id, table, row, column, text of every cell of every table."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [
                (page, t, r, c, text)
                for page, source in zip(pdf["page_id"], pdf["html"], strict=True)
                for t, table in enumerate(re.findall(r"<table\b.*?</table>", source or "", re.S | re.I))
                for r, line in enumerate(grid(table))
                for c, text in enumerate(line)
            ]
            yield pd.DataFrame(rows, columns=["page_id", "table", "row", "column", "text"])

    return pages.select("page_id", "html").mapInPandas(read, "page_id long, `table` int, `row` int, `column` int, text string")
