"""Price lists: which tables to read, the ordered fold, shortages, and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orarium.functions.text import strip_accents
from orarium.operators.capture import changes, dictionary, flags, fold
from orarium.operators.ranges import numbered


def plan(bulletins: DataFrame, title: str, base_pattern: str) -> DataFrame:
    """The newest base revision and the tables after it, in order of id."""
    base = bulletins.where(F.col(title).rlike(base_pattern)).agg(F.max("seq").alias("base"))
    return bulletins.join(F.broadcast(base)).where(F.col("seq") >= F.col("base")).drop("base").orderBy("seq")  # one row


def assemble(rows: DataFrame, shortages: DataFrame) -> DataFrame:
    """One row a barcode: the last row's name, price and kind; blank cells keep the earlier value; the shortage, of equal
    barcodes the last one."""
    latest = fold(rows, "barcode", "seq", ["name", "price", "otc", "bulletin"], ["atc", "substance", "company", "not_reimbursed"])
    short = shortages.groupBy("barcode").agg(F.max_by(F.struct("from", "to", "reason"), "position").alias("shortage"))
    return latest.join(short, "barcode", "left").withColumn("not_reimbursed", F.coalesce("not_reimbursed", F.lit(False)))


def unmatched_shortages(shortages: DataFrame, medicines: DataFrame) -> DataFrame:
    return shortages.select("barcode").distinct().join(medicines.select("barcode"), "barcode", "left_anti")


def changed_kind(rows: DataFrame) -> DataFrame:
    return changes(rows, "barcode", "seq", "otc")


def sort_key(name):
    """A key for the order of names in which numbers count by value: digit runs are padded."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p)), "")


def encode(medicines: DataFrame, columns: tuple[str, ...] = ("substance", "company", "bulletin")) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows with codes by first appearance in the order of names, cents and flags; and the dictionaries."""
    keyed = medicines.withColumn("name_key", strip_accents(sort_key(F.col("name"))))
    rows = numbered(keyed, [F.expr("name_key COLLATE el").asc(), F.col("barcode").asc()], "position")
    books = {c: dictionary(rows, c, "position") for c in columns}
    out = rows.withColumns({"cents": F.round(F.col("price") * 100).cast("int"), "flags": flags(F.col("otc"), F.col("not_reimbursed"))})
    for c, book in books.items():
        out = out.join(book.withColumnRenamed("code", f"{c}_code"), c, "left").drop(c)
    return out.drop("name_key", "price", "otc", "not_reimbursed"), books


def decode(rows: DataFrame, books: dict[str, DataFrame]) -> DataFrame:
    out = rows.withColumns({"price": (F.col("cents") / 100).cast("decimal(10,2)"), "otc": F.col("flags").bitwiseAND(1) == 1, "not_reimbursed": F.col("flags").bitwiseAND(2) == 2}).drop("cents", "flags")
    for c, book in books.items():
        out = out.join(book.withColumnRenamed("code", f"{c}_code"), f"{c}_code", "left").drop(f"{c}_code")
    return out
