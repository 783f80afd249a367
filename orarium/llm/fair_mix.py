"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled by hash; a document's virtual finish time is the cumulative size of its source up
to and including it, divided by the source's target. Epochs after the first go on counting, so a source whose target
is above its size repeats. As targets add up to the budget, the stream sorted by finish time is cut at the budget when
the virtual time is 1. A source whose cut leaves a gap takes one further copy of the document whose size comes nearest
to the gap, if that brings it nearer to its target.

The cut is made by source (cumulative size against target), which is the sorted stream's cut at virtual time 1; only
`mixed_stream` needs the rows in the stream's order.

Cumulative sizes are summed over prefixes of the hash, three hex digits at a time, so that no task holds a source: a
window sees some 256 rows or 4096 sums however large a source is. Sources are ranked and filled over range partitions.

Defined results: null text has size 0; null sources are one source, ranked last; documents of size 0 take no words;
sources without words have the target 0; repeated rows are documents of their own (of rows equal in id and text it is
not said which has the further copy); a text of any length is one document; further columns are ignored, or carried;
empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orarium.llm.common import partitions_for, written

WEIGHTS, REPEATS = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that share a prefix of the hash, and digits that one level of sums takes.
PREFIX_ROWS, LEVEL_DIGITS = 256, 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", doc_id.cast("string"), text).cast("binary"))


def running(df: DataFrame, order: list[Column], **columns: Column) -> DataFrame:
    """df with the sum of each column over all rows up to this one in a total order: sums within range partitions, and
    what the partitions before hold (one row each)."""
    placed = written(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("part").agg(*[F.sum(c).alias(f"{n}_before") for n, c in columns.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", *[F.coalesce(F.sum(f"{n}_before").over(earlier), F.lit(0)).alias(f"{n}_before") for n in columns])
    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(F.broadcast(before), "part").select(*df.columns, *[(F.sum(c).over(upto) + F.col(f"{n}_before")).alias(n) for n, c in columns.items()])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """skey, source, source_size -> with target: the total is shared by weight, and what is above `repeats` times a source's size is shared again."""
    ranked = running(sizes, [F.asc_nulls_last("source")], rank=F.lit(1))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * repeats)
    filled = running(ranked, [(F.col("cap") / F.col("weight")).asc(), F.col("rank").asc()], cap_upto=F.col("cap"), weight_upto=F.col("weight"))
    every = filled.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weight"))
    full = F.col("cap") * (F.col("all_weight") - F.col("weight_upto") + F.col("weight")) <= (F.col("total") - F.col("cap_upto") + F.col("cap")) * F.col("weight")
    filled = filled.crossJoin(every).withColumn("full", full)  # one row of totals
    rest = filled.agg(F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).alias("full_cap"), F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).alias("share"))
    left = (F.col("total") - F.col("full_cap")) * F.col("weight")
    return filled.crossJoin(rest).select("skey", "source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(left / F.col("share")).alias("target"))


def prefix_offsets(sums: DataFrame, digits: int) -> DataFrame:
    """skey, p, n -> skey, p, offset: what the source's smaller prefixes hold, level by level."""
    out = sums.select("skey", "p", F.lit(0).cast("long").alias("offset"))
    for low in range(0, digits, LEVEL_DIGITS):
        high = min(digits, low + LEVEL_DIGITS)
        level = sums.groupBy("skey", F.substring("p", 1, low).alias("above"), F.substring("p", 1, high).alias("q")).agg(F.sum("n").alias("n"))
        window = Window.partitionBy("skey", "above").orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        level = level.select("skey", "q", (F.sum("n").over(window) - F.col("n")).alias("before"))
        out = out.withColumn("q", F.substring("p", 1, high)).join(level.hint("merge"), ["skey", "q"]).select("skey", "p", (F.col("offset") + F.col("before")).alias("offset"))
    return out


def fair_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, carry: bool = False) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, finish (virtual, of the first copy), copies, taken.

    carry: also all columns of docs, in a struct `row`."""
    doc_id, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    columns = {
        "doc_id": doc_id,
        "source": source,
        "skey": F.coalesce(F.concat(F.lit("s"), source), F.lit("n")),
        "size": word_count(text),
        "key": shuffle_key(doc_id, text),
    }
    base = written(docs.select(*[c.alias(n) for n, c in columns.items()]), "mix-base")
    n = base.count()
    digits = 0
    while 16**digits * PREFIX_ROWS < n:
        digits += 1
    prefix = F.substring("key", 1, digits) if digits else F.lit("")
    base = base.withColumn("p", prefix)
    sums = written(base.groupBy("skey", "p").agg(F.sum("size").alias("n"), F.first("source").alias("source")), "mix-sums")
    targets = source_targets(sums.groupBy("skey").agg(F.first("source").alias("source"), F.sum("n").alias("source_size")), weights, repeats).drop("source")
    edges = written(prefix_offsets(sums, digits).join(targets, "skey"), "mix-edges")
    window = Window.partitionBy("skey", "p").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum, size, target = F.col("offset") + F.col("within"), F.col("source_size"), F.col("target")
    copies = F.when(size == 0, 1).when(cum > target, 0).otherwise(F.least(F.lit(repeats), F.floor((target - cum) / size) + 1)).cast("int")

    def with_places(rows: DataFrame) -> DataFrame:
        """Rows with place, finish and copies. The sums join by the windows' own keys: no further shuffle of the rows."""
        inner = rows.withColumn("within", F.sum("size").over(window)).withColumn("place", F.row_number().over(window)).join(edges.hint("merge"), ["skey", "p"])
        return inner.withColumn("copies", copies).withColumn("finish", F.when(target > 0, cum / target).otherwise(F.lit(0.0))).drop("offset", "within")

    placed = written(with_places(base), "mix-placed")
    taken = placed.groupBy("skey").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken")).select("skey", (F.col("target") - F.col("taken")).alias("gap"))
    # of each size in a source the first document that may have a further copy
    first = placed.where((F.col("copies") < repeats) & (F.col("size") > 0)).groupBy("skey", "size").agg(F.min(F.struct("p", "place")).alias("at"))
    fits = first.join(taken, "skey").withColumn("rest", F.abs(F.col("gap") - F.col("size"))).where(F.col("rest") < F.col("gap"))
    best = fits.groupBy("skey").agg(F.min(F.struct("rest", "size", "at")).alias("best")).select("skey", F.col("best.at.p").alias("p"), F.col("best.at.place").alias("further"))
    if carry:  # whole rows take the same places, so that they move once and are written nowhere
        placed = with_places(docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in columns.items()]).withColumn("p", prefix))
    more = F.coalesce((F.col("place") == F.col("further")).cast("int"), F.lit(0))
    mixed = placed.join(best.hint("merge"), ["skey", "p"], "left").withColumn("copies", F.col("copies") + more)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "finish", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *["row"] * carry)


def mixed_stream(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, range-sorted by virtual finish time."""
    mixed = fair_mix(docs, carry=True, **options).where("copies > 0")
    step = F.when(F.col("target") > 0, F.col("source_size") / F.col("target")).otherwise(F.lit(0.0))
    copies = mixed.select("row", "finish", step.alias("step"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"))
    copies = copies.select("row", (F.col("finish") + F.col("epoch") * F.col("step")).alias("finish"))
    n = partitions_for(docs.sparkSession, docs.agg(F.sum(F.octet_length(F.col(f"`{options.get('text_col', 'text')}`")))).first()[0])
    return copies.repartitionByRange(n, "finish").sortWithinPartitions("finish").select("row.*")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws('|', doc_id::VARCHAR, text)) AS key
  FROM documents),
sizes AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM base GROUP BY skey),
ranked AS (SELECT *, row_number() OVER (ORDER BY (skey = 'n'), encode(source)) AS rank FROM sizes),
weighed AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS cap FROM ranked),
filled AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
         (sum(cap) OVER f)::BIGINT - cap AS cap_before,
         (sum(weight) OVER ())::BIGINT - (sum(weight) OVER f)::BIGINT + weight AS weight_left
  FROM weighed WINDOW f AS (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING)),
marked AS (SELECT *, cap * weight_left <= (total - cap_before) * weight AS full_up FROM filled),
targets AS (
  SELECT skey, source_size, CASE WHEN full_up THEN cap::DOUBLE ELSE
         ((total - (sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ())::BIGINT) * weight)::DOUBLE
         / (sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
  FROM marked),
placed AS (
  SELECT b.*, t.source_size, t.target, row_number() OVER w AS place, (sum(size) OVER w)::BIGINT AS cum
  FROM base b JOIN targets t USING (skey) WINDOW w AS (PARTITION BY skey ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)),
cut AS (
  SELECT *, CASE WHEN source_size = 0 THEN 1 WHEN cum > target THEN 0
                 ELSE least(3, floor((target - cum) / source_size)::INT + 1) END AS copies FROM placed),
gaps AS (SELECT skey, any_value(target) - sum(copies * size) AS gap FROM cut GROUP BY skey),
fits AS (
  SELECT skey, place, row_number() OVER (PARTITION BY skey ORDER BY abs(gap - size), size, place) AS nth
  FROM cut JOIN gaps USING (skey) WHERE copies < 3 AND size > 0 AND abs(gap - size) < gap)
SELECT doc_id, size, source_size, target, ((copies + CASE WHEN nth IS NULL THEN 0 ELSE 1 END) * size)::BIGINT AS taken
FROM cut LEFT JOIN (SELECT * FROM fits WHERE nth = 1) USING (skey, place)
"""
