"""Spelling variants of a corpus's words, by an even-partition pigeonhole join.

A word of length L is indexed under its two even segments, the first L div 2 code points and the rest. One edit leaves a
segment of the shorter word whole, so a word probes the words of its own length with its own segments (a replaced code
point lies in one of them), and those one shorter with the substrings that a deletion leaves: the first segment at its
place, the second one moved on by one. The rest of both words beside the met segment must be one edit apart, which the
join itself tests; a pair that both segments would find is taken by the first. So a pair leaves the join once and true,
and each word has six rows whatever its length.

Defined results: a null text has no words; a row whose doc_id is null has words that lose no code point; repeated rows
count again; further columns are ignored; an empty table gives no rows. A word without a near one has n_near 0 and is its
own root. A form has twice its word's count or more, so that forms never go in a circle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orarium.llm.common import discard, pick, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
#: Of so many runs one loses a code point; shortest words; least occurrences; how much more frequent a form is.
EVERY, SHORTEST, LEAST, TIMES = 97, 5, 3, 2


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = EVERY) -> DataFrame:
    """word, n of all runs of letters; with `every`, one of so many runs (by the crc32 of id and run) loses a code point."""
    runs = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))
    if every:
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "word").cast("binary"))
        at = (F.col("h") % F.char_length("word")).cast("int")
        words = words.withColumn("h", h).select(F.when(F.col("h") % every == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))).otherwise(F.col("word")).alias("word"))
    return words.where(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def parts(word: Column, length: Column, shift: int) -> Column:
    """part, segment and rest of a word that is `shift` longer than the length its segments are cut for."""
    half = F.floor(length / 2).cast("int")
    cut = lambda begin, count: F.substring(word, begin, count)
    first = F.struct(F.lit(1).alias("part"), cut(F.lit(1), half).alias("segment"), cut(half + 1, length).alias("rest"))
    second = F.struct(F.lit(2).alias("part"), cut(half + 1 + shift, length).alias("segment"), cut(F.lit(1), half + shift).alias("rest"))
    return F.array(first, second)


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of words (word, n; each word once) one edit apart; a is longer, or smaller of equally long ones."""
    length = F.char_length("word").cast("int")
    sized = words.select("word", "n", length.alias("length"))
    index = sized.select(F.col("word").alias("b"), F.col("n").alias("n_b"), "length", F.inline(parts(F.col("word"), F.col("length"), 0)))
    probes = [
        sized.where(F.col("length") - shift >= SHORTEST).select(F.col("word").alias("a"), F.col("n").alias("n_a"), (F.col("length") - shift).alias("length"), F.lit(shift).alias("shift"), F.inline(parts(F.col("word"), F.col("length") - shift, shift)))
        for shift in (0, 1)
    ]
    mine, other = probes[0].unionByName(probes[1]).alias("p"), index.alias("i")
    met = (F.col("p.length") == F.col("i.length")) & (F.col("p.part") == F.col("i.part")) & (F.col("p.segment") == F.col("i.segment"))
    once = ((F.col("p.shift") == 1) & ((F.col("p.part") == 1) | ~F.startswith("p.rest", "i.rest"))) | ((F.col("p.shift") == 0) & (F.col("p.a") < F.col("i.b")))
    return mine.join(other, met & once & (F.levenshtein("p.rest", "i.rest", 1) == 1)).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form: forms followed to the last, the distance doubling each round."""
    chain = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not chain.where("moved").isEmpty():
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, chain = chain, written(chain.drop("moved").join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        discard(before)
    return chain.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = EVERY) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the corpus."""
    words = written(word_counts(docs, id_col, text_col, every), "words")
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("n_other")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    near = one_edit_pairs(words).select(F.inline(sides)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"), F.first("n").alias("n"))
    fits = -F.col("best.less") >= TIMES * F.col("n")
    near = written(near.select("word", "n_near", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "near")
    out = words.join(near, "word", "left").join(roots(near.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
