"""Ranked search over prepared word columns, for one query by a scan or for many by an index of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orarium.functions.text import index_words, medicine_sound, words
from orarium.operators.ranges import settled

#: Letters or digits that a query needs.
MIN_QUERY = 2


def prepare(rows: DataFrame, name: str, substance: str) -> DataFrame:
    """Adds name_words and substance_words."""
    return rows.withColumns({"name_words": index_words(F.col(name)), "substance_words": index_words(F.col(substance))})


def word_matches(query: Column, word: Column) -> Column:
    """The word begins with the query, or is long (7+) and the query spells it with another ending: at most the last
    letter of the word and two more of the query apart."""
    common = F.when(F.startswith(query, word), F.length(word)).when(F.startswith(query, F.left(word, F.length(word) - 1)), F.length(word) - 1)
    return F.startswith(word, query) | (F.length(word) >= 7) & F.coalesce(F.length(query) - common <= 2, F.lit(False))


def ranked_search(prepared: DataFrame, query: str, name: str, code: str, query_words: list[str] | None = None) -> DataFrame:
    """Rows with all words of the query, with score: 0 the name's first word, or the code holds the digits; 1 all in the
    name; 2 in name or substance. Ordered by score, name and code."""
    spark = prepared.sparkSession
    if query_words is None:
        query_words = spark.range(1).select(words(medicine_sound(F.lit(query))).alias("w")).first()[0]
    if len("".join(query_words)) < MIN_QUERY:
        return prepared.withColumn("score", F.lit(0)).limit(0)
    digits = "".join(query.split())
    def each(pool) -> list[Column]:
        has = lambda q: F.exists(pool, lambda w: word_matches(F.lit(q), w))
        return [has(q) for q in query_words]

    every = lambda tests: F.forall(F.array(*tests), lambda t: t)
    in_name = every(each("name_words"))
    in_both = every(each(F.concat("name_words", "substance_words")))
    first = F.coalesce(word_matches(F.lit(query_words[0]), F.get("name_words", F.lit(0))), F.lit(False))
    coded = F.contains(F.col(code), F.lit(digits)) if digits.isdigit() and 6 <= len(digits) <= 13 else F.lit(False)
    score = F.when(in_name, F.when(first, 0).otherwise(1)).when(in_both, 2).when(coded, 0)
    return prepared.withColumn("score", score).where("score IS NOT NULL").orderBy("score", F.expr(f"{name} COLLATE el_CI_AI"), code)


def prefix_search(rows: DataFrame, key: str, query_key: str, order: str, limit: int | None = None) -> DataFrame:
    """Rows whose key starts with the query first, then those that hold it; the given order inside."""
    starts = F.startswith(F.col(key), F.lit(query_key))
    found = rows.where(F.contains(F.col(key), F.lit(query_key))).withColumn("starts", starts).orderBy(F.desc("starts"), order)
    return found.limit(limit) if limit is not None else found


def word_index(prepared: DataFrame, key: str) -> DataFrame:
    """word, key, first (it is the name's first word), named (it stands in the name): a posting for each word of a row."""
    name = prepared.select(F.col(key).alias("_id"), F.posexplode("name_words").alias("_p", "word")).select("word", "_id", (F.col("_p") == 0).alias("first"), F.lit(True).alias("named"))
    other = prepared.select(F.col(key).alias("_id"), F.explode("substance_words").alias("word")).select("word", "_id", F.lit(False).alias("first"), F.lit(False).alias("named"))
    return name.unionByName(other).groupBy("word", "_id").agg(F.bool_or("first").alias("first"), F.bool_or("named").alias("named"))


def matching_words(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """q, word: for each word asked for (q) those of the vocabulary that `word_matches` takes, as equi joins.

    A word lies under each of its beginnings; a long one also under itself and itself without its last letter, where a
    query finds it by its own beginnings of up to two letters less."""
    beginnings = lambda w, least: F.transform(F.sequence(least, F.length(w)), lambda n: F.left(w, n))
    stored = vocabulary.select("word", F.explode(beginnings(F.col("word"), F.lit(1))).alias("q"))
    starts = asked.join(stored, "q").select("q", "word")
    # another ending: the query goes on after the word, or after all but its last letter
    long = vocabulary.where(F.length("word") >= 7).select("word", F.explode(F.array("word", F.left("word", F.length("word") - 1))).alias("stem"))
    spelt = asked.where(F.length("q") >= 6).select("q", F.explode(beginnings(F.col("q"), F.greatest(F.length("q") - 2, F.lit(6)))).alias("stem"))
    endings = spelt.join(long, "stem").select("q", "word").where(word_matches(F.col("q"), F.col("word")))
    return starts.unionByName(endings).distinct()


def search_many(queries: DataFrame, prepared: DataFrame, key: str, order: list[str], k: int, query_id: str = "query_id", query_words: str = "query_words") -> DataFrame:
    """query_id, key, score, nth: the first k rows of each query, as `ranked_search` scores them by words (0 the name's
    first word, 1 all in the name, 2 in name or substance), then by `order`, whose last column tells all rows apart.

    Queries are answered through an index of words, not by scanning the rows for each: equal lists of words are asked
    once; the words meet the vocabulary by their beginnings; of a query's words the rarest gives the candidates, which the
    others must confirm. A query of one word needs no more than the first k rows of each word that it meets."""
    lists = settled(queries.select(F.col(query_words).alias("words")).distinct().where(F.length(F.array_join("words", "")) >= MIN_QUERY).withColumn("_q", F.monotonically_increasing_id()), "queries")
    index = settled(word_index(prepared, key), "word-index")
    asked = lists.select(F.explode("words").alias("q")).distinct()
    met = settled(matching_words(asked, index.select("word").distinct()), "met-words")
    rows = prepared.select(F.col(key).alias("_id"), *order)
    # what a word asked for finds in a row: the first word, the name, or anything
    hits = met.join(index, "word").groupBy("q", "_id").agg(F.bool_or("first").alias("first"), F.bool_or("named").alias("named"))
    single = lists.where(F.size("words") == 1).select("_q", F.col("words")[0].alias("q"))
    score = F.when(F.col("first"), 0).when(F.col("named"), 1).otherwise(2)
    best_of_word = Window.partitionBy("word", "s").orderBy(*order)
    # of a word's rows with one score only the first k can be shown, whatever asks for it
    heads = index.join(met.join(single.select("q").distinct(), "q", "left_semi").select("word").distinct(), "word", "left_semi").withColumn("s", score).join(rows, "_id").withColumn("_n", F.row_number().over(best_of_word)).where(F.col("_n") <= k)
    ones = single.join(met, "q").join(heads.select("word", "_id", "s"), "word").groupBy("_q", "_id").agg(F.min("s").alias("score"))
    several = lists.where(F.size("words") > 1)
    numbers = met.join(index.groupBy("word").agg(F.count("*").alias("n")), "word").groupBy("q").agg(F.sum("n").alias("n"))
    each = several.select("_q", F.explode(F.array_distinct("words")).alias("q")).join(numbers, "q", "left")
    # a word that meets nothing leaves its query without rows
    rarest = each.groupBy("_q").agg(F.min_by("q", F.struct("n", "q")).alias("q"), F.bool_or(F.col("n").isNull()).alias("none")).where("NOT none").select("_q", "q")
    candidates = rarest.join(hits.select("q", "_id"), "q").select("_q", "_id")
    confirmed = candidates.join(each.select("_q", "q"), "_q").join(hits, ["q", "_id"]).groupBy("_q", "_id").agg(F.count("*").alias("n"), F.bool_and("named").alias("named"))
    lead = several.select("_q", F.col("words")[0].alias("q"), F.size(F.array_distinct("words")).alias("_all"))
    whole = confirmed.join(lead, "_q").where("n = _all").join(hits.select("q", "_id", "first"), ["q", "_id"])
    many = whole.select("_q", "_id", F.when(F.col("named"), F.when(F.col("first"), 0).otherwise(1)).otherwise(2).alias("score"))
    top = Window.partitionBy("_q").orderBy("score", *order)
    found = ones.unionByName(many).join(rows, "_id").withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k)
    found = found.join(lists, "_q").select("words", F.col("_id").alias(key), "score", "nth")
    return queries.select(query_id, F.col(query_words).alias("words")).join(found, "words").select(query_id, key, "score", "nth")
