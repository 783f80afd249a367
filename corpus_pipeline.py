"""A training corpus from raw documents: classify, deduplicate, decontaminate, mix, write token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written to the
shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orarium.llm.bbit_minhash import near_duplicates
from orarium.llm.common import written
from orarium.llm.fair_mix import mixed_stream
from orarium.llm.quality_net import quality_scores
from orarium.llm.queries import table, vocabulary
from orarium.llm.repair_output import token_output
from orarium.llm.wu_manber import benchmark_hits, contaminated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, as they are; null and empty texts are scored like others, repeated rows stay."""
    return quality_scores(docs, table(spark, sf_dir, "labels"), carry=True).where("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles alike by 80 % or more): the one of the smallest id.

    Rows that share an id are one document, which stays or goes; of rows equal in id and text one stays, the first by its
    other columns. Rows without an id are documents by their text, after all others. Null and empty texts stay, once an id."""
    unnamed = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("key"), F.struct("*").alias("row"))
    kept = near_duplicates(keyed.select("key", F.col("row.text").alias("text")), id_col="key", percent=PERCENT).where("kept").select(F.col("doc_id").alias("key")).distinct()
    one = keyed.join(kept, "key", "left_semi").groupBy("key", F.col("row.text").alias("text")).agg(F.min_by("row", F.to_json(F.struct("row"))).alias("row"))
    return one.select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to be contaminated; null and empty texts hold none of it."""
    return benchmark_hits(docs, table(spark, sf_dir, "benchmark")).where(~contaminated(F.col("n_hit"), F.col("n_words"))).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: documents left out, or repeated; a null source is one source, and documents
    without a word are taken once."""
    return mixed_stream(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all documents, written as shards in ascending order of id (copies side by side) and read back; the mix
    decides what is written, its order is not kept. A null text is the end id alone."""
    return token_output(docs, vocabulary("word_bpe_49k.json"))


#: Near duplicates share so many percent of their five-word shingles.
PERCENT = 80

STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing sources", mix), ("token-ID output", token_ids)]

#: A trained network and a tokenizer are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
