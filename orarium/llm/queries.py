"""The numbered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orarium.llm.bbit_minhash import near_duplicates
from orarium.llm.compression_bands import compression_bands
from orarium.llm.fair_mix import fair_mix
from orarium.llm.kd_means import kd_means
from orarium.llm.line_chunks import run_dedup
from orarium.llm.mixture_lid import language_mixtures
from orarium.llm.oracles import ORACLE_SQL as ORACLES
from orarium.llm.pruned_graph import near_vectors
from orarium.llm.quality_net import quality_scores
from orarium.llm.repair_output import token_output
from orarium.llm.spelling_variants import spelling_variants
from orarium.llm.token_counts import token_counts
from orarium.llm.url_trees import url_verdicts
from orarium.llm.wu_manber import decontamination


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; the same place on each machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))


def op2_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_mixture_lid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixtures(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", F.array_join("langs", ",").alias("langs"))


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_dedup(table(spark, sf_dir, "documents"))


def op8_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op9_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_kd_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_means(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_compression_bands, op2_quality_net, op3_decontamination, op4_token_counts, op5_token_output, op6_mixture_lid, op7_line_chunks, op8_url_trees, op9_bbit_minhash, op10_fair_mix, op11_pruned_graph, op12_kd_filter, op13_spelling_variants)}

ORACLE_SQL: dict[str, str] = dict(ORACLES)
