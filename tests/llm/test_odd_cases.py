"""Every operator on one table of odd rows: nulls, empty and very long texts, repeated rows, columns of clashing names."""

import re
from collections import Counter as Count

import numpy as np
import pytest

import corpus_pipeline
from orarium.llm import bbit_minhash, compression_bands, fair_mix, line_chunks, mixture_lid, quality_net, repair_output, token_counts, url_trees, wu_manber
from orarium.llm.common import BATCH_BYTES, BATCH_ROWS
from orarium.llm.queries import vocabulary

LONG = " ".join(f"word{k % 7919 * 31 % 100_003}" + (".\n" if k % 11 == 0 else "") for k in range(500_000))
SHORT = "One plain sentence about the sea, and another one about the hills. " * 3
ROWS = [(1, LONG, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "de", "b"), (5, SHORT, "en", "b"), (5, SHORT, "en", "b"), (6, SHORT, "de", None), (None, SHORT, "en", "a"), (None, None, None, None), (7, "é" * 40, "el", "c")]
EXTRA = "row struct<a: int>, score string, kept string, key binary, hit int, size string, z int, part string, begin string"


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > 5_000_000
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", *(f"CAST(NULL AS {kind}) AS `{name}`" for name, kind in (c.strip().split(" ", 1) for c in EXTRA.split(", ")))).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0, "x") for k in range(1, 8)] + [(None, 1, 0, "x"), (5, None, 0, "x")], "doc_id long, quality int, toxic int, text string")


def ids(rows):
    return Count(r.doc_id for r in rows)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_all_rows_come_back(spark, docs, labels):
    benchmark = spark.createDataFrame([(1, " ".join(LONG.replace(".", " ").split()[200_000:200_040])), (2, None), (None, "")], "item_id long, text string")
    bpe, wordpiece = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
    made = {
        "op1": compression_bands.compression_bands(docs),
        "op2": quality_net.quality_scores(docs, labels),
        "op3": wu_manber.decontamination(docs, benchmark),
        "op4": token_counts.token_counts(docs, bpe),
        "op5": repair_output.token_output(docs, wordpiece),
        "op6": mixture_lid.language_mixtures(docs),
        "op7": line_chunks.run_dedup(docs),
        "op9": bbit_minhash.near_duplicates(docs),
        "op10": fair_mix.fair_mix(docs),
    }
    got = {name: df.collect() for name, df in made.items()}
    for name, rows in got.items():
        assert ids(rows) == Count(r[0] for r in ROWS), name
    of = lambda name, doc_id: next(r for r in got[name] if r.doc_id == doc_id)
    long_words, library = words(LONG), lambda path: __import__("tokenizers").Tokenizer.from_file(path)
    assert of("op1", 1).n_words == len(long_words) and of("op1", 1).word_chars == sum(map(len, long_words))
    assert of("op1", 2).base_failed and of("op1", 3).n_words == of("op1", 4).n_words == 0
    assert all(0 <= r.score <= 1 for r in got["op2"])
    assert of("op3", 1).n_hit >= 40 and of("op3", 1).n_items == 1 and not of("op3", 1).contaminated and of("op3", 2).n_words == 0
    assert of("op4", 1).n_tokens == len(library(bpe).encode(LONG, add_special_tokens=False).ids) and of("op4", 3).n_tokens == 0
    assert of("op5", 1).n_tokens == 1 + len(library(wordpiece).encode(LONG, add_special_tokens=False).ids) and of("op5", 2).n_tokens == 1
    assert of("op6", 2).lang_pred == of("op6", 4).lang_pred == "und" and of("op6", 7).lang_pred != "und"
    assert of("op7", 2).text is None and of("op7", 3).text == "" and of("op7", 7).text == "é" * 40
    assert of("op9", 1).n_shingles == len({tuple(long_words[k : k + 5]) for k in range(len(long_words) - 4)}) and of("op9", 6).component_id == 5
    assert of("op9", 3).component_id == 3 and all(r.kept for r in got["op9"] if r.doc_id is None)
    assert of("op10", 1).size == len(long_words) and of("op10", 2).size == 0


def test_pipeline_on_odd_rows(spark, docs, labels, tmp_path):
    path = f"file://{tmp_path}"
    docs.write.parquet(f"{path}/documents.parquet")
    labels.select("doc_id", "quality", "toxic").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "not in any text at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        now = rows
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, path)
            assert now.count() <= 3 * len(ROWS) and (rows is docs or now.count() == 0)
            if set(docs.columns) <= set(now.columns):
                now = corpus_pipeline.written(now, "odd")


def test_urls_on_odd_rows(spark):
    rows = [(1, "http://x.org/" + "a/" * 2_500_000, "v"), (2, None, "v"), (2, None, "v"), (None, "", "v"), (3, "http://com/" * 3, "v")]
    out = url_trees.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, verdict string").selectExpr("*", "'n' AS host", "1 AS fold", "2 AS n")).collect()
    assert Count(r.page_id for r in out) == Count(r[0] for r in rows) and max(len(r.path) for r in out) == 5_000_001


def test_rows_that_share_an_id_are_one_node(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    rows = [(3, a), (5, a), (5, b), (4, b), (5, ""), (6, ""), (6, None), (None, a)]
    out = bbit_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(3, 3), (4, 3), (5, 3), (6, 6), (None, None)}
    assert Count(r.kept for r in out) == Count({True: 4, False: 4})


def test_line_dedup_does_not_look_at_the_order_of_rows(spark):
    rng = np.random.default_rng(3)
    line = lambda n: " ".join(f"l{k}" for k in rng.integers(0, 100_000, n))
    passages = [[line(20) for _ in range(4)] for _ in range(6)]
    rows = [(k // 2, "\n".join([line(9), *passages[k % 6], line(9)])) for k in range(24)]
    results = [Count(tuple(r) for r in line_chunks.run_dedup(spark.createDataFrame(part, "doc_id long, text string").repartition(n)).collect()) for part, n in ((rows, 1), (rows[::-1], 4))]
    assert results[0] == results[1]
    # brute force without the chunker: each line of a passage stays once
    left = Count(x for r, n in results[0].items() for x in (r[1] or "").split("\n") for _ in range(n))
    assert all(left[x] == 1 for p in passages for x in p) and sum(left.values()) == 24 * 2 + 24


def test_a_null_id_is_a_document_by_its_text(spark, tmp_path):
    rows = [(None, SHORT, "en"), (None, SHORT, "de"), (None, SHORT + "more words here", "en"), (9, LONG[:3000], "en"), (None, LONG[:3000], "en"), (None, None, "en"), (8, "", "en"), (8, "", "de")]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert Count((r.doc_id, r.text) for r in out if r.text == LONG[:3000]) == Count({(9, LONG[:3000]): 1})
    assert sum(r.text is not None and r.text.startswith(SHORT) for r in out) == 1 and sum(not r.text for r in out) == 2


def test_batches_stay_small(spark, docs):
    compression_bands.compression_bands(docs)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS and BATCH_BYTES <= 64 << 20
