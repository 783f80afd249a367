"""Each stage of the pipeline against brute force on its own input, and all of them in a row."""

import re
from collections import Counter as Count

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orarium.llm.oracles import ORACLE_SQL
from orarium.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    prose = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 3000, n))
    rows, labels = [], []
    for i in range(700):
        good = i % 4 > 0
        text = prose(int(rng.integers(40, 160)))
        if not good:
            text = re.sub(" ", "### ", text)
        rows.append([i, text, "en", ["a", "b", "c", None][int(rng.choice(4, p=[0.6, 0.2, 0.1, 0.1]))]])
        if i % 3:
            labels.append((i, int(good), 0))
    items = [(k, prose(30)) for k in range(5)]
    for k in range(1, 60, 7):
        rows[k][1] = f"{rows[k][1]} {items[k % 5][1]}"
    for k in range(300, 340):
        words = rows[k - 290][1].split()
        words[len(words) // 2] = "changed"
        rows[k] = [k, " ".join(words), "en", "a"]
    rows += [[900, rows[1][1], "en", "a"], [900, rows[1][1], "en", "a"], [901, None, None, None], [None, rows[2][1], "en", "b"], [902, "", "de", "a"]]
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return Count(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{sf_dir.removeprefix('file://')}/benchmark.parquet/*.parquet')")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = rows_of(docs)
        out = stage(spark, docs, sf_dir)
        assert sorted(out.columns) == sorted(COLUMNS)
        docs = corpus_pipeline.written(out, f"test-{k}")
        after = rows_of(docs)
        assert set(after) <= set(before), name
        frame = spark.createDataFrame([r for r, n in before.items() for _ in range(n)], "doc_id long, text string, lang string, source string, n_chars long").toPandas().astype({"doc_id": "Int64"})
        c.register("frame", frame)
        c.execute("CREATE OR REPLACE TABLE docs_in AS SELECT * FROM frame")
        c.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM docs_in")
        if k == 0:
            kept = sum(n for r, n in after.items() if r[0] is not None and r[0] < 700)
            assert sum("###" in (r[1] or "") for r in after) <= 3 and kept > 500
        if k == 1:
            # rows without an id are documents by their text, after all others; the stage links from 80 percent on
            c.execute("CREATE OR REPLACE VIEW documents AS SELECT DISTINCT coalesce(doc_id, 1000000 + dense_rank() OVER (ORDER BY text)) AS doc_id, text, doc_id IS NULL AS unnamed FROM docs_in")
            stay = {r[0] for r in c.execute(ORACLE_SQL["op9_bbit_minhash"].replace("85 * (", "80 * (")).fetchall() if r[3]}
            kept = Count((None if unnamed else i, text) for i, text, unnamed in c.execute("SELECT DISTINCT doc_id, text, unnamed FROM documents").fetchall() if i in stay)
            assert Count((r[0], r[1]) for r in after.elements()) == kept and corpus_pipeline.PERCENT == 80
        if k == 2:
            bad = {r[0] for r in c.execute(ORACLE_SQL["op3_decontamination"]).fetchall() if r[5]}
            assert bad and after == Count({r: n for r, n in before.items() if r[0] not in bad})
        if k == 3:
            taken = {r[0]: r[4] for r in c.execute(ORACLE_SQL["op10_fair_mix"]).fetchall()}
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            assert all(after.get(r, 0) * size(r[1]) == taken[r[0]] for r in before)


def test_the_last_stage_and_the_run(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    assert out and [r.start for r in out] == [sum(x.n_tokens for x in out[:k]) for k in range(len(out))]
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert ids == sorted(ids)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") < 800).collect()}
    assert all(r.n_tokens == 1 + len(library.encode(texts[r.doc_id] or "").ids) for r in out if r.doc_id in texts)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
