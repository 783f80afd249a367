"""Operators that map over texts, against brute force on small rows with every odd case."""

import re
import zlib
from collections import Counter as Count

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orarium.llm.compression_bands import compression_bands
from orarium.llm.queries import vocabulary
from orarium.llm.repair_output import compress, document, expand, find_documents, pack, symbols_of, token_output, unpack, write_shards
from orarium.llm.token_counts import Counter, token_counts
from orarium.llm.wu_manber import decontamination, digest

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, n_words string, row int"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def rows():
    junk = "spam " * 300
    return [
        (1, prose(1, 300), "en", "x", 1),
        (2, junk, "en", None, 2),
        (3, None, None, "x", 3),
        (4, "", "en", "x", 4),
        (5, "a b c\n a b c\na b c\n\n\n#*$% <x>", None, "x", None),
        (6, prose(6, 4000) + "\n" + prose(7, 40), "de", "x", 6),
        (None, prose(8, 60), "de", "x", 6),
        (1, prose(1, 300), "en", "x", 1),
        (7, "É ß　x\x0by\x0cz <|endoftext|> l'été", "fr", "x", 7),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def same(df, expected):
    assert Count(tuple(r) for r in df.collect()) == Count(expected)


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Count(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_compression_bands(docs):
    out = compression_bands(docs)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same(out.select(columns), [(r[0], *base(r[1])) for r in rows()])
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert kept[1] and not kept[2] and not kept[3] and not kept[4]


def test_compression_rejects_noise_and_repeats(spark):
    noise = "".join(map(chr, np.random.default_rng(1).integers(33, 126, 9000)))
    noise = " ".join(noise[i : i + 20] for i in range(0, 9000, 20))
    near = "\n".join(f"{prose(3, 12)} {i}" for i in range(300))
    out = compression_bands(spark.createDataFrame([(1, noise), (2, near), (3, prose(5, 1000))], "doc_id long, text string"))
    assert [r.kept for r in out.orderBy("doc_id").collect()] == [False, False, True]


def test_compression_of_no_rows(spark):
    assert compression_bands(spark.createDataFrame([], SCHEMA)).count() == 0


def hits(text, items):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    w, hit, found = words(text), set(), set()
    for item, x in items:
        v = words(x)
        m = min(13, len(v))
        for string in {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else ():
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) == string:
                    hit |= set(range(i, i + m))
                    found.add(item)
    ids = [str(i) for i in found if i is not None]
    return len(w), len(hit), len(ids), digest(ids), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_decontamination(spark, docs, block_bytes):
    text = rows()[0][1].split()
    items = [(10, " ".join(text[20:50])), (11, "A b C!"), (12, None), (13, ""), (None, "l'été"), (14, " ".join(text[20:50])), (15, "x"), (16, prose(99, 30)), (17, "É ß")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination(docs, bench, block_bytes=block_bytes)
    same(out, [(r[0], *hits(r[1], items)) for r in rows()])


def test_decontamination_of_nothing(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination(docs, empty).where("n_hit > 0 OR contaminated").count() == 0
    assert decontamination(spark.createDataFrame([], SCHEMA), empty).count() == 0


def test_token_counts(docs):
    path = vocabulary("byte_bpe_50k.json")
    library = Counter(path).library
    n = [len(library.encode(r[1] or "", add_special_tokens=False)) for r in rows()]
    same(token_counts(docs, path, chunk=500, overlap=16), [(r[0], len((r[1] or "").encode()), k, k > 512) for r, k in zip(rows(), n, strict=True)])


def test_splicing_agrees_with_whole_texts():
    tool = Counter(vocabulary("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    letters = ["a", "b", " ", "1", "'", "\n", "\t", ".", "é", "中", " ", "　", "\x0b", "\x1c", "\x85", "$", "s", "<|endoftext|>", "  ", "\n\n", "'ll", "the"]
    for _ in range(300):
        text = "".join(rng.choice(letters, rng.integers(0, 150)))
        whole = len(tool.library.encode(text, add_special_tokens=False))
        for chunk, overlap in ((10, 3), (40, 8), (1000, 8)):
            tool.chunk, tool.overlap = chunk, overlap
            assert tool.counts([text]) == [whole]


def test_long_text_without_a_boundary():
    tool = Counter(vocabulary("byte_bpe_50k.json"), chunk=50, overlap=5)
    text = "x" * 3000
    assert tool.counts([text]) == [len(tool.library.encode(text, add_special_tokens=False))]


def test_repair_round_trip():
    rng = np.random.default_rng(4)
    parts = [np.append(rng.integers(2, 30, n), 1).astype(np.uint32) for n in (0, 5, 400, 3, 2000)]
    ids = np.concatenate(parts)
    grammar = unpack(pack(compress(ids, rules=20, least=2), block=64))
    symbols = symbols_of(grammar)
    assert len(symbols) < len(ids) and len(grammar["symbols"]) == len(grammar["block_ends"]) > 5
    assert (expand(symbols, grammar) == ids).all()
    # the grammar is complete: no pair without the end id stands twice
    pairs = Count(p for p in zip(symbols.tolist(), symbols[1:].tolist(), strict=False) if 1 not in p)
    assert max(pairs.values()) == 1
    sizes = np.array([len(p) for p in parts])
    for k, part in enumerate(parts):
        assert (document(grammar, sizes, k) == part).all()
    same_symbol = np.full(1001, 7, np.uint32)
    assert (expand(compress(same_symbol)["symbols"], compress(same_symbol)) == same_symbol).all()
    assert len(unpack(pack(compress(np.zeros(0, np.uint32))))["symbols"]) == 0


def test_token_output(docs):
    path = vocabulary("word_bpe_49k.json")
    library = Counter.__new__(Counter)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    ids = {i: library.encode(r[1] or "", add_special_tokens=False).ids + [1] for i, r in enumerate(rows())}
    order = sorted(range(len(rows())), key=lambda i: (rows()[i][0] is not None, rows()[i][0] or 0))
    expected, start = [], 0
    for i in order:
        expected.append((rows()[i][0], start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        start += len(ids[i])
    same(token_output(docs, path), expected)


def test_token_output_of_no_rows(spark):
    assert token_output(spark.createDataFrame([], SCHEMA), vocabulary("word_bpe_49k.json")).count() == 0


def test_small_shards(spark, docs, tmp_path):
    from orarium.llm.repair_output import read_documents

    path = write_shards(docs, vocabulary("word_bpe_49k.json"), f"file://{tmp_path}/shards", shard_tokens=100)
    shards = spark.read.parquet(path)
    assert shards.count() > 2
    out = read_documents(shards).orderBy("start").select("start", "n_tokens").collect()
    assert [r.start for r in out] == [sum(r.n_tokens for r in out[:k]) for k in range(len(out))]
    whole = {r.doc_id: r.ids for r in read_documents(shards).collect()}
    some = sorted(k for k in whole if k is not None)[::5]
    assert {r.doc_id: r.ids for r in find_documents(shards, some).collect()} == {k: whole[k] for k in some}


def test_word_lookup_agrees_with_whole_texts():
    from orarium.llm.repair_output import Encoder

    tool = Encoder(vocabulary("word_bpe_49k.json"))
    rng = np.random.default_rng(5)
    letters = ["a", "B", " ", "1", "'", "\n", ".", "é", "É", "中", " ", "　", "\x0b", "\x1c", "\x85", "Σ", "́", "İ", "s", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "The", "!", "-"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(2000)] + [None]
    got = tool.encode(pa.array(texts))
    assert [g.tolist() for g in got] == [tool.library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_marks_after_capitals():
    """H and a macron below compose only in lower case, and only if that comes first: such texts stay whole."""
    from orarium.llm.repair_output import Encoder

    tool = Encoder(vocabulary("word_bpe_49k.json"))
    marks = [chr(c) for c in (*range(0x300, 0x370), 0x5B0, 0x64B, 0x20D0)]
    texts = [f"x{a}{m} y" for a in "AHKJTWYi" for m in marks]
    assert [g.tolist() for g in tool.encode(pa.array(texts))] == [tool.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_columns_are_bytes(docs):
    assert dict(token_counts(docs.withColumn("n_tokens", F.lit(1)), vocabulary("byte_bpe_50k.json")).dtypes)["n_tokens"] == "bigint"
