"""Language ID by mixture inference: expectation-maximisation over n-gram likelihoods, language set by penalised likelihood.

Learning counts hashed letter trigrams of each language over all texts outside the held-out fold. A document's
n-grams are a mixture of the languages' distributions and of a flat one; EM estimates the proportions. Starting from
the best single language, a language joins the set while it raises the log-likelihood by more than the penalty
(PENALTY * log of the number of n-grams). The prediction is the language with the largest proportion.

N-grams are three code points: white space, digits and marks between letters are one space.

Counts leave the executors as one row for each language and block of buckets, and are summed in two rounds. The model has
BUCKETS numbers for each distinct value of lang (64 KB when broadcast, 256 KB in a Python worker), whatever the number of rows: it is the only thing
that grows with the languages, and the driver and each Python worker hold it once.

Defined results: null texts, and texts without a letter, are `und` with score 0; so is every text if nothing could be
learned. Rows with null lang or null doc_id are predicted, not learned from; ties go to the language first in order;
repeated rows count each; a text of any length is read whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orarium.llm.common import arrow_map, batch, fold, pick

BUCKETS, BLOCK = 1 << 14, 1 << 10
SMOOTH, PENALTY, ROUNDS, FLAT = 0.05, 4.0, 12, 0.02
UNKNOWN = "und"
#: What isn't a letter in a lower-cased text becomes one space.
OTHER = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> np.ndarray:
    """Hashed trigrams (code points of letters and single spaces) of a text; none without a letter."""
    plain = OTHER.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, plain)):
        return np.zeros(0, np.int64)
    x = np.frombuffer(f" {plain} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    code = (x[:-2] << np.uint64(42)) ^ (x[1:-1] << np.uint64(21)) ^ x[2:]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)


def gather(learned: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram counts, from all rows of `learned` (lang, text)."""
    types = {"lang": pa.string(), "block": pa.int32(), "part": pa.int32(), "counts": pa.binary()}
    schema = "lang string, block int, part int, counts binary"

    def packed(sums: dict[tuple[str, int, int], np.ndarray]) -> pa.RecordBatch:
        keys = list(sums)
        return batch(types, *([k[i] for k in keys] for i in range(3)), [zlib.compress(x.astype("<i8").tobytes(), 1) for x in sums.values()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if len(x := grams(text)):
                    if lang not in totals:
                        totals[lang] = np.zeros(BUCKETS, np.int64)
                    totals[lang] += np.bincount(x, minlength=BUCKETS)
        part = TaskContext.get().partitionId() % 64
        yield packed({(lang, k, part): x for lang, t in totals.items() for k, x in enumerate(t.reshape(-1, BLOCK)) if x.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        for b in batches:
            for lang, block, part, c in zip(*(b.column(n).to_pylist() for n in types), strict=True):
                x = np.frombuffer(zlib.decompress(c), "<i8")
                key = lang, block, part
                sums[key] = sums[key] + x if key in sums else x
        yield packed(sums)

    partial = arrow_map(arrow_map(learned, count, schema).repartition(256, "lang", "block", "part"), add, schema).withColumn("part", F.lit(0))
    whole = arrow_map(partial.repartition(64, "lang", "block"), add, schema)
    rows = whole.collect()  # BUCKETS numbers a language
    langs = sorted({r.lang for r in rows})
    place = {lang: k for k, lang in enumerate(langs)}
    out = np.zeros((len(langs), BUCKETS), np.float32)
    for r in rows:
        out[place[r.lang], r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(zlib.decompress(bytes(r.counts)), "<i8")
    return langs, out


class Mixture:
    def __init__(self, counts: np.ndarray):
        p = counts.astype(float) + SMOOTH
        self.p = (p / p.sum(axis=1, keepdims=True)).T.copy()  # bucket x language
        self.log = np.log(self.p)

    def fit(self, p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
        """EM: the proportions of the columns of p and of the flat part (kept at FLAT), and the log-likelihood."""
        k = p.shape[1]
        share = np.full(k, (1 - FLAT) / k)
        flat = FLAT / BUCKETS
        for _ in range(ROUNDS if k > 1 else 0):
            joint = p * share
            new = c @ (joint / (joint.sum(axis=1, keepdims=True) + flat))
            share = (1 - FLAT) * new / max(new.sum(), 1e-300)
        return share / (1 - FLAT), float(c @ np.log(p @ share + flat))

    def infer(self, ids: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The chosen languages and their proportions."""
        own, count = np.unique(ids, return_counts=True)
        c = count.astype(float)
        p = self.p[own]
        order = np.argsort(-(c @ self.log[own]), kind="stable")
        chosen = [int(order[0])]
        share, best = self.fit(p[:, chosen], c)
        penalty = PENALTY * np.log(c.sum() + 1)
        # which language would explain most of what the chosen ones explain badly
        while len(chosen) < p.shape[1]:
            now = p[:, chosen] @ (share * (1 - FLAT)) + FLAT / BUCKETS
            gain = c @ np.log((0.9 * now)[:, None] + 0.1 * p) - c @ np.log(now)
            gain[chosen] = -np.inf
            k = int(np.argmax(gain))
            more, value = self.fit(p[:, [*chosen, k]], c)
            if value - best <= penalty:
                break
            chosen, share, best = [*chosen, k], more, value
        return chosen, share


def language_mixtures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score (the proportion of lang_pred), langs and shares (the chosen set) of every document."""
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    learned = rows.where(F.col("lang").isNotNull() & ~fold(F.col("doc_id")).isin(2, -1)).select("lang", "text")
    langs, counts = gather(learned)
    bound = docs.sparkSession.sparkContext.broadcast((langs, counts))
    types = {"doc_id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64(), "langs": pa.list_(pa.string()), "shares": pa.list_(pa.float64())}

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = bound.value
        model = Mixture(table) if names else None
        for b in batches:
            found = []
            for text in b.column("text").to_pylist():
                ids = grams(text)
                if model is None or not len(ids):
                    found.append((UNKNOWN, 0.0, [], []))
                    continue
                chosen, share = model.infer(ids)
                order = np.argsort(-share, kind="stable")
                found.append((names[chosen[order[0]]], float(min(1.0, share[order[0]])), [names[chosen[i]] for i in order], share[order].tolist()))
            yield batch(types, b.column("doc_id").cast(pa.int64()), *(map(list, zip(*found, strict=True)) if found else [[]] * 4))

    out = arrow_map(rows.select("doc_id", "text"), predict, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "langs", "shares")
