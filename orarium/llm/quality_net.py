"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Random indexing: each word bucket (words are hashed into `buckets`) has a sparse random index vector of +1 and -1; a
bucket's word vector is the sum of the index vectors of its neighbours over all texts, scaled to length one. Tokens
are runs of letters and digits, and runs of marks. A document is pooled twice, over its tokens and over its distinct
buckets (rare buckets count more in the second); that and a few shape figures go to a network with one hidden layer.
A temperature, fitted on labelled rows that the network hasn't seen, calibrates its probabilities.

The vectors are gathered from all texts: each partition sums its counts, packed by block of buckets, and the blocks
are summed in two rounds, so a task holds a block's sum and not all that is sent. Network and vectors have a fixed
size. Labels come from at most `sample` rows (taken by hash) outside the held-out fold; labels, lang, source and doc_id
are no inputs of a score.

Defined results: null and empty texts are scored as texts without words; ids with labels of both kinds take the mean; of
an id with several texts the one with the smallest hash is learned from; rows without an id teach the word vectors, and
have no label; without labelled rows of both kinds the score is the smoothed share of 1 among the labels (0.5 without
any). Repeated rows are scored each; a text of any length is pooled whole; further columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orarium.llm.common import arrow_map, batch, fold, pick, utf8, written

BUCKETS, DIM, NONZERO, BLOCK = 1 << 13, 32, 4, 128
#: Labelled rows at most; hidden units; passes; where a document counts as good.
SAMPLE, HIDDEN, EPOCHS, THRESHOLD = 20_000, 32, 60, 0.7
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = zlib.crc32(word) % BUCKETS
        return value


_buckets = Buckets()


def tokens(data: bytes) -> np.ndarray:
    found = TOKEN.findall(data)
    return np.fromiter(map(_buckets.__getitem__, found), np.int64, len(found))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    rng = np.random.default_rng(1958)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def neighbour_sums(ids: np.ndarray, breaks: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What the neighbours' index vectors add to each bucket's vector; breaks: where a text starts."""
    near = np.ones(len(ids) - 1, bool)
    near[breaks[(breaks > 0) & (breaks < len(ids))] - 1] = False
    a, b = ids[:-1][near], ids[1:][near]
    out = np.zeros(BUCKETS * DIM)
    for x, y in ((a, b), (b, a)):
        for k in range(NONZERO):
            out += np.bincount(x * DIM + index[0][y, k], weights=index[1][y, k], minlength=BUCKETS * DIM)
    return out


def gather(texts: DataFrame) -> np.ndarray:
    """The word vectors, from all texts; BUCKETS x DIM numbers whatever the input's size."""
    types = {"block": pa.int32(), "part": pa.int32(), "sums": pa.binary()}
    schema = "block int, part int, sums binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros(BUCKETS * DIM)
        for b in batches:
            each = [tokens(d) for d in utf8(b.column("text"))]
            ids = np.concatenate(each) if each else np.zeros(0, np.int64)
            if len(ids) > 1:
                total += neighbour_sums(ids, np.cumsum([len(x) for x in each]), index)
        yield packed(total.reshape(-1, BLOCK * DIM), TaskContext.get().partitionId())

    def packed(blocks: np.ndarray, part: int, numbers: list[int] | None = None) -> pa.RecordBatch:
        some = [k for k in range(len(blocks)) if blocks[k].any()]
        return batch(types, [k if numbers is None else numbers[k] for k in some], [part % 64] * len(some), [zlib.compress(blocks[k].astype("<i8").tobytes(), 1) for k in some])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for block, part, s in zip(b.column("block").to_pylist(), b.column("part").to_pylist(), b.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(s), "<i8")
                sums[block, part] = sums[block, part] + x if (block, part) in sums else x
        for (block, part), x in sums.items():
            yield packed(x[None, :], part, [block])

    n = BUCKETS // BLOCK
    partial = arrow_map(arrow_map(texts, count, schema).repartition(4 * n, "block", "part"), add, schema).withColumn("part", F.lit(0))
    whole = arrow_map(partial.repartition(n, "block"), add, schema)
    out = np.zeros((n, BLOCK * DIM))
    for r in whole.select("block", "sums").collect():  # BUCKETS x DIM numbers in all
        out[r.block] = np.frombuffer(zlib.decompress(bytes(r.sums)), "<i8")
    out = out.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.hstack([out / np.maximum(norm, 1e-9), np.log1p(norm) / 10]).astype(np.float32)


def pooled(data: bytes, vectors: np.ndarray) -> np.ndarray:
    """The figures of one text that the network sees."""
    ids = tokens(data)
    n = len(ids)
    if not n:
        return np.zeros(2 * vectors.shape[1] + 6, np.float32)
    own, count = np.unique(ids, return_counts=True)
    v = vectors[own]
    mean = count.astype(np.float32) @ v / n
    plain = v.mean(axis=0)
    marks = data.translate(None, LETTERS)
    shape = [math.log1p(n) / 10, len(own) / n, math.sqrt(float((count.astype(float) ** 2).sum())) / n, len(marks) / max(1, len(data)), len(data.translate(None, UPPER)) / max(1, len(data)), float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0]
    return np.concatenate([mean, plain, np.array(shape, np.float32)])


LETTERS = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 32, 9, 10, 11, 12, 13])
UPPER = bytes([*range(65, 91)])


class Net:
    """A hidden layer of tanh units and a logistic output, trained by Adam with weight decay."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 7):
        self.hidden, self.seed, self.temperature, self.constant = hidden, seed, 1.0, None

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, decay: float = 1e-4) -> None:
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        self.w = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, 1 / math.sqrt(self.hidden), self.hidden), np.zeros(1)]
        m, s, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                w1, b1, w2, b2 = self.w
                h = np.tanh(x[part] @ w1 + b1)
                d = (1 / (1 + np.exp(-(h @ w2 + b2))) - y[part]) / len(part)
                dh = d[:, None] * w2 * (1 - h**2)
                grads = [x[part].T @ dh + decay * w1, dh.sum(axis=0), h.T @ d + decay * w2, d.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(grads):
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g**2
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss."""
        z = self.logits(x)
        loss = lambda t: np.logaddexp(0, np.where(y > 0.5, -z, z) / t).mean()
        self.temperature = float(min((0.5 * 1.1**k for k in range(32)), key=loss))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-self.logits(x.astype(float)) / self.temperature))


def features(texts: DataFrame, vectors, extra: str) -> DataFrame:
    """`extra` (a long or double column) and the pooled figures as packed float32."""
    kind = dict(texts.dtypes)[extra]

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vectors.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(extra), pa.array([pooled(d, v).tobytes() for d in utf8(b.column("text"))], pa.binary())], names=[extra, "x"])

    return arrow_map(texts.select(extra, "text"), pool, f"{extra} {kind}, x binary")


def train(texts: DataFrame, labels: DataFrame, vectors, sample: int) -> Net:
    """The network, from at most `sample` labelled rows outside the held-out fold; every fifth of them only calibrates."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    known = known.where((fold(F.col("doc_id")) != 2) & (fold(F.col("doc_id")) >= 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the broadcast side has at most `sample` rows of two numbers; one text an id, so what is collected is as small
    taught = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = features(taught.select((F.col("quality") >= 0.5).cast("double").alias("y"), "text"), vectors, "y").collect()
    x = np.array([np.frombuffer(bytes(r.x), np.float32) for r in rows], float)
    y = np.array([r.y for r in rows])
    net = Net()
    if len(y) < 10 or not 0 < y.sum() < len(y):
        net.constant = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
        return net
    order = np.lexsort([*x.T[:4], y])  # the rows' order depends on the partitions
    x, y = x[order], y[order]
    last = np.arange(len(y)) % 5 == 4
    net.fit(x[~last], y[~last])
    net.calibrate(x[last], y[last])
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every document (carry: and all columns of docs, in a struct `row`)."""
    spark = docs.sparkSession
    texts = pick(docs, doc_id=id_col, text=text_col)
    at = docs.columns.index(text_col) if carry else None
    vectors = spark.sparkContext.broadcast(gather(texts.select("text")))
    net = train(texts, pick(labels, doc_id=id_col, quality=label_col), vectors, sample)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vectors.value
        for b in batches:
            x = np.array([pooled(d, v) for d in utf8(b.column("text") if at is None else b.column("row").field(at))])
            score = pa.array(net.score(x) if len(x) else [], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("row"), score], names=["row", "score"])

    frame = docs.select(F.struct("*").alias("row")) if carry else texts.select(F.struct("doc_id").alias("row"), "text")
    out = arrow_map(frame, judge, f"row {frame.schema['row'].dataType.simpleString()}, score double")
    doc_id = F.col(f"row.`{id_col if carry else 'doc_id'}`")
    return out.select(doc_id.alias("doc_id"), (fold(doc_id) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["row"] * carry)
