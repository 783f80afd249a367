"""MinHash near-duplicates with b-bit signatures.

A document's set is its distinct five-word shingles (64-bit hashes). Equal sets are one class from the start. Of 128
minima a signature keeps the low 4 bits, in bit planes; bands of 4 whole minima give the buckets. A first round links
every class with the smallest one of its buckets where that is likely: it only joins what is plainly alike. Then all
pairs of a bucket that are still in different components are compared, without emitting them:

- in a bucket of up to `SMALL` classes by their signatures' equal lanes, counted by bit_count, with chance collisions
  taken off; pairs that reach the cut are confirmed on the full sets;
- in a larger one by signatures and full sets at once, in cells of two blocks of `BLOCK` classes: a cell gives only the links that join its
  components. Classes of the bucket's largest component are never compared with each other.

So a link is lost only by chance: at the threshold of 85 % its classes share no bucket with probability (1 - 0.85^4)^24 =
2e-8 (at 80 %, as the pipeline asks: 3e-6), and the estimate falls below the cut (19 points under the threshold, some 5
standard deviations or more) about as rarely. No bucket is too crowded. The
cost of a bucket grows with the product of its components' sizes.

Defined results: null or empty text has the empty set, n_shingles 0, and is linked with nothing; a row whose doc_id is
null is linked with nothing, has component_id null, and is kept; rows that share a doc_id are one node, with the links of
each of its texts; a text of any length is one set; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orarium.llm.common import arrow_map, batch, discard, pick, utf8, written
from orarium.llm.components import labels, stars

SHINGLE, PERCENT = 5, 85
MINIMA, BITS, BANDS, ROWS = 128, 4, 24, 4
#: Pairs whose estimate is so far below the threshold are not confirmed.
MARGIN = 0.19
#: Classes of a bucket up to which likely pairs leave it, and classes in a block of a larger one.
SMALL, BLOCK = 32, 1024
WORDS = 64
PLANES = BITS * MINIMA // WORDS
MIX = np.uint64(0xFF51AFD7ED558CCD)


class WordHashes(dict):
    """Hashes of words, looked up."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of a text with fewer words the one hash of them all."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    m = len(h) - n + 1
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
    return np.unique(out)


def permutations(count: int = MINIMA) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_08)
    return rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def minima(x: np.ndarray, by: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.full(len(by[0]), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        y = part[None, :] * by[0][:, None] + by[1][:, None]
        y ^= y >> np.uint64(31)
        np.minimum(out, y.min(axis=1), out=out)
    return mixed(out)


def planes(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bit plane after bit plane of the minima's low bits, as 64-bit numbers."""
    cut = (low[None, :] >> np.arange(bits, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(cut.astype(np.uint8).reshape(-1), bitorder="little").view("<i8")


def band_keys(x: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for k in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + x[k : bands * rows : rows])
    return out.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n, sid (digest of the set), sig and bands of each text."""
    types = {"doc_id": pa.int64(), "n": pa.int64(), "sid": pa.binary(), "sig": pa.list_(pa.int64()), "bands": pa.list_(pa.int64())}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = permutations()
        for b in batches:
            rows = []
            for data in utf8(b.column("text")):
                x = shingles(data)
                if not len(x):
                    rows.append((0, None, None, None))
                    continue
                low = minima(x, by)
                rows.append((len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), planes(low), band_keys(low)))
            yield batch(types, b.column("doc_id").cast(pa.int64()), *(map(list, zip(*rows, strict=True)) if rows else [[]] * 4))

    return arrow_map(docs, sign, "doc_id long, n long, sid binary, sig array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from equal lanes: a lane is equal where no plane differs; 2^-b of the others are equal by chance."""
    each = MINIMA // WORDS
    equal = F.lit(0)
    for w in range(each):
        differs = F.lit(0).cast("long")
        for k in range(BITS):
            differs = differs.bitwiseOR(a[k * each + w].bitwiseXOR(b[k * each + w]))
        equal = equal + F.lit(WORDS) - F.bit_count(differs)
    chance = 2.0**-BITS
    return (equal / F.lit(float(MINIMA)) - chance) / (1 - chance)


def likely(pairs: DataFrame, classes: DataFrame, cut: float) -> DataFrame:
    """The pairs (a, b) whose signatures' estimate reaches the cut."""
    sigs = classes.select("rid", "sig")
    both = pairs.join(sigs.select(F.col("rid").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("rid").alias("a"), F.col("sig").alias("sig_a")), "a")
    return both.where(estimate(F.col("sig_a"), F.col("sig_b")) >= cut).select("a", "b")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough, as links u, v; docs: doc_id, text."""
    both = pairs.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    types = {"u": pa.int64(), "v": pa.int64()}

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for b in batches:
            us, vs = [], []
            for u, v, x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), utf8(b.column("text_a")), utf8(b.column("text_b")), strict=True):
                if last is None or x != last:
                    last, left = x, shingles(x)
                right = shingles(y)
                common = len(np.intersect1d(left, right, assume_unique=True))
                if common and 100 * common >= percent * (len(left) + len(right) - common):
                    us.append(u)
                    vs.append(v)
            yield batch(types, us, vs)

    return arrow_map(both.select("a", "b", "text_a", "text_b"), confirm, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    cut = percent / 100 - MARGIN
    texts = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = written(signed(texts), "sets")
    classes = written(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("rid"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    used: list[DataFrame] = []
    members = classes.select("rid", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.min("rid").alias("a"), F.max("rid").alias("z"), F.count("*").alias("n")).where("a < z").select("key", "a", "n")
    members = written(members.join(shared, "key"), "members", used)
    # the texts that can be in a link: what the later joins move
    texts = written(texts.join(members.select(F.col("rid").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts", used)
    pairs = likely(members.where("rid <> a").select("a", F.col("rid").alias("b")).distinct(), classes, cut)
    pairs = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs", used)
    forest = stars(confirmed(pairs, texts, percent).unionByName(own_links(rows, classes)))
    more = written(small_buckets(held(members, forest, used), classes, cut).join(pairs, ["a", "b"], "left_anti"), "pairs", used)
    before, forest = forest, stars(forest.unionByName(confirmed(more, texts, percent)))
    discard(before)
    links = written(crowded_buckets(held(members, forest, used), classes, texts, percent, cut, used), "links", used)
    before, forest = forest, stars(forest.unionByName(links))
    discard(before, *used)
    known = labels(forest)
    whole = classes.join(known.withColumnRenamed("node", "rid"), "rid", "left").select("sid", F.coalesce("component", "rid").alias("component"))
    full = rows.where("sid IS NOT NULL").join(whole, "sid", "left").select("doc_id", "n", "component")
    empty = rows.where("sid IS NULL").join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", "component")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return full.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def own_links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links u, v of each id that has several sets with the representatives of their classes: rows that share an id are
    one node."""
    sets = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.bool_or(F.col("sid").isNull()).alias("empty"))
    several = sets.where("low < high OR (empty AND low IS NOT NULL)").select("doc_id")
    own = rows.where("sid IS NOT NULL").join(several, "doc_id", "left_semi").select("doc_id", "sid").distinct()
    return own.join(classes.select("sid", "rid"), "sid").select(F.col("doc_id").alias("u"), F.col("rid").alias("v"))


def held(members: DataFrame, forest: DataFrame, used: list[DataFrame]) -> DataFrame:
    """key, rid, component of the members of buckets that hold several components; most, n_most, n: the bucket's largest
    component, its classes and all classes."""
    known = labels(forest).withColumnRenamed("node", "rid")
    rows = written(members.select("key", "rid").join(known, "rid", "left").select("key", "rid", F.coalesce("component", "rid").alias("component")), "held", used)
    each = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    buckets = each.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("n")).where("n > m.c")
    return rows.join(buckets.select("key", F.col("m.component").alias("most"), F.col("m.c").alias("n_most"), "n"), "key")


def groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by it."""
    last, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in by])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[:, begin])
            if parts and key != last:
                yield pa.Table.from_batches(parts)
                parts = []
            last = key
            parts.append(b.slice(begin, end - begin))
    if parts:
        yield pa.Table.from_batches(parts)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The signatures as rows of planes."""
    return column.combine_chunks().flatten().to_numpy().reshape(-1, BITS, MINIMA // WORDS)


def alike(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """As estimate, of one signature and each of the others."""
    equal = MINIMA - np.bitwise_count(np.bitwise_or.reduce(others ^ one, axis=1).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return (equal / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS)


def in_buckets(df: DataFrame, by: tuple[str, ...], pairs_of: Callable[[pa.Table], Iterator[tuple[int, int]]], schema: str) -> DataFrame:
    """The pairs that pairs_of finds in the rows of each key."""
    a, b = (x.split()[0] for x in schema.split(", "))
    types = {a: pa.int64(), b: pa.int64()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in groups(batches, by):
            out.extend(pairs_of(group))
            if len(out) > 10_000:
                yield batch(types, *map(list, zip(*out, strict=True)))
                out = []
        yield batch(types, *(map(list, zip(*out, strict=True)) if out else [[]] * 2))

    return arrow_map(df.repartition(*by).sortWithinPartitions(*by), find, schema)


def small_buckets(members: DataFrame, classes: DataFrame, cut: float) -> DataFrame:
    """All likely pairs a < b of different components in the buckets of up to SMALL classes."""

    def pairs_of(group: pa.Table) -> Iterator[tuple[int, int]]:
        rid, component, sig = group["rid"].to_numpy(), group["component"].to_numpy(), matrix(group["sig"])
        for i in range(1, len(rid)):
            for j in np.flatnonzero((component[:i] != component[i]) & (alike(sig[i], sig[:i]) >= cut)):
                yield min(rid[i], rid[j]), max(rid[i], rid[j])

    rows = members.where(F.col("n") <= SMALL).select("key", "rid", "component").join(classes.select("rid", "sig"), "rid")
    return in_buckets(rows, ("key",), pairs_of, "a long, b long").distinct()


def full_sets(texts: DataFrame) -> DataFrame:
    """rid and set (its shingles' hashes) of each text."""
    types = {"rid": pa.int64(), "set": pa.binary()}

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(types, b.column("rid").cast(pa.int64()), [shingles(x).tobytes() for x in utf8(b.column("text"))])

    return arrow_map(texts.select("rid", "text"), sets, "rid long, set binary")


def crowded_buckets(members: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, cut: float, used: list[DataFrame]) -> DataFrame:
    """Links u, v that join all components of a bucket which have a link there, for the buckets of over SMALL classes.

    The blocks of the largest component come first (0 to d - 1) and meet only the r blocks of the rest; those meet all."""

    def links_of(group: pa.Table) -> Iterator[tuple[int, int]]:
        rid, block, sig = group["rid"].to_numpy(), group["block"].to_numpy(), matrix(group["sig"])
        now = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
        x = [np.frombuffer(s, np.uint64) for s in group["set"].to_pylist()]
        size = np.array(list(map(len, x)))
        number = np.split(np.unique(np.concatenate(x), return_inverse=True)[1], np.cumsum(size)[:-1])
        marks = np.zeros(max(int(n.max()) for n in number) + 1, bool)
        first, second = group["i"][0].as_py(), group["j"][0].as_py()
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        if len(left) > len(right):
            left, right = right, left
        for at, k in enumerate(left):
            other = left[:at] if first == second else right
            small, large = np.minimum(size[other], size[k]), np.maximum(size[other], size[k])
            other = other[(now[other] != now[k]) & (100 * small >= percent * large)]
            other = other[alike(sig[k], sig[other]) >= cut]
            if not len(other):
                continue
            marks[number[k]] = True
            for m in other:
                if now[m] != now[k]:
                    common = int(np.count_nonzero(marks[number[m]]))
                    if 100 * common >= percent * (size[k] + size[m] - common):
                        now[now == now[m]] = now[k]
                        yield rid[k], rid[m]
            marks[number[k]] = False

    rows = members.where(F.col("n") > SMALL)
    d, r = F.ceil(F.col("n_most") / BLOCK), F.ceil((F.col("n") - F.col("n_most")) / BLOCK)
    dealt = lambda n: F.pmod(F.xxhash64("rid"), n)
    in_most = F.col("component") == F.col("most")
    rows = written(rows.select("key", "rid", "component", F.when(in_most, dealt(d)).otherwise(d + dealt(r)).alias("block"), F.when(in_most, F.sequence(d, d + r - 1)).otherwise(F.sequence(F.lit(0).cast("long"), d + r - 1)).alias("meets")), "crowded", used)
    sets = written(full_sets(texts.withColumnRenamed("doc_id", "rid").join(rows.select("rid").distinct(), "rid", "left_semi")), "full-sets", used)
    cells = rows.select("key", "rid", "component", "block", F.explode("meets").alias("other")).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rid", "component", "block")
    cells = cells.join(classes.select("rid", "sig"), "rid").join(sets, "rid")
    return in_buckets(cells, ("key", "i", "j"), links_of, "u long, v long")
