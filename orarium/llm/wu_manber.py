"""Benchmark decontamination by Wu-Manber search over words.

Windows of 13 consecutive item words (an item of fewer is one window) are the test strings. For each window length, a
shift table over hashed blocks of two words tells how far the search may skip; where it says 0, the bucket of the block's
hash gives the test strings that end so, and direct comparison confirms them. A word that no item has lets the search
skip a whole window.

Texts and items are lower-cased (A-Z) and cut into runs of digits, letters and anything beyond ASCII.

The tables are built once, on the driver, for a block of at most `block_bytes` of item text, and broadcast: flat arrays
of some 20 bytes an item word, and the words themselves. A benchmark of several blocks costs one pass over the documents
for each, written in between, so a worker never holds more than one block's tables. No shuffle.

Defined results: a null or empty text has no words, no hits, and is clean; null and empty items have no window; an
item whose id is null counts hits but isn't listed; equal items are listed each; an empty benchmark hits nothing; a text
of any length is searched whole; further columns are ignored, repeated rows give repeated rows; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orarium.llm.common import arrow_map, discard, pick, utf8, written

WINDOW, SHARE = 13, 20
BLOCK_BYTES = 16 << 20
#: A-Z become a-z, all of ASCII but digits and letters becomes a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
MULTIPLIER = 0x9E3779B1


def words_of(data: bytes) -> list[bytes]:
    return data.translate(PLAIN).split()


class Search:
    """Tables for test strings of one length: `ids` are the items' words as numbers, `starts` and `owners` the places of
    the strings and the items they are from."""

    def __init__(self, length: int, ids: np.ndarray, starts: np.ndarray, owners: np.ndarray):
        self.length, self.block = length, min(2, length)
        bits = max(10, (2 * len(starts)).bit_length())
        self.mask = (1 << bits) - 1
        last = np.full(self.mask + 1, min(255, length - self.block + 1), np.uint8)
        for end in range(self.block, length + 1):
            np.minimum.at(last, self.hashed(ids, starts + end - 1), min(255, length - end))
        self.shift = last.tobytes()
        # equal strings are one, with all their items: found by hash, confirmed word by word
        code = np.zeros(len(starts), np.uint64)
        for k in range(length):
            code = (code ^ ids[starts + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        order = np.argsort(code, kind="stable")
        fresh = np.concatenate(([True], code[order[1:]] != code[order[:-1]]))
        for k in range(length):
            fresh[1:] |= ids[starts[order[1:]] + k] != ids[starts[order[:-1]] + k]
        string = np.empty(len(starts), np.int64)
        string[order] = np.cumsum(fresh) - 1
        place = starts[order[fresh]]
        slot = self.hashed(ids, place + length - 1)
        by_slot = np.argsort(slot, kind="stable")
        rank = np.empty(len(place), np.int64)
        rank[by_slot] = np.arange(len(place))
        pairs = np.unique(rank[string] << 32 | owners)
        self.place = array("q", place[by_slot].tobytes())
        self.head = array("i", np.searchsorted(slot[by_slot], np.arange(self.mask + 2)).astype(np.int32).tobytes())
        self.owner = array("i", (pairs & 0xFFFFFFFF).astype(np.int32).tobytes())
        self.owner_head = array("i", np.searchsorted(pairs >> 32, np.arange(len(place) + 1)).astype(np.int32).tobytes())

    def hashed(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The slot of the block that ends at each place."""
        before = ids[at - 1].astype(np.int64) * MULTIPLIER if self.block == 2 else 0
        return (before + ids[at]) & self.mask

    def find(self, words: list[bytes], number, items: array, hit: bytearray, found: set[int]) -> None:
        """Marks the words of each occurrence, and adds the items it comes from. number: word -> its number, -1 if no item has it."""
        n, m, at = len(words), self.length, self.length - 1
        shift, mask, head, place, two = self.shift, self.mask, self.head, self.place, self.block == 2
        while at < n:
            here = number(words[at], -1)
            if here < 0:
                at += m
                continue
            if two:
                before = number(words[at - 1], -1)
                if before < 0:
                    at += m - 1
                    continue
                here += before * MULTIPLIER
            slot = here & mask
            if skip := shift[slot]:
                at += skip
                continue
            first, last = head[slot], head[slot + 1]
            if first < last:
                begin = at - m + 1
                window = array("i", [number(w, -1) for w in words[begin : at + 1]])
                for k in range(first, last):
                    if items[place[k] : place[k] + m] == window:
                        hit[begin : at + 1] = b"\1" * m
                        found.update(self.owner[self.owner_head[k] : self.owner_head[k + 1]])
            at += 1


class Tables:
    """All that a search for one block of items needs."""

    def __init__(self, rows: list[tuple[str | None, bytes]], window: int):
        self.names = [item for item, _ in rows]
        self.number: dict[bytes, int] = {}
        self.items = array("i")
        places: dict[int, tuple[list[int], list[int], list[int]]] = {}
        for k, (_, data) in enumerate(rows):
            words = words_of(data)
            if m := min(window, len(words)):
                begin, owner, count = places.setdefault(m, ([], [], []))
                begin.append(len(self.items))
                owner.append(k)
                count.append(len(words) - m + 1)
                self.items.extend(self.number.setdefault(w, len(self.number)) for w in words)
        ids = np.array(self.items, np.int32)
        self.searches = []
        for m, (begin, owner, count) in places.items():
            n = np.array(count)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.searches.append(Search(m, ids, np.repeat(begin, n) + within, np.repeat(owner, n)))

    def search(self, words: list[bytes], hit: bytearray, names: set[str]) -> None:
        found: set[int] = set()
        for s in self.searches:
            s.find(words, self.number.get, self.items, hit, found)
        names.update(self.names[k] for k in found if self.names[k] is not None)


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of bounded size, one at a time; how many is found from their total size."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for k in range(n):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(i, (t or "").encode()) for i, t in part.select(F.col("item_id").cast("string"), "text").collect()]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of docs in a struct `row`, with n_words, n_hit and item_ids (sorted as strings)."""
    spark = docs.sparkSession
    items = pick(benchmark, item_id=item_col, text=item_text_col)
    text = docs.columns.index(text_col)
    frame = docs.select(F.struct("*").alias("row"), F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("found"))

    def search(bound):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = bound.value
            for b in batches:
                hits, founds = [], []
                for data, before, ids in zip(utf8(b.column("row").field(text)), b.column("hit").to_pylist(), b.column("found").to_pylist(), strict=True):
                    words = words_of(data)
                    hit, found = bytearray(before or bytes(len(words))), set(ids or ())
                    tables.search(words, hit, found)
                    hits.append(bytes(hit))
                    founds.append(sorted(found))
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(hits, pa.binary()), pa.array(founds, pa.list_(pa.string()))], names=["row", "hit", "found"])

        return run

    before = None
    for k, rows in enumerate(item_blocks(items, block_bytes)):
        if k:
            frame = written(frame, "hits")
            if before is not None:
                discard(before)
            before = frame
        frame = arrow_map(frame, search(spark.sparkContext.broadcast(Tables(rows, window))), frame.schema)
    clean = F.regexp_replace(F.hex("hit"), "00", "")
    return frame.select("row", F.octet_length("hit").cast("long").alias("n_words"), (F.length(clean) / 2).cast("long").alias("n_hit"), F.col("found").alias("item_ids"))


def contaminated(n_hit, n_words, share: int = SHARE):
    return (n_hit > 0) & (share * n_hit >= n_words)


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = benchmark_hits(pick(docs, doc_id=id_col, text=text_col), benchmark, **options)
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()
