"""Token-ID output: shards of ids compressed by a Re-Pair grammar, with random access.

Documents are range-sorted by id, encoded, and gathered into shards of about `shard_tokens` ids (a document is never
split). In each shard, rounds replace the most frequent pairs of neighbouring symbols by nonterminals, left to right,
until no pair is found LEAST times (a rule for fewer costs more than it saves); a pair never holds the end id, so no
phrase crosses a document. A shard is one row of a table in the shared folder:

    part, seq      place in the order; rel_start: ids of the part before the shard
    doc_ids        int64 ids (and a null mask), doc_tokens: int64 lengths with the end id
    left, right    uint32 pairs of the rules; rule k makes symbol base + k
    rounds         uint32 number of rules made up to each round's end
    lengths        uint32 expansion lengths of the rules
    symbols        uint32 sequence of ids and nonterminals, in zlib-packed blocks of BLOCK symbols
    block_ends     uint32 ids up to the end of each block

all little-endian. Lengths give each symbol's place in the ids, so one document is decoded from its own blocks alone.

Defined results: null or empty text is the end id alone; a null doc_id sorts first and stays null; equal ids are
ordered by the text's hash, repeated rows are written each; a text of any length is one document of one shard; further
columns are ignored; an empty table writes an empty table.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orarium.llm.common import arrow_map, batch, partitions_for, pick, scratch

END_ID = 1
#: Ids of a shard, rules that one round makes at most, how often a pair must occur, and symbols of a packed block.
SHARD_TOKENS, RULES, LEAST, BLOCK = 1 << 20, 1 << 14, 8, 1 << 14
#: Distinct words that a Python worker remembers.
REMEMBERED = 500_000
#: A mark after an ASCII letter begins a piece of its own (an apostrophe may not), so a space between them changes nothing.
CUT = r"([a-z])([!-&(-/:-@\[-`{-~])", r"\1 \2"


class Encoder:
    """Ids of whole texts by a tokenizer that drops white space and lower-cases, so that words can be looked up.

    A tokenizer for which the probes show otherwise encodes each text in one call."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        ids = lambda x: self.library.encode(x, add_special_tokens=False).ids
        self.by_word = ids("ab Cd,.\n ef7") == ids("ab") + ids("cd") + ids(",.") + ids("ef") + ids("7")
        #: Lower-case ASCII letters are one piece for the model, unchanged by what comes before it.
        self.straight = all(ids(x) == [t.id for t in self.library.model.tokenize(x)] for x in ("a", "the", "straightforward", "qzxjvwkq"))

    def library_ids(self, words: list[bytes]) -> list[bytes]:
        made = self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in made]

    def learn(self, words: list[bytes]) -> None:
        """Looks up new words: plain ones at the model, others through all steps of the library."""
        known, model = self.known, self.library.model.tokenize
        plain = [w for w in words if self.straight and w.isalpha()]
        known.update((w, array("I", [t.id for t in model(w.decode())]).tobytes()) for w in plain)
        rest = list(set(words).difference(plain))
        known.update(zip(rest, self.library_ids(rest), strict=True))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. A text with a special token's string, in any case, is one call of the library; so is one
        with a combining mark after a capital, which may compose only after lower-casing."""
        texts = texts.cast(pa.string()).fill_null("")
        whole = pc.match_substring_regex(texts, r"[A-Z]\p{M}") if self.by_word else pa.array([True] * len(texts))
        for token in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, token, ignore_case=True))
        out = iter(self.by_words(texts.filter(pc.invert(whole))))
        alone = iter(self.library_ids([t.encode() for t in texts.filter(whole).to_pylist()]))
        return [np.frombuffer(next(alone), "<u4") if w else next(out) for w in whole.to_pylist()]

    def by_words(self, texts: pa.Array) -> list[np.ndarray]:
        """Each distinct word of the batch is looked up once."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        texts = pc.replace_substring_regex(pc.ascii_lower(texts), *CUT)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        unique, known = coded.dictionary.cast(pa.binary()).to_pylist(), self.known
        self.learn(list(set(unique).difference(known)))
        values = [known[w] for w in unique]
        flat = np.frombuffer(b"".join(values), "<u4")
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        at = coded.indices.to_numpy()
        n, ends = size[at], np.cumsum(size[at])
        first = (np.cumsum(size) - size)[at]
        ids = flat[np.repeat(first - ends + n, n) + np.arange(int(n.sum()))]
        edges = np.concatenate(([0], ends))[np.asarray(words.offsets) - words.offsets[0].as_py()]
        return [ids[b:e] for b, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pairs_of(x: np.ndarray, end_id: int) -> np.ndarray:
    """Neighbours as one number each; 0 where a pair would hold the end id (that pair is never replaced)."""
    code = (x[:-1].astype(np.uint64) << np.uint64(32)) | x[1:]
    code[(x[:-1] == end_id) | (x[1:] == end_id)] = np.uint64(end_id) << np.uint64(32) | np.uint64(end_id)
    return code


SLOTS = 1 << 18


def slots(code: np.ndarray) -> np.ndarray:
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


def compress(ids: np.ndarray, end_id: int = END_ID, rules: int = RULES, least: int = LEAST) -> dict[str, np.ndarray]:
    """The grammar of a shard: replaces the most frequent pairs, counts again, until none is frequent."""
    x = ids.astype(np.uint32)
    base = int(x.max(initial=0)) + 1
    left, right, ends = [], [], []
    lengths = np.zeros(0, np.uint32)
    never = np.uint64(end_id) << np.uint64(32) | np.uint64(end_id)
    while len(x) > 1:
        code = pairs_of(x, end_id)
        order = np.sort(code)
        first = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        count = np.diff(np.append(first, len(order)))
        ok = (count >= least) & (order[first] != never)
        found, count = order[first][ok], count[ok]
        if not len(found):
            break
        top = found[np.lexsort((found, -count))[:rules]]
        slot, number = np.unique(slots(top), return_index=True)  # of pairs that share a slot one waits for the next round
        top = top[number]
        table = np.zeros(SLOTS, np.int32)
        table[slot] = np.arange(len(top))
        at = table[slots(code)]
        here = top[at] == code
        # of neighbouring matches every other one is replaced, from the left
        where = np.flatnonzero(here)
        if not len(where):
            break
        begin = np.concatenate(([True], np.diff(where) > 1))
        run = np.maximum.accumulate(np.where(begin, where, 0))
        take = where[(where - run) % 2 == 0]
        made = base + sum(map(len, left))
        x = x.copy()
        x[take] = (made + at[take]).astype(np.uint32)
        stay = np.ones(len(x), bool)
        stay[take + 1] = False
        x = x[stay]
        left.append((top >> np.uint64(32)).astype(np.uint32))
        right.append((top & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        ends.append(made - base + len(top))
        lengths = np.concatenate((lengths, length_of(left[-1], base, lengths) + length_of(right[-1], base, lengths))).astype(np.uint32)
    none = np.zeros(0, np.uint32)
    return {"base": np.array([base], np.uint32), "left": np.concatenate([none, *left]), "right": np.concatenate([none, *right]), "rounds": np.array(ends, np.uint32), "lengths": lengths, "symbols": x}


def length_of(x: np.ndarray, base: int, lengths: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), np.int64)
    deep = x >= base
    out[deep] = lengths[x[deep] - base]
    return out


def expand(x: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
    """Ids of a run of symbols: the rules of the last round are undone first."""
    base, ends = int(g["base"][0]), [0, *map(int, g["rounds"])]
    for low in reversed(ends[:-1]):
        deep = x >= base + low
        out = np.repeat(x, np.where(deep, 2, 1))
        at = np.flatnonzero(deep) + np.arange(deep.sum())
        rule = x[deep] - base
        out[at], out[at + 1] = g["left"][rule], g["right"][rule]
        x = out
    return x


RULE_PARTS = ("base", "left", "right", "rounds", "lengths")
GRAMMAR = (*RULE_PARTS, "block_ends", "symbols")


def pack(g: dict[str, np.ndarray], block: int = BLOCK) -> list:
    """The values of a shard's columns: rules and lengths plain, symbols in blocks that are unpacked alone."""
    x = g["symbols"].astype("<u4")
    ends = np.cumsum(length_of(x, int(g["base"][0]), g["lengths"]))
    cuts = range(0, len(x), block)
    block_ends = ends[[min(at + block, len(x)) - 1 for at in cuts]] if len(x) else ends
    return [*(g[k].astype("<u4").tobytes() for k in RULE_PARTS), block_ends.astype("<u4").tobytes(), [zlib.compress(x[at : at + block].tobytes(), 1) for at in cuts]]


def unpack(values: list) -> dict:
    """The grammar of a shard; its blocks of symbols stay packed."""
    return {k: v if k == "symbols" else np.frombuffer(v, "<u4") for k, v in zip(GRAMMAR, values, strict=True)}


def symbols_of(g: dict, first: int = 0, last: int | None = None) -> np.ndarray:
    """The symbols of the blocks from first to before last."""
    return np.frombuffer(b"".join(map(zlib.decompress, g["symbols"][first:last])), "<u4")


def document(g: dict, doc_tokens: np.ndarray, k: int) -> np.ndarray:
    """Random access: the ids of the k-th document of a shard, from its own symbols in its own blocks."""
    begin, size = int(doc_tokens[:k].sum()), int(doc_tokens[k])
    first, last = np.searchsorted(g["block_ends"], [begin, begin + size - 1], "right")
    x = symbols_of(g, first, last + 1)
    begin -= int(g["block_ends"][first - 1]) if first else 0
    ends = np.cumsum(length_of(x, int(g["base"][0]), g["lengths"]))
    low, high = np.searchsorted(ends, [begin, begin + size - 1], "right")
    return expand(x[low : high + 1], g)


COLUMNS = {**{k: pa.binary() for k in GRAMMAR}, "symbols": pa.list_(pa.binary())}
SHARD = {"part": pa.int32(), "seq": pa.int32(), "rel_start": pa.int64(), "n_docs": pa.int64(), "n_tokens": pa.int64(), "doc_ids": pa.binary(), "doc_nulls": pa.binary(), "doc_tokens": pa.binary(), **COLUMNS}
SHARD_SCHEMA = "part int, seq int, rel_start long, n_docs long, n_tokens long, doc_ids binary, doc_nulls binary, doc_tokens binary, " + ", ".join(f"`{k}` binary" for k in GRAMMAR[:-1]) + ", symbols array<binary>"


def keys_of(row: dict) -> list[int | None]:
    return [None if gone else k for k, gone in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), row["doc_nulls"], strict=True)]


def write_shards(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> str:
    """Writes the shards of all texts, in ascending order of id, as a table at `path`; returns the path. One shuffle: the range sort."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, seq, rel = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], np.uint32)
        ids: list = []
        held: list[np.ndarray] = []
        size = 0

        def shard() -> pa.RecordBatch:
            x = np.concatenate(held)
            keys = np.array([k or 0 for k in ids], "<i8").tobytes()
            nulls = np.array([k is None for k in ids], np.uint8).tobytes()
            lengths = np.array([len(h) for h in held], "<i8").tobytes()
            return batch(SHARD, [part], [seq], [rel], [len(held)], [len(x)], [keys], [nulls], [lengths], *[[v] for v in pack(compress(x, end_id))])

        for b in batches:
            for k, x in zip(b.column("doc_id").cast(pa.int64()).to_pylist(), tool.encode(b.column("text")), strict=True):
                ids.append(k)
                held.append(np.concatenate((x, end)))
                size += len(x) + 1
                if size >= shard_tokens:
                    yield shard()
                    seq, rel, size, ids, held = seq + 1, rel + size, 0, [], []
        if held:
            yield shard()

    columns = pick(docs, doc_id=id_col, text=text_col)
    n = partitions_for(columns.sparkSession, columns.agg(F.sum(F.octet_length("text"))).first()[0])
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    placed = columns.repartitionByRange(n, *order).sortWithinPartitions(*order)
    arrow_map(placed, encode, SHARD_SCHEMA).write.parquet(path)
    return path


def read_documents(shards: DataFrame, ids: bool = True) -> DataFrame:
    """One row for each document of the shards: doc_id, start (ids before it in the whole output), n_tokens, and the ids
    (binary, uint32) or their crc32, all decoded from the grammar."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each partition that wrote, not for each document
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("part_start"))
    types = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()} | ({"ids": pa.binary()} if ids else {"ids_crc32": pa.int64()})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # a worker that has encoded before needs its words no more
        pa.default_memory_pool().release_unused()
        for b in batches:
            for i in range(b.num_rows):
                row = {k: v[0] for k, v in b.slice(i, 1).to_pydict().items()}
                g = unpack([row[k] for k in GRAMMAR])
                data = memoryview(expand(symbols_of(g), g).astype("<u4").tobytes())
                sizes = np.frombuffer(row["doc_tokens"], "<i8")
                ends = np.cumsum(sizes)
                own = (data[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True))
                yield batch(types, keys_of(row), ends - sizes + row["rel_start"] + row["part_start"], sizes, [bytes(x) if ids else zlib.crc32(x) for x in own])

    return arrow_map(shards.join(F.broadcast(before), "part"), decode, "doc_id long, start long, n_tokens long, " + ("ids binary" if ids else "ids_crc32 long"))


def find_documents(shards: DataFrame, wanted: list[int]) -> DataFrame:
    """doc_id and ids (binary, uint32) of some documents, each decoded from its own blocks; wanted: ids that fit in a task."""
    asked = frozenset(wanted)
    types = {"doc_id": pa.int64(), "ids": pa.binary()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: v[0] for k, v in b.slice(i, 1).to_pydict().items()}
                places = [(k, doc_id) for k, doc_id in enumerate(keys_of(row)) if doc_id in asked]
                if places:
                    g, sizes = unpack([row[k] for k in GRAMMAR]), np.frombuffer(row["doc_tokens"], "<i8")
                    yield batch(types, [doc_id for _, doc_id in places], [document(g, sizes, k).astype("<u4").tobytes() for k, _ in places])

    return arrow_map(shards, decode, "doc_id long, ids binary")


def token_output(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all texts, reads the files back, and gives doc_id, start, n_tokens and ids_crc32 of each document."""
    spark = docs.sparkSession
    path = write_shards(docs, tokenizer, scratch(spark, "token-ids"), id_col, text_col)
    return read_documents(spark.read.parquet(path), ids=False)
