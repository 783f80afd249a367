"""Line dedup by content-defined chunks: globally repeated runs of lines are removed, all but the first.

A rolling hash over the last two lines' hashes ends a chunk where it is 0 modulo `mean_lines`, so a run of lines that
stands in several texts is cut alike in each, wherever it stands. A line of `long_words` words or more is a chunk of
its own (the one line is then the passage), and a chunk has at most `most_lines` lines. Chunks of two lines with text,
or of one long line, count as repeated if an equal chunk stands anywhere else.

`line_dedup` removes whole chunks. `run_dedup`, the query, finds every repeated run of `long_words` words or more,
wherever it is cut, from denser chunks, the anchors: of each shortest stretch of `ANCHOR_WORDS` words or more the line
whose rolling hash is smallest ends one, and a line that has so many words is one by itself. What lies outside of a run
moves only the boundaries at its ends, so a repeated run of 50 words, whatever surrounds it, holds an anchor that repeats
(proof at `anchors`). Only where an anchor stands elsewhere too is it extended line by line to both sides, to the fewest
lines onward or backward that have `long_words` words and hold it; these windows depend on nothing outside of them, so
equal runs have equal windows, and the windows inside a run cover it whole (but for blank lines at its ends). A line goes
if it is in a chunk or window that stands earlier too; lines that the earlier one itself holds stay.

One pass packs each text (zstandard) beside the places and 128-bit digests of its candidates. Digests are counted with
partial sums and give the first place of each: the smallest doc_id, then the text's hash, so rows in another order give
the same result. Candidates of one text that repeat one stretch of one earlier text are joined to a run; only then texts
move, packed, to where their bytes are compared: what a run says was there before, cut out of the earlier text, and the
text itself. These are sort-merge joins, alike at every size, in which Spark splits hot digests and hot first texts;
`broadcast_bytes` lets a caller have what repeats broadcast while it is no larger.

Defined results: null text stays null, with no lines; empty text is one empty line; a null doc_id comes first; rows
that share a doc_id are texts of their own; further columns are ignored. A text may end up empty. One text is held by
one task at a time, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orarium.llm.common import arrow_map, batch, discard, pick, written

MEAN_LINES, MOST_LINES, LONG_WORDS = 4, 32, 50
#: Words of a stretch that has an anchor's end; at most a quarter of LONG_WORDS, or short runs may have none.
ANCHOR_WORDS = 12
BROADCAST_BYTES = 0


def chunks(lines: list[bytes], mean_lines: int = MEAN_LINES, most_lines: int = MOST_LINES, long_words: int = LONG_WORDS) -> list[tuple[int, int, bool]]:
    """begin, end and whether it may be removed, of each chunk."""
    import xxhash

    out, begin, before = [], 0, 0

    def close(end: int, long: bool = False) -> None:
        nonlocal begin
        if end > begin:
            out.append((begin, end, long or sum(map(bool, map(bytes.strip, lines[begin:end]))) > 1))
            begin = end

    for i, line in enumerate(lines):
        h = xxhash.xxh64_intdigest(line)
        if len(line) >= 2 * long_words - 1 and len(line.split()) >= long_words:
            close(i)
            close(i + 1, True)
        elif (before * 0x9E3779B97F4A7C15 + h) >> 7 & 0xFFFFFFFF < 0x100000000 // mean_lines or i + 1 - begin >= most_lines:
            close(i + 1)
        before = h
    close(len(lines))
    return out


def anchors(lines: list[bytes], least: int = ANCHOR_WORDS) -> list[tuple[int, int, int]]:
    """begin, end and hash of the anchors: chunks that end where a rolling hash over two lines is smallest.

    From each line the shortest stretch of `least` words or more gives one end, at its smallest hash (the last of equal
    ones). A run of 4 * least + 2 words or more of shorter lines than that has, after its first line (whose hash depends
    on the line before), two stretches that don't overlap; they give two ends, y and z. A stretch that begins before the
    run sees a part of the first of them, so it can add an end only up to y; one that goes on after the run, from z on
    only. So between y and z the run is cut alike wherever it stands. Blank lines are passed over."""
    import xxhash

    count = [len(x.split()) for x in lines]
    rows = [i for i, n in enumerate(count) if n]
    hashes, before = [], 0
    for i in rows:
        h = xxhash.xxh64_intdigest(lines[i])
        hashes.append((before * 0x9E3779B97F4A7C15 + h) * 0xFF51AFD7ED558CCD >> 8 & 0xFFFFFFFFFFFF)
        before = h
    ends, begins, queue, head, last, have = set(), set(), [], 0, 0, 0
    for first, i in enumerate(rows):
        while last < len(rows) and have < least:
            while len(queue) > head and hashes[queue[-1]] >= hashes[last]:
                queue.pop()
            queue.append(last)
            have += count[rows[last]]
            last += 1
        if have < least:
            break
        ends.add(rows[queue[head]] + 1)
        if count[i] >= least:
            begins.add(i)
            ends.add(i + 1)
        have -= count[i]
        if queue[head] == first:
            head += 1
    cuts = sorted({0, len(lines)} | ends | begins)
    spans = [(b, e) for b, e in zip(cuts, cuts[1:], strict=False) if any(count[b:e])]
    return [(b, e, xxhash.xxh64_intdigest(b"\n".join(lines[b:e]).strip(b"\n")) - (1 << 63)) for b, e in spans]


def windows(lines: list[bytes], long_words: int = LONG_WORDS) -> set[tuple[int, int]]:
    """begin, end of the shortest runs of lines from each line, and up to each line, with `long_words` words or more."""
    count = [len(x.split()) for x in lines]
    before = [0, *accumulate(count)]
    out, end, begin = set(), 0, 0
    for i in range(len(lines)):
        while end < len(lines) and before[end] - before[i] < long_words:
            end += 1
        if count[i] and before[end] - before[i] >= long_words:
            out.add((i, end))
        while before[i + 1] - before[begin + 1] >= long_words:
            begin += 1
        if count[i] and before[i + 1] - before[begin] >= long_words:
            out.add((begin, i + 1))
    return out


def packed(texts: DataFrame, cut, anchor) -> DataFrame:
    """uid of the row, doc_id, tie (the text's hash), z (the packed text), the spans (begin, end, digest) that cut finds, and
    the anchors (begin, end, hash) that `anchor` finds."""
    span = pa.struct({"begin": pa.int32(), "end": pa.int32(), "digest": pa.binary()})
    anchored = pa.struct({"begin": pa.int32(), "end": pa.int32(), "hash": pa.int64()})
    types = {"uid": pa.int64(), "doc_id": pa.int64(), "tie": pa.int64(), "z": pa.binary(), "spans": pa.list_(span), "anchors": pa.list_(anchored)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").cast(pa.int64()).to_pylist(), b.column("text").to_pylist(), strict=True):
                if text is None:
                    rows.append((uid, doc_id, 0, None, [], []))
                else:
                    data = text.encode()
                    lines = data.split(b"\n")
                    digest = lambda at: hashlib.blake2b(b"\n".join(lines[at[0] : at[1]]), digest_size=16).digest()  # noqa: B023, E731
                    rows.append((uid, doc_id, xxhash.xxh64_intdigest(data) >> 1, press(data), [(*at, digest(at)) for at in cut(lines)], anchor(lines)))
                uid += 1
            yield batch(types, *(map(list, zip(*rows, strict=True)) if rows else [[]] * 6))

    return arrow_map(texts, pack, "uid long, doc_id long, tie long, z binary, spans array<struct<begin: int, `end`: int, digest: binary>>, anchors array<struct<begin: int, `end`: int, hash: bigint>>")


def extended(texts: DataFrame, cut, long_words: int) -> DataFrame:
    """uid, doc_id, tie, begin, end, digest of the windows that hold an anchor which stands elsewhere too, but for those
    that cut finds."""
    each = texts.select("uid", F.inline("anchors"))
    repeated = each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    found = each.join(repeated.hint("merge"), "hash").groupBy("uid").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    types = {"uid": pa.int64(), "doc_id": pa.int64(), "tie": pa.int64(), "begin": pa.int32(), "end": pa.int32(), "digest": pa.binary()}

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for uid, doc_id, tie, z, held in zip(*(b.column(c).to_pylist() for c in ("uid", "doc_id", "tie", "z", "found")), strict=True):
                lines = unpack(z).split(b"\n")
                # the last begin of an anchor that ends by each place: a window holds one if that is not before its own begin
                latest = [-1] * (len(lines) + 1)
                for a in held:
                    latest[a["end"]] = max(latest[a["end"]], a["begin"])
                latest = list(accumulate(latest, max))
                rows = [(uid, doc_id, tie, begin, end, hashlib.blake2b(b"\n".join(lines[begin:end]), digest_size=16).digest()) for begin, end in sorted(windows(lines, long_words) - set(cut(lines))) if latest[end] >= begin]
                if rows:
                    yield batch(types, *map(list, zip(*rows, strict=True)))

    both = texts.select("uid", "doc_id", "tie", "z").join(found.hint("merge"), "uid")
    return arrow_map(both, extend, "uid long, doc_id long, tie long, begin int, end int, digest binary")


def stretches(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """first_uid, first_begin, first_end and first_z: the wanted stretches cut out of their texts, packed."""
    types = {"first_uid": pa.int64(), "first_begin": pa.int32(), "first_end": pa.int32(), "first_z": pa.binary()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        for b in batches:
            for uid, z, places in zip(b.column("uid").to_pylist(), b.column("z").to_pylist(), b.column("places").to_pylist(), strict=True):
                lines = unpack(z).split(b"\n")
                rows = [(uid, p["first_begin"], p["first_end"], press(b"\n".join(lines[p["first_begin"] : p["first_end"]]))) for p in places]
                yield batch(types, *map(list, zip(*rows, strict=True)))

    by_text = wanted.groupBy(F.col("first_uid").alias("uid")).agg(F.collect_list(F.struct("first_begin", "first_end")).alias("places"))
    return arrow_map(texts.select("uid", "z").join(by_text, "uid"), cut, "first_uid long, first_begin int, first_end int, first_z binary")


def deduplicated(docs: DataFrame, runs: bool, id_col: str, text_col: str, mean_lines: int, most_lines: int, long_words: int, broadcast_bytes: int) -> DataFrame:
    def candidates(lines: list[bytes]) -> list[tuple[int, int]]:
        return sorted((begin, end) for begin, end, may in chunks(lines, mean_lines, most_lines, long_words) if may)

    def side(df: DataFrame, size: Column) -> DataFrame:
        return F.broadcast(df) if broadcast_bytes and (df.agg(F.sum(size)).first()[0] or 0) <= broadcast_bytes else df.hint("merge")

    texts = written(packed(pick(docs, doc_id=id_col, text=text_col), candidates, (lambda lines: anchors(lines, min(ANCHOR_WORDS, max(1, (long_words - 2) // 4)))) if runs else lambda lines: []), "texts")
    spans = texts.select("uid", "doc_id", "tie", F.inline("spans"))
    if runs:
        more = written(extended(texts, candidates, long_words), "windows")
        spans = spans.unionByName(more)
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie", "uid", "begin", "end")
    repeated = spans.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = written(repeated.select("digest", F.col("first.uid").alias("first_uid"), F.col("first.begin").alias("first_begin"), F.col("first.end").alias("first_end")), "repeated")

    later = spans.join(side(repeated, F.lit(40)), "digest").where("uid <> first_uid OR begin <> first_begin")
    gone = F.when(F.col("uid") == F.col("first_uid"), F.greatest("begin", "first_end")).otherwise(F.col("begin"))
    later = later.select("uid", "begin", "end", gone.alias("gone"), "first_uid", (F.col("begin") - F.col("first_begin")).alias("shift"))
    order = Window.partitionBy("uid", "first_uid", "shift").orderBy("begin", "end")
    fresh = F.col("begin") > F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    numbered = later.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("uid", "first_uid", "shift", "run").agg(F.min("begin").alias("at"), F.max("end").alias("to"), F.collect_list(F.struct("begin", "end", "gone")).alias("parts"))
    found = written(joined.select("uid", "at", "parts", "first_uid", (F.col("at") - F.col("shift")).alias("first_begin"), (F.col("to") - F.col("shift")).alias("first_end")), "runs")

    keys = ["first_uid", "first_begin", "first_end"]
    wanted = written(found.select(*keys).distinct(), "wanted")
    first = written(stretches(texts, side(wanted, F.lit(16))), "stretches")
    marks = found.join(side(first, F.octet_length("first_z") + 16), keys).groupBy("uid").agg(F.collect_list(F.struct("at", "parts", "first_z")).alias("marks"), F.sum(F.octet_length("first_z") + 16 * F.size("parts") + 16).alias("bytes"))
    marks = written(marks, "marks")
    discard(repeated, found, wanted, first, *([more] if runs else []))
    result = {"doc_id": pa.int64(), "text": pa.string(), **dict.fromkeys(("n_lines", "n_removed_lines", "n_chunks", "n_removed_chunks"), pa.int64())}

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for doc_id, z, found in zip(b.column("doc_id").to_pylist(), b.column("z").to_pylist(), b.column("marks").to_pylist(), strict=True):
                if z is None:
                    out.append((doc_id, None, 0, 0, 1, 0))
                    continue
                lines = unpack(z).split(b"\n")
                goes = [False] * len(lines)
                for m in found or ():
                    earlier, at = unpack(m["first_z"]).split(b"\n"), m["at"]
                    for p in m["parts"]:
                        if p["gone"] < p["end"] and lines[p["begin"] : p["end"]] == earlier[p["begin"] - at : p["end"] - at]:
                            goes[p["gone"] : p["end"]] = [True] * (p["end"] - p["gone"])
                cut = chunks(lines, mean_lines, most_lines, long_words)
                left = b"\n".join(x for x, gone in zip(lines, goes, strict=True) if not gone).decode()
                out.append((doc_id, left, len(lines), sum(goes), len(cut), sum(all(goes[begin:end]) for begin, end, _ in cut)))
            yield batch(result, *(map(list, zip(*out, strict=True)) if out else [[]] * 6))

    both = texts.select("uid", "doc_id", "z").join(side(marks, F.col("bytes")), "uid", "left").select("doc_id", "z", "marks")
    return arrow_map(both, remove, "doc_id long, text string, n_lines long, n_removed_lines long, n_chunks long, n_removed_chunks long")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_lines: int = MEAN_LINES, most_lines: int = MOST_LINES, long_words: int = LONG_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text (without what repeats), n_lines, n_removed_lines, n_chunks and n_removed_chunks of every text."""
    return deduplicated(docs, False, id_col, text_col, mean_lines, most_lines, long_words, broadcast_bytes)


def run_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_lines: int = MEAN_LINES, most_lines: int = MOST_LINES, long_words: int = LONG_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """As line_dedup, of all repeated runs; a chunk counts as removed if all its lines are."""
    return deduplicated(docs, True, id_col, text_col, mean_lines, most_lines, long_words, broadcast_bytes)
