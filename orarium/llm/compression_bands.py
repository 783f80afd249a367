"""Quality rules by compression: zstandard ratios of whole texts and of fixed chunks must lie in a band for their length.

Text that repeats itself compresses too well, random strings too badly. A text is rejected if its own ratio
(compressed bytes / bytes) is outside the band of its length, or if more than `bad_share` of its chunks are. A text of
more than `chunk_bytes` bytes is cut into chunks of that size; a rest of under LEAST_CHUNK bytes belongs to the last one.

Base counts come with the verdict: words are runs of anything but space and \\t-\\r; see the columns below.

Defined results: null or empty text has no words, all counts 0, base_failed true, kept false, ratio null. One row for
each row of the input, ties and repeated rows included; a text of any length is judged whole; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orarium.llm.common import arrow_map, batch, pick

#: From so many bytes on, the lowest and highest ratio of natural text. Short texts carry the frame and little context.
BANDS = ((0, 0.40, 9.0), (256, 0.42, 0.86), (512, 0.40, 0.82), (1024, 0.36, 0.76), (2048, 0.34, 0.72), (4096, 0.32, 0.70), (8192, 0.31, 0.68), (16384, 0.30, 0.67))
CHUNK_BYTES, LEAST_CHUNK, BAD_SHARE, LEVEL = 4096, 1024, 0.25, 3
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW = 50, 3

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
TYPES = {"doc_id": pa.int64(), **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), pa.int64()), "base_failed": pa.bool_(), "kept": pa.bool_(), "ratio": pa.float64(), "n_chunks": pa.int64(), "n_bad_chunks": pa.int64()}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more, its first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    v = len(number)
    key = ids[:n]
    top = v
    for k in range(1, window):
        if top * v >= 1 << 62:  # else numbers of windows so far, to stay within 64 bits
            key = np.unique(key, return_inverse=True)[1]
            top = n
        key = key * v + ids[k : k + n]
        top *= v
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= twice
    return int(covered.sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in data.split(b"\n"):
        if line in seen:
            n += bool(line.strip())
        else:
            seen.add(line)
    return n


class Bands:
    def __init__(self, bands=BANDS, chunk_bytes=CHUNK_BYTES, bad_share=BAD_SHARE, level=LEVEL):
        import zstandard

        self.press = zstandard.ZstdCompressor(level=level).compress
        self.bands, self.chunk_bytes, self.bad_share = bands, chunk_bytes, bad_share

    def outside(self, size: int, ratio: float) -> bool:
        low, high = next((lo, hi) for least, lo, hi in reversed(self.bands) if size >= least)
        return not low <= ratio <= high

    def judge(self, data: bytes) -> tuple[float | None, int, int, bool]:
        """ratio of the whole, chunks, chunks outside their band, and whether the text passes."""
        if not data:
            return None, 0, 0, False
        ratio = len(self.press(data)) / len(data)
        chunks = bad = 0
        if len(data) > self.chunk_bytes:
            view = memoryview(data)
            cuts = [*range(0, len(data) - min(LEAST_CHUNK, self.chunk_bytes) + 1, self.chunk_bytes), len(data)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                chunks += 1
                bad += self.outside(end - begin, len(self.press(view[begin:end])) / (end - begin))
        return ratio, chunks, bad, not self.outside(len(data), ratio) and bad <= self.bad_share * chunks


def rules(text: str | None, bands: Bands) -> tuple:
    """The row of one text, without its id."""
    text = text or ""
    data = text.encode()
    words = data.split()
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > 50 * len(words)
    ratio, chunks, bad, passed = bands.judge(data)
    letters = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return len(words), letters, sum(map(text.count, SYMBOLS)), duplicate_lines(data), repeat, failed, passed and not failed, ratio, chunks, bad


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk_bytes: int = CHUNK_BYTES, bad_share: float = BAD_SHARE) -> DataFrame:
    """Counts and verdict for every text; a map, without a shuffle."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Bands(bands, chunk_bytes, bad_share)
        for b in batches:
            rows = [rules(t, tool) for t in b.column("text").to_pylist()]
            yield batch(TYPES, b.column("doc_id").cast(pa.int64()), *(map(list, zip(*rows, strict=True)) if rows else [[]] * 10))

    return arrow_map(pick(docs, doc_id=id_col, text=text_col), judge, SCHEMA)
