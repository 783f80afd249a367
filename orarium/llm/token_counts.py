"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A text of at most `chunk` characters is one call of the library per distinct piece, where pieces end at proven
boundaries (below) and counts of pieces seen before are looked up. A longer text is encoded in overlapping chunks
with offsets; two neighbours are spliced at the first position in their overlap where both start a token and which is
a proven boundary of the whole text. If there is none, the overlap is widened, at last to the end of the text.

Proven boundary, for byte-level pre-tokenizers of the pattern ` ?letters| ?digits| ?others|spaces`: a position whose
left character is not white space and whose right one is. No alternative of the pattern takes white space after
anything else, so the left match ends there, and what follows is matched without a look behind. No special token of
the vocabulary holds white space (checked on loading).

Defined results: null or empty text has 0 bytes and 0 tokens. A text that isn't null always gives a row; rows that
repeat give repeated rows; further columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from orarium.llm.common import arrow_map, batch, pick

#: Characters of a chunk, and of the overlap that is tried first.
CHUNK, OVERLAP = 16_384, 256
#: Distinct pieces that a Python worker remembers.
REMEMBERED = 400_000

PIECE = re.compile(r"[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+")
#: White space and near white space beyond ASCII's six: such texts aren't cut into pieces.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
STABLE = re.compile(r"[!-~](?=[ \t\n\v\f\r])|[^\W\d_](?=[ \t\n\v\f\r])")


class Counter:
    """Counts tokens with one tokenizer file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.known: dict[str, int] = {}
        for token in self.library.get_added_tokens_decoder().values():
            if re.search(r"\s", token.content) or token.lstrip or token.rstrip or token.single_word:
                raise ValueError("a special token takes white space: boundaries can't be proven")

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [None if len(t) > self.chunk else [t] if ODD_SPACE.search(t) else PIECE.findall(t) for t in texts]
        known = self.known
        new = list({p for pieces in cut if pieces for p in pieces if p not in known})
        known.update(zip(new, map(len, self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return [self.spliced(t) if pieces is None else sum(map(known.__getitem__, pieces)) for t, pieces in zip(texts, cut, strict=True)]

    def starts(self, text: str, begin: int, end: int) -> list[int]:
        """Where the tokens of a chunk start, as positions in the whole text."""
        return [begin + a for a, _ in self.library.encode(text[begin:end], add_special_tokens=False).offsets]

    def spliced(self, text: str) -> int:
        """The number of tokens of a long text: chunks share an overlap and are joined where both agree."""
        from bisect import bisect_left

        total, begin, end, n = 0, 0, min(len(text), self.chunk), len(text)
        left = self.starts(text, begin, end)
        floor = 0  # tokens of the left chunk before this position are counted
        while end < n:
            overlap, joint = self.overlap, None
            while joint is None:
                stop = min(n, end + self.chunk)
                start = max(floor, end - overlap)
                right = self.starts(text, start, stop)
                firsts = set(right)
                for m in STABLE.finditer(text, start, end):
                    at = m.end()
                    if start < at < end and at in firsts and (k := bisect_left(left, at)) < len(left) and left[k] == at and not ODD_SPACE.search(text, at - 1, at + 1):
                        joint = at
                        break
                if joint is None:
                    if start == floor:  # the whole left chunk was no help: take it longer
                        end = min(n, end + overlap)
                        left = self.starts(text, floor, end)
                        if end == n:
                            break
                    overlap *= 2
            if joint is None:
                break
            total += bisect_left(left, joint) - bisect_left(left, floor)
            floor, left, end = joint, right, stop
        return total + len(left) - bisect_left(left, floor)


_counters: dict[tuple, Counter] = {}


def counter(path: str, chunk: int, overlap: int) -> Counter:
    """One for each file and Python worker."""
    if (key := (path, chunk, overlap)) not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every text; no shuffle. The tokenizer is read at `tokenizer` on each executor."""
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(tokenizer, chunk, overlap)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = tool.counts(texts)
            yield batch(types, b.column("doc_id").cast(pa.int64()), [len(t.encode()) for t in texts], n, [x > limit for x in n])

    return arrow_map(pick(docs, doc_id=id_col, text=text_col), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
