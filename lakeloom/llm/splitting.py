"""Splitting texts above a limit at natural boundaries.

Separators form a hierarchy: sections (a paragraph that begins with a heading), paragraphs (two or more line ends), lines,
sentences, words, characters. A part that is too large is cut at the separators of the next finer kind that it has, and so on; the parts,
each with the separator that ends it, are then packed greedily, and every piece but the first begins with the end of the one
before. Pieces without their overlaps, one after the other, are the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.sizes import char_end, char_start, n_tokens

PARAGRAPH_END = re.compile(rb"(?:\r?\n){2,}")
HEADING = re.compile(rb"#{1,6}[ \t]")
LINE_END = re.compile(rb"\n")
SENTENCE_END = re.compile(rb"[.!?]+[\"')\]]*\s+|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")
WORD_END = re.compile(rb"\s+")
LEVELS = ("section", "paragraph", "line", "sentence", "word", "character")
LINE = LEVELS.index("line")
PIECES = "limit_id int, doc_id long, piece_no int, start_token long, n_tokens long, overlap_tokens long, cut_at string, text string, long_blocks array<int>"
_PIECES = pa.schema([("limit_id", pa.int32()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int64()), ("overlap_tokens", pa.int64()), ("cut_at", pa.string()), ("text", pa.string()), ("long_blocks", pa.list_(pa.int32()))])


@dataclass(frozen=True)
class Limit:
    limit_id: int
    max_tokens: int
    overlap_tokens: int = 0

    def __post_init__(self):
        if self.max_tokens < 1 or not 0 <= self.overlap_tokens < self.max_tokens:
            raise ValueError(f"limit {self.limit_id}: an overlap of {self.overlap_tokens} doesn't fit a limit of {self.max_tokens}")


@dataclass
class Part:
    """A part of a text and the kind of boundary it ends at."""

    start: int
    end: int
    level: int


def blocks(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, end of the separator after it) of the non-empty parts between paragraph ends."""
    out, at = [], 0
    for m in PARAGRAPH_END.finditer(data):
        if m.start() > at:
            out.append((at, m.start(), m.end()))
        at = m.end()
    if at < len(data):
        out.append((at, len(data), len(data)))
    return out


def _cuts(data: bytes, level: int, start: int, end: int, paragraphs: list[int]) -> list[int]:
    """Positions inside (start, end) where a separator of the level ends."""
    if level <= 1:
        inside = paragraphs[bisect_right(paragraphs, start) : bisect_left(paragraphs, end)]
        return [p for p in inside if HEADING.match(data, p)] if level == 0 else inside
    found = (LINE_END, SENTENCE_END, WORD_END)[level - 2]
    return [m.end() for m in found.finditer(data, start, end) if m.end() < end]


def parts(data: bytes, most: int, paragraphs: list[int]) -> Iterator[Part]:
    """The text as parts of at most ``most`` bytes, divided no finer than that needs."""
    todo = [(Part(0, len(data), 0), 0)]
    while todo:
        part, level = todo.pop()
        if part.end - part.start <= most:
            yield part
        elif level == len(LEVELS) - 1:
            at = part.start
            while at < part.end:
                to = char_start(data, min(at + most, part.end))
                if to <= at:  # one character is larger than the limit
                    to = min(at + most, part.end)
                yield Part(at, to, level if to < part.end else part.level)
                at = to
        else:
            at, inner = part.start, []
            for cut in _cuts(data, level, part.start, part.end, paragraphs):
                inner.append((Part(at, cut, level), level + 1))
                at = cut
            inner.append((Part(at, part.end, part.level), level + 1))
            todo += reversed(inner)


def split(data: bytes, limit: Limit) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """(start, end, overlap, level of the cut) of each piece, and the numbers of the blocks that alone exceed the limit.

    Such a block is one that had to be divided at lines or finer, as no part exceeds the limit; of the blocks that were, its size decides.
    """
    own = blocks(data)
    starts = [start for start, _, _ in own]
    out: list[tuple[int, int, int, int]] = []
    long_blocks: list[int] = []
    start = begin = end = 0  # where the piece starts with its overlap, where its own content begins, where it ends
    level = 0
    for part in parts(data, limit.max_tokens - limit.overlap_tokens, [after for _, _, after in own]):
        if part.end - start > limit.max_tokens and end > begin:
            out.append((start, end, begin - start, level))
            begin = end
            start = char_end(data, max(start, end - limit.overlap_tokens))
        end, level = part.end, part.level
        if level >= LINE and (i := bisect_right(starts, end - 1) - 1) >= 0 and own[i][1] - own[i][0] > limit.max_tokens and (not long_blocks or long_blocks[-1] != i):
            long_blocks.append(i)
    if end > begin:
        out.append((start, end, begin - start, level))
    return out, long_blocks


def split_documents(documents: DataFrame, limits: Sequence[Limit]) -> DataFrame:
    """Rows of PIECES: for each limit the pieces of every document with more tokens than it.

    documents: (doc_id, text), doc_id unique; other columns don't matter. Null and empty texts and texts within the limit have no
    pieces. No piece has more tokens than the limit, none breaks a character (unless a single one is larger than the limit without
    its overlap). ``overlap_tokens`` is what a piece repeats of the one before: the limit's overlap, or up to three less where a
    character would be broken, or all of a shorter piece. cut_at is the kind of boundary a piece ends at. long_blocks, in the first
    piece of a document and null in the others, numbers the blocks (non-empty parts between two or more line ends) that alone exceed the limit.
    """
    if not limits:
        return documents.sparkSession.createDataFrame([], PIECES)
    least = min(limit.max_tokens for limit in limits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_buffer().to_pybytes()
                for limit in limits:
                    if len(data) <= limit.max_tokens:
                        continue
                    pieces, long_blocks = split(data, limit)
                    for i, (start, end, overlap, level) in enumerate(pieces):
                        kind = "end" if end == len(data) else LEVELS[level]
                        rows.append((limit.limit_id, doc_id, i, start, end - start, overlap, kind, data[start:end].decode("utf-8", "replace"), None if i else long_blocks))
                        held += end - start
                        if held > 4_000_000:
                            yield _batch(rows)
                            rows, held = [], 0
        if rows:
            yield _batch(rows)

    return documents.filter(n_tokens(F.col("text")) > least).select("doc_id", "text").mapInArrow(cut, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)
