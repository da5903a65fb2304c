"""Problem 2: cutting long texts into pieces at natural boundaries.

Content-defined chunking. A gear hash of the last ``WINDOW`` characters rolls
over the text; positions where its top bits are zero are landmarks. A piece
ends at the natural boundary nearest to the first landmark between the least
and the greatest size, of the strongest kind of boundary there: a blank line,
else a line end, a sentence end, white space. Where there is none between the
sizes, a piece ends at the last one before, however short it is; only text
without any is cut between two characters. Cuts depend on nearby text alone, so an edit
changes the pieces around it and the old cuts return after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.corpus import rows_to_batches, settled, unique

#: Characters (code points) of a piece, with the overlap.
MAX_CHARS = 1200
#: Characters from before the cut that a piece begins with.
OVERLAP = 200
#: New characters of a piece, unless the text ends.
MIN_NEW = 400
#: Characters that a landmark depends on.
WINDOW = 32
#: A landmark has so many zero bits: one in 128 positions.
ZERO_BITS = 7

#: From the strongest boundary to the weakest; a cut is the end of a match.
BOUNDARIES = tuple(map(re.compile, (r"\n[^\S\n]*\n\s*", r"\n", r"[.!?…][\"”’»)\]]*\s+|[。！？][”’」』）]*\s*", r"\s+")))
_GEAR = np.random.default_rng(20).integers(0, 1 << 64, 1 << 12, dtype=np.uint64)


def landmarks(text: str) -> np.ndarray:
    """Positions (characters before them) at which the rolling hash has a landmark."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _GEAR[(codes * np.uint32(2654435761)) >> np.uint32(20)]
    width = 1
    while width < WINDOW:  # hashes of windows of 2, 4, 8, ... characters
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint64(width)
        h, width = wider, width * 2
    return np.flatnonzero(h >> np.uint64(64 - ZERO_BITS) == 0) + 1


def cuts(text: str) -> list[int]:
    """Where each piece but the first begins with new text, in ascending order."""
    out: list[int] = []
    marks = None
    at, room = 0, MAX_CHARS
    while len(text) - at > room:
        if marks is None:
            marks = landmarks(text)
        low, high = at + MIN_NEW, at + room
        i = int(np.searchsorted(marks, low))
        mark = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        at = _snap(text, at, low, high, mark)
        out.append(at)
        room = MAX_CHARS - OVERLAP
    return out


def _snap(text: str, at: int, low: int, high: int, mark: int) -> int:
    for kind in BOUNDARIES:
        ends = [e for m in kind.finditer(text, max(0, low - 2), high) if low <= (e := m.end()) <= high]
        if ends:
            return min(ends, key=lambda e: (abs(e - mark), e))
    # none: a shorter piece that ends naturally, however short, else a cut between two characters
    for kind in BOUNDARIES:
        ends = [e for m in kind.finditer(text, at, low) if at < (e := m.end()) < low]
        if ends:
            return ends[-1]
    return mark


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """First and last character position of each longest run of lines that are not blank."""
    start, at = -1, 0
    for line in text.split("\n"):
        if line and not line.isspace():
            if start < 0:
                start = at
            end = at + len(line)
        elif start >= 0:
            yield start, end
            start = -1
        at += len(line) + 1
    if start >= 0:
        yield start, end


def split_text(text: str) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Pieces as (start with overlap, start of new text, end), and the blocks, from 1, that could not be kept whole:
    those that no piece holds, and no piece of any cut could, as they are longer than a piece."""
    if len(text) <= MAX_CHARS:
        return ([(0, 0, len(text))] if text else []), []
    at = [0, *cuts(text), len(text)]
    pieces = [(max(0, new - OVERLAP) if new else 0, new, end) for new, end in zip(at, at[1:])]
    broken = []
    i = 0
    for k, (a, b) in enumerate(blocks(text), 1):
        while pieces[i][2] < b:  # the first piece that ends after the block has the earliest start of all that may hold it
            i += 1
        if pieces[i][0] > a and b - a > MAX_CHARS:
            broken.append(k)
    return pieces, broken


def _rows(kind: str, key: str, text: str):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(key, pa.int64()), ("piece_no", pa.int32()), ("start_char", pa.int32()), ("new_from", pa.int32()), ("end_char", pa.int32()), ("piece", pa.string())])
        rows = ((k, i, a, new, b, t[a:b]) for k, t in unique(batches, key, text) for i, (a, new, b) in enumerate(split_text(t)[0], 1))
        return rows_to_batches(rows, schema, 2000)

    def oversized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, no) for k, t in unique(batches, key, text) for no in split_text(t)[1])
        return rows_to_batches(rows, pa.schema([(key, pa.int64()), ("block_no", pa.int32())]))

    return pieces if kind == "pieces" else oversized


def _whole(items: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with key and text; repeats share a partition, where ``unique`` drops them."""
    return settled(items.select(key, text), key).where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias(key), text).repartition(key)


def pieces(items: DataFrame, key: str = "result_id", text: str = "md_content") -> DataFrame:
    """(key, piece_no, start_char, new_from, end_char, piece) of each text.

    Piece n is characters start_char to end_char of the text; its new text begins
    at new_from, 200 characters later but for the first piece. A text within the
    limit is one piece; a null or empty text has none; rows without key are left out.
    """
    schema = f"{key} long, piece_no int, start_char int, new_from int, end_char int, piece string"
    return _whole(items, key, text).mapInArrow(_rows("pieces", key, text), schema)


def oversized_blocks(items: DataFrame, key: str = "result_id", text: str = "md_content") -> DataFrame:
    """(key, block_no) of each block that no piece holds whole, nor could."""
    return _whole(items, key, text).mapInArrow(_rows("oversized", key, text), f"{key} long, block_no int")
