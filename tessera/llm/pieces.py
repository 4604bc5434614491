"""Problem 6: cutting oversized texts at natural boundaries, with overlap.

A batch is one flat code-point array. White-space runs give the offsets of every word and, by prefix sums, the number
of words of each text; only texts over the limit are cut. For those, the words after a sentence stop, a line break or a
blank line form a sorted boundary array per kind; each piece ends at the last boundary within the limit (binary search),
preferring blank lines, then line breaks, then sentences, as long as the piece stays at least half full, else at any
boundary, else hard at the limit. The next piece starts at the first boundary within the overlap, or exactly ``overlap``
words back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcodes import codes_of, runs

# fixed values: sentence stops and the closing marks that may follow one
STOPS = ".!?。！？؟…"
CLOSERS = "\"')]}»”’」』"


@lru_cache(maxsize=1)
def _space_table() -> np.ndarray:
    return np.fromiter((chr(i).isspace() for i in range(0x110000)), dtype=bool, count=0x110000)


def _codes(chars: str) -> np.ndarray:
    return np.fromiter(map(ord, chars), np.uint32)


def boundaries(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word indexes at which a paragraph, a line and a sentence (or any of the former) begins; each ascending."""
    breaks = np.concatenate(([0], np.cumsum((codes == 10) | ((codes == 13) & np.append(codes[1:] != 10, True)))))
    between = breaks[starts[1:]] - breaks[ends[:-1]]
    last = ends[:-1] - 1
    closed = np.isin(codes[last], _codes(CLOSERS)) & (last > starts[:-1])
    stop = np.isin(codes[np.where(closed, last - 1, last)], _codes(STOPS))
    at = np.arange(1, len(starts))
    return at[between >= 2], at[between >= 1], at[(between >= 1) | stop]


def plan(words: int, kinds: tuple[np.ndarray, np.ndarray, np.ndarray], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of words of the pieces of a text of ``words`` words; every piece ends later than the one before."""
    out: list[tuple[int, int]] = []
    start, last_end = 0, 0
    while True:
        cap = start + limit
        if cap >= words:
            out.append((start, words))
            return out
        end = cap
        for least, kind in [(max(last_end, start + limit // 2 - 1), k) for k in kinds] + [(last_end, kinds[2])]:
            i = int(np.searchsorted(kind, cap, side="right")) - 1
            if i >= 0 and kind[i] > least:
                end = int(kind[i])
                break
        out.append((start, end))
        back = max(end - overlap, start + 1)
        i = int(np.searchsorted(kinds[2], back))
        start = int(kinds[2][i]) if i < len(kinds[2]) and kinds[2][i] < end else back
        last_end = end


def _cut(limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            codes = codes_of("\n".join(texts) + "\n")
            limits = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
            starts, ends = runs(~_space_table()[codes])
            first = np.concatenate(([0], np.searchsorted(starts, limits)))  # words before each text
            who, numbers, froms, counts, pieces, over = [], [], [], [], [], []
            for row in np.flatnonzero(np.diff(first) > limit):
                lo, hi = first[row], first[row + 1]
                base = limits[row] - len(texts[row]) - 1
                own = codes[base : limits[row] - 1]
                s, e = starts[lo:hi] - base, ends[lo:hi] - base
                before = 0
                for k, (a, b) in enumerate(plan(hi - lo, boundaries(own, s, e), limit, overlap)):
                    who.append(row)
                    numbers.append(k)
                    froms.append(a)
                    counts.append(b - a)
                    over.append(max(before - a, 0))
                    pieces.append(texts[row][s[a] : e[b - 1]] if with_text else None)
                    before = b
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(who, pa.int64())),
                    *(pa.array(x, pa.int32()) for x in (numbers, froms, counts, over)),
                    pa.array(pieces, pa.string()),
                ],
                names=["id", "piece_no", "first_word", "words", "overlap", "piece"],
            )

    return run


def oversized_pieces(docs: DataFrame, id_col: str, text_col: str, *, limit: int = 400, overlap: int = 80, with_text: bool = True) -> DataFrame:
    """``(<id>, piece_no, first_word, words, overlap, piece)`` of every text of more than ``limit`` words.

    Words are maximal runs without (Unicode) white space. Pieces are numbered from 0 and are substrings of the text;
    leaving out the first ``overlap`` words of each gives the text's words back, each once. Null, empty and short texts
    give no rows. ``overlap`` must be under half of ``limit``.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and under half of the limit")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # a text of more than ``limit`` words has at least 2 * limit + 1 characters
    rows = rows.where(F.length("text") > 2 * limit)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(
        _cut(limit, overlap, with_text), f"id {kind}, piece_no int, first_word int, words int, overlap int, piece string"
    )
    return out.withColumnRenamed("id", id_col)
