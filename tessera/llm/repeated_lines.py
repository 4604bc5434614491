"""Problem 4: lines that one source repeats across its documents.

One Arrow pass gives every line two hashes, computed on flat code-point arrays: that of its normal form (trimmed, white
space single, lower case), and a locality-sensitive one, the mix of ``ROWS`` min-hashes of its words with numbers,
dates and the names of bodies masked. Within a source, lines of one such key are a cluster; equal lines always are in
one, near-equal ones of masked word similarity s with probability s**ROWS. A cluster's document frequency is at least
that of each line in it, so lines of clusters below the limits drop out there, and only for the rest are the exact
document frequencies counted (a document counts once however often it repeats a line). Both counts combine map-side,
so a source or a line on a third of the rows is harmless. ``near_repeated_lines`` gives the clusters themselves: lines
that differ in their numbers, dates or names only, and are repeated as often as all lines of their cluster together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .textcodes import codes_of, mix, word_char_table, word_hashes

ROWS = 2
SMALL_ROWS = 500_000
# fixed values: the months, which are masked as dates
MONTHS = "january february march april may june july august september october november december"
# fixed values: nouns before which a word is a name, which is masked
BODIES = "authority agency board council tribunal inspectorate court ministry commission act code rule charter directive order framework desk line standards affairs"
_NUMBER, _DATE, _NAME = np.uint64(1), np.uint64(2), np.uint64(3)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.fromiter((chr(i).isspace() for i in range(0x110000)), dtype=bool, count=0x110000)
    return space, np.sort(word_hashes([MONTHS])[0]), np.sort(word_hashes([BODIES])[0])


def _isin(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    return ascending[np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)] == x


def line_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, line number, cluster key and normal-form hash of every non-blank line."""
    space, months, bodies = _tables()
    joined = "\n".join(texts) + "\n"
    low = [t.lower() for t in joined.split("\n")[:-1]]
    codes = codes_of("\n".join(low) + "\n")
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lines = len(starts)
    per_text = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    text_of = np.repeat(np.arange(len(texts)), per_text)
    number = np.arange(lines) - np.repeat(np.concatenate(([0], np.cumsum(per_text)[:-1])), per_text)
    # normal form: white space counts once, and only between other characters
    blank = space[codes]
    solid = np.flatnonzero(~blank)
    line_of = np.searchsorted(ends, solid)
    used, first = np.unique(line_of, return_index=True)
    gap = np.ones(len(solid), np.int64)
    gap[1:] += (solid[1:] > solid[:-1] + 1).astype(np.int64)
    place = np.cumsum(gap)
    base = np.zeros(lines, np.int64)
    base[used] = place[first]
    value = mix(codes[solid].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place - base[line_of]).astype(np.uint64))
    exact = mix(np.add.reduceat(value, first)) if len(first) else np.zeros(0, np.uint64)
    # masked words
    word, of = word_hashes(low)
    digit = np.zeros(len(word), bool)
    if len(word):
        alnum = word_char_table()[codes]
        begins = np.flatnonzero(alnum & ~np.concatenate(([False], alnum[:-1])))
        digit = (codes[begins] >= 48) & (codes[begins] <= 57)
        month = _isin(word, months)
        name = np.zeros(len(word), bool)
        name[:-1] = _isin(word[1:], bodies) & (of[1:] == of[:-1])
        word = np.where(digit, _NUMBER, np.where(month, _DATE, np.where(name, _NAME, word)))
    cluster = mix(exact + np.uint64(5))  # lines without words
    at_line, at = np.unique(of, return_index=True)
    if len(at):
        key = np.zeros(len(at), np.uint64)
        for r in range(ROWS):
            key = mix(key + np.minimum.reduceat(mix(word + np.uint64(0x51ED + 977 * r)), at))
        cluster[np.searchsorted(used, at_line)] = key
    return text_of[used], number[used], cluster, exact


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            of, number, cluster, exact = line_hashes(part.column(2).to_pylist())
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), pa.array(number.astype(np.int32)), pa.array(cluster.view(np.int64)), pa.array(exact.view(np.int64))],
                names=["doc", "s", "line_no", "cluster", "h"],
            )


def repeated_lines(
    docs: DataFrame, id_col: str, source_col: str, text_col: str, *, min_docs: int = 5, min_share: float = 0.1
) -> DataFrame:
    """``(<id>, line_no, s, h, docs_with_line)``: lines in at least ``min_docs`` documents and ``min_share`` of their source's.

    ``s`` and ``h`` identify source and line. Rows with a missing or blank source have no lines here; null and blank
    texts count as documents of their source. Line numbers count from 0 over all lines; blank lines are never given.
    Equal lines are equal in normal form. A document that holds a line twice counts once but gives both line numbers.
    """
    near = _wide_lines(docs, id_col, source_col, text_col, min_docs, min_share)
    found = (
        near.select("s", "h", "need", "doc").distinct().groupBy("s", "h", "need").agg(F.count("*").alias("docs_with_line"))
        .where("docs_with_line >= need").select("s", "h", "docs_with_line")
    )
    return near.join(found, ["s", "h"]).select(F.col("doc").alias(id_col), "line_no", "s", "h", "docs_with_line")


def near_repeated_lines(
    docs: DataFrame, id_col: str, source_col: str, text_col: str, *, min_docs: int = 5, min_share: float = 0.1
) -> DataFrame:
    """``(<id>, line_no, s, h, docs_with_line)``: as ``repeated_lines``, with near-duplicates counted as one line.

    ``h`` is the cluster: lines of a source whose words agree in all min-hashes once numbers, dates and names of bodies
    are masked, in at least ``min_docs`` documents and ``min_share`` of the source's. Every row of ``repeated_lines`` is among these.
    """
    near = _wide_lines(docs, id_col, source_col, text_col, min_docs, min_share)
    found = (
        near.select("s", "cluster", "need", "doc").distinct().groupBy("s", "cluster", "need").agg(F.count("*").alias("docs_with_line"))
        .where("docs_with_line >= need").select("s", "cluster", "docs_with_line")
    )
    return near.join(found, ["s", "cluster"]).select(F.col("doc").alias(id_col), "line_no", "s", F.col("cluster").alias("h"), "docs_with_line")


def _wide_lines(docs: DataFrame, id_col: str, source_col: str, text_col: str, min_docs: int, min_share: float) -> DataFrame:
    """``(doc, s, line_no, h, cluster, need)`` of the lines whose cluster has as many lines as its source needs documents."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where(F.col("source").rlike(r"(?U)\S"))
    kind = rows.schema["doc"].dataType.simpleString()
    size = (
        rows.groupBy(F.xxhash64("source").alias("s")).agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
        .select("s", F.greatest(F.lit(min_docs), F.ceil(F.col("docs") * min_share - 1e-9)).alias("need"))
    )
    lines = (
        rows.where(F.col("text").isNotNull()).select("doc", F.xxhash64("source").alias("s"), "text")
        .mapInArrow(_hash_lines, f"doc {kind}, s long, line_no int, cluster long, h long").persist(StorageLevel.MEMORY_AND_DISK)
    )
    wide = cut(
        lines.groupBy("s", "cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
        .join(size, "s").where("n >= need").select("s", "cluster", "need")
    )
    # few beside the lines: each holds at least min_share of its source's documents; broadcast only if counted to be
    near = lines.join(F.broadcast(wide) if wide.count() <= SMALL_ROWS else wide, ["s", "cluster"]).select("doc", "s", "line_no", "h", "cluster", "need")
    near = cut(near)
    lines.unpersist()
    return near


def line_table(docs: DataFrame, found: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``(<source>, line, docs_with_line)``: each repeated line of each source once, in normal form."""
    first = found.groupBy("s", "h", "docs_with_line").agg(F.min(F.struct(id_col, "line_no")).alias("at"))
    first = first.select(F.col("at")[id_col].alias("at_id"), F.col("at.line_no").alias("at_line"), "docs_with_line")
    raw = F.get(F.split(F.col(text_col), "\n"), F.col("at_line"))
    line = F.lower(F.trim(F.regexp_replace(raw, r"(?U)\s+", " ")))
    return docs.join(first, F.col(id_col) == F.col("at_id")).select(source_col, line.alias("line"), "docs_with_line")


def without_lines(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(<id>, <text>)`` of every row of ``docs`` with the lines of ``found`` taken out of its text; a null text stays null."""
    drop = found.groupBy(F.col(id_col).alias("drop_id")).agg(F.collect_set("line_no").alias("drop_lines"))
    rows = docs.select(id_col, text_col).join(drop, F.col(id_col) == F.col("drop_id"), "left")
    kept = F.filter(F.split(text_col, "\n"), lambda _line, i: ~F.array_contains(F.col("drop_lines"), i))
    text = F.when(F.col("drop_lines").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return rows.select(id_col, text.alias(text_col))
