"""Chunking: sentence packing with look-back, word windows, sections, per-source caps. No Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col, sentences, strip, words


def packed_ranges(counts: Column, size: int, overlap: int) -> Column:
    """Ranges ``struct(lo, hi)`` of sentences, from their word counts.

    From start s a range takes sentences while their words stay within ``size`` (the first always); the next start goes
    back over whole sentences while their words stay within ``overlap``, but ahead of s. With prefix sums P both ends
    are counts of prefix sums under a bound. A sentence has a word at least, so the end lies within ``size`` sentences
    and the next start within ``overlap``, and only that slice of P is looked at.
    """
    zero = F.array(F.lit(0))
    sums = F.aggregate(counts, zero, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    none = F.array().cast("array<struct<lo:int,hi:int>>")

    def step(acc: Column, p: Column, n: Column) -> Column:
        at = acc["at"]
        ahead = F.filter(F.slice(p, F.greatest(at, F.lit(0)) + 1, F.lit(size + 2)), lambda x: x <= F.get(p, at) + size)
        end = F.greatest(at + 1, at + F.size(ahead) - 1).cast("int")
        low = F.greatest(end - overlap, F.lit(0))
        behind = F.filter(F.slice(p, low + 1, F.lit(overlap + 1)), lambda x: x < F.get(p, end) - overlap)
        back = F.greatest(at + 1, low + F.size(behind)).cast("int")
        done = F.struct(F.lit(-1).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("lo"), end.alias("hi")))).alias("out"))
        more = F.struct(back.alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("lo"), end.alias("hi")))).alias("out"))
        return F.when(at < 0, acc).when(end >= n, done).otherwise(more)

    n = F.size(counts)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    # the prefix sums are bound once per row by a one-element transform
    per_row = F.transform(F.array(sums), lambda p: F.aggregate(F.sequence(F.lit(1), n), start, lambda acc, _: step(acc, p, n))["out"])
    return F.when(n == 0, none).otherwise(per_row[0])


def sentence_chunks(df: DataFrame, text_col: str, *, size: int = 400, overlap: int = 80, min_chars: int = 50) -> DataFrame:
    """``df`` without ``text_col``, one row per chunk: ``chunk_index, chunk``.

    Sentences over ``size`` words are cut into runs of that many. Chunks of at most ``min_chars`` characters are dropped
    (before numbering). Null and blank texts give no rows.
    """
    def sliced(s: Column) -> Column:
        w = words(s)
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(w) / size).cast("int") - 1, F.lit(0))), lambda i: F.array_join(F.slice(w, i * size + 1, size), " "))
        return F.when(F.size(w) > size, runs).otherwise(F.array(s))

    keep = [c for c in df.columns if c != text_col]
    rows = df.select(*keep, F.flatten(F.transform(sentences(text_col), sliced)).alias("__s"))
    rows = rows.withColumn("__n", F.transform("__s", lambda s: F.size(words(s)))).withColumn("__r", packed_ranges(F.col("__n"), size, overlap))
    chunks = F.transform("__r", lambda r: strip(F.array_join(F.slice(F.col("__s"), r["lo"] + 1, r["hi"] - r["lo"]), " ")))
    return rows.select(*keep, F.posexplode(F.filter(chunks, lambda c: F.length(c) > min_chars)).alias("chunk_index", "chunk"))


def section_chunks(df: DataFrame, heading_col: str, text_col: str, **options) -> DataFrame:
    """Sentence chunks of sections, each led by ``[heading] `` where there is a heading."""
    out = sentence_chunks(df, text_col, **options)
    head = strip(heading_col)
    return out.withColumn("chunk", F.when(head != "", F.concat(F.lit("["), head, F.lit("] "), F.col("chunk"))).otherwise(F.col("chunk")))


def window_chunks(df: DataFrame, text_col: str, *, size: int = 400, overlap: int = 80) -> DataFrame:
    """``df`` without ``text_col``, one row per window of ``size`` words, ``size - overlap`` words apart."""
    keep = [c for c in df.columns if c != text_col]
    rows = df.select(*keep, words(text_col).alias("__w")).where(F.size("__w") > 0)
    starts = F.sequence(F.lit(0), F.size("__w") - 1, F.lit(size - overlap))
    chunks = F.transform(starts, lambda i: F.array_join(F.slice(F.col("__w"), i + 1, size), " "))
    return rows.select(*keep, F.posexplode(chunks).alias("chunk_index", "chunk"))


def chunk_key(url: Column | str, index: Column | str) -> Column:
    """A chunk's id, the same on every run."""
    return F.sha2(F.concat_ws("#", col(url), col(index).cast("string")), 256)


def first_per_source(df: DataFrame, source_col: str, order: list[str], limit: int = 300, *, rank: str | None = None) -> DataFrame:
    """The first ``limit`` rows of each source, with their place (from 1) as ``rank`` if named; the limit is pushed below the shuffle."""
    place = F.row_number().over(Window.partitionBy(source_col).orderBy(*order))
    rows = df.withColumn("__k", place).where(F.col("__k") <= limit)
    return rows.withColumnRenamed("__k", rank) if rank else rows.drop("__k")


def valid_chunks(df: DataFrame, id_col: str, text_col: str, *, min_chars: int = 50) -> DataFrame:
    """The rows whose stripped text has over ``min_chars`` characters, with the id as text; null texts are left out."""
    return df.where(F.length(strip(text_col)) > min_chars).withColumn(id_col, F.col(id_col).cast("string"))
