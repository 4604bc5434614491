"""The source catalogue: listing, deleting, refreshing, and assembling contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_sources(chunks: DataFrame) -> DataFrame:
    """``(source_title, source_url, chunks)``."""
    return chunks.groupBy("source_title", "source_url").agg(F.count("*").alias("chunks"))


def delete_sources(chunks: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks that stay, and ``(source_url, deleted)`` of those whose url is listed. A null url is never deleted."""
    listed = urls.select("source_url").where("source_url IS NOT NULL").distinct()
    kept = chunks.join(listed, "source_url", "left_anti")
    gone = chunks.join(listed, "source_url", "left_semi").groupBy("source_url").agg(F.count("*").alias("deleted"))
    return kept, gone


def refresh_sources(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store after replacing the sources of ``new``, and ``(source_url, inserted, deleted, refreshed)``."""
    kept, gone = delete_sources(old, new)
    store = kept.select(*old.columns).unionByName(new.select(*old.columns))
    added = new.where("source_url IS NOT NULL").groupBy("source_url").agg(F.count("*").alias("inserted"))
    deleted = F.coalesce("deleted", F.lit(0))
    return store, added.join(gone, "source_url", "left").select("source_url", "inserted", deleted.alias("deleted"), (deleted > 0).alias("refreshed"))


def first_texts(chunks: DataFrame, by: str, order: list[str], text_col: str, *, count: int = 4, chars: int = 6000) -> DataFrame:
    """``(by, context)``: the first ``count`` texts of each source joined by blank lines, cut to ``chars`` characters."""
    from .chunking import first_per_source

    first = first_per_source(chunks.where(F.col(text_col).isNotNull() & F.col(by).isNotNull()), by, order, count)
    item = F.struct(*order, F.col(text_col).alias("__t"))
    return first.groupBy(by).agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["__t"]), "\n\n"), F.lit(chars)).alias("context"))


def sample_rows(df: DataFrame, key: str, n: int = 5, seed: int = 42, *, ties: tuple[str, ...] = ()) -> DataFrame:
    """``n`` rows, the same on every run: the lowest digests of the seeded key, a distributed top-k; null keys come last, equal ones by ``ties``."""
    return df.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))).asc_nulls_last(), key, *ties).limit(n)
