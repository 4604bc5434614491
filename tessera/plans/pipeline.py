"""The two workflows as lazy plans: ingesting pages, and retrieving contexts for a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import context_block
from ..operators.catalog import refresh_sources
from ..operators.chunking import chunk_key, first_per_source, section_chunks
from ..operators.diversity import mmr
from ..operators.html import page_sections
from ..operators.quality import split_blocks
from ..operators.rankings import bm25_top
from ..operators.retrieval import bm25_scores, overlap_of, ranked, rerank_pool
from ..session import cut

POOL, FINAL, TRADE = 15, 6, 0.8
MOST_WANTED = 500_000  # ids that are broadcast


def ingest(pages: DataFrame, id_col: str, url_col: str, html_col: str, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(new store, report)`` after extracting, filtering, chunking and capping the pages and replacing their sources.

    ``store(chunk_id, source_title, source_url, chunk_index, chunk_text)``.
    """
    sections = page_sections(pages, id_col, html_col).select("page_id", "title", F.posexplode("sections").alias("section", "s"))
    chunks = section_chunks(sections.select("page_id", "title", "section", F.col("s.heading").alias("heading"), F.col("s.text").alias("text")), "heading", "text")
    kept, _ = split_blocks(chunks, "chunk")
    capped = first_per_source(kept, "page_id", ["section", "chunk_index"], rank="place")
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("source_url"))
    order = F.col("place") - 1
    new = capped.join(urls, "page_id").select(
        chunk_key("source_url", order).alias("chunk_id"), F.col("title").alias("source_title"), "source_url", order.cast("int").alias("chunk_index"), F.col("chunk").alias("chunk_text")
    )
    return refresh_sources(store, new)


def retrieve(questions: DataFrame, docs: DataFrame, q_id: str, q_text: str, d_id: str, d_title: str, d_text: str) -> DataFrame:
    """``(query_id, prompt)``: BM25 pool, lexical re-ranking, diversity, and the contexts assembled in order."""
    first = bm25_top(questions, docs, q_id, q_text, d_id, d_text, k=POOL)
    if first is None:
        first = ranked(bm25_scores(questions, docs, q_id, q_text, d_id, d_text, k=POOL)).where(F.col("rank") <= POOL)
    first = cut(first)  # POOL rows a query
    texts = docs.select(F.col(d_id).alias("doc_id"), F.col(d_text).alias("text"), F.coalesce(F.col(d_title), F.lit("Unknown Source")).alias("title"))
    wanted = first.select("doc_id").distinct()
    texts = cut(texts.join(F.broadcast(wanted) if wanted.count() <= MOST_WANTED else wanted, "doc_id", "left_semi"))
    second = overlap_of(first.select("query_id", "doc_id"), questions, texts, q_id, q_text)
    pool = rerank_pool(first, second, POOL).join(second, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    rows = pool.join(texts, "doc_id")
    chosen = mmr(rows, k=FINAL, trade=TRADE, pool=POOL).join(texts, "doc_id")
    item = F.struct("pos", context_block(F.col("title"), F.col("text")).alias("block"))
    return chosen.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["block"]), "\n\n").alias("prompt"))
