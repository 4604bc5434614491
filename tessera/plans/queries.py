"""The registered queries over the test tables.

Search queries are the feedback questions (or vectors) whose id is divisible by 100 (in ``retrieval_per_query`` and
``ranker_compare`` all feedback questions), against all documents. A document is relevant to a question if it holds one
of the question's tokens that carry a digit (form numbers and the like).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, catalog, chunking, diversity, evaluation, html, learning, quality, rankings, retrieval, verification
from ..session import cut, shared_dir, spread, table
from ..sources import tables
from ..sources.tables import latest
from ..streaming import logs
from . import reports
from .pipeline import ingest, retrieve

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Every question."""
    return table(spark, d, "feedback_log").where("question IS NOT NULL").select(F.col("feedback_id").alias("query_id"), F.col("question").alias("q_text"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).where("query_id % 100 = 0")


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    marks = _asked(spark, d).select("query_id", F.explode(F.array_distinct(tx.ident_tokens("q_text"))).alias("term")).where(r"term RLIKE '[0-9]'")
    held = _docs(spark, d).select("doc_id", F.explode(F.array_distinct(tx.ident_tokens("text"))).alias("term"))
    return marks.join(held, "term").select("query_id", "doc_id").distinct()


def _bm25(spark: SparkSession, d: str, k: int | None = None) -> DataFrame:
    out = retrieval.ranked(retrieval.bm25_scores(_asked(spark, d), _docs(spark, d), "query_id", "q_text", "doc_id", "text", k=k))
    return out if k is None else out.where(F.col("rank") <= k)


def _lexical(spark: SparkSession, d: str, k: int | None = None) -> DataFrame:
    out = retrieval.ranked(retrieval.lexical_scores(_asked(spark, d), _docs(spark, d), "query_id", "q_text", "doc_id", "text", k=k))
    return out if k is None else out.where(F.col("rank") <= k)


NAMES = ("query_id", "q_text", "doc_id", "text")


def _hybrid(spark: SparkSession, d: str, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """The whole BM25 and word-overlap rankings and what fusion and re-ranking make of them, for queries too many to be sent."""
    asked, docs = _asked(spark, d), _docs(spark, d)
    return retrieval.hybrid_ranks(retrieval.bm25_scores(asked, docs, *NAMES), retrieval.lexical_scores(asked, docs, *NAMES), weights=weights)


# text -----------------------------------------------------------------------------------------------------------------


@query
def tokenize_ident(spark, d):
    t = tx.ident_tokens("text")
    return _docs(spark, d).select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query
def tokenize_plain(spark, d):
    t = F.array_sort(tx.plain_tokens("text"))
    return _docs(spark, d).select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query
def tokens_content(spark, d):
    a, b = (F.array_join(F.array_sort(tx.content_tokens("text", s)), " ") for s in (tx.VERIFY_STOP, tx.RETRIEVAL_STOP))
    return _docs(spark, d).select("doc_id", a.alias("verify_tokens"), b.alias("retrieval_tokens"))


@query
def token_overlap(spark, d):
    log = table(spark, d, "audit_logs")
    return log.select("id", F.round(tx.jaccard(tx.plain_tokens("query"), tx.plain_tokens("answer")), 6).alias("overlap"))


@query
def sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(tx.sentences("text")).alias("pos", "sentence"))


@query
def snippets(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", tx.snippet("text").alias("snippet"))


@query
def cache_keys(spark, d):
    return table(spark, d, "audit_logs").where("query IS NOT NULL").select("id", tx.norm("query").alias("norm_query"), tx.embedding_key("minilm", "query").alias("cache_key"))


@query
def denial_contexts(spark, d):
    return table(spark, d, "knowledge_sources").where("chunk_text IS NOT NULL").select("chunk_id", tx.denies("chunk_text").alias("denies"))


@query
def analysis_parse(spark, d):
    a = tx.analysis("hallucination_analysis")
    return table(spark, d, "audit_logs").select("id", a["score"].alias("score"), a["reason"].alias("reason"))


@query
def analysis_or_text(spark, d):
    log = table(spark, d, "audit_logs").select("id", "hallucination_analysis")
    a = tx.analysis_or_text(log, "hallucination_analysis")
    return log.select("id", a["score"].alias("score"), a["reason"].alias("reason"))


@query
def prompt_windows(spark, d):
    """The stored chunks of each source as numbered windows and as one context, of the first three by number."""
    rows = table(spark, d, "rag_chunks").where("source_title IS NOT NULL AND chunk_text IS NOT NULL").select("source_title", "chunk_id", "chunk_text")
    first = chunking.first_per_source(rows, "source_title", ["chunk_id"], 3, rank="k")
    item = F.struct("k", tx.window_block(F.col("k") - 1, F.col("source_title"), F.col("chunk_text")).alias("w"), tx.full_block(F.col("source_title"), F.col("chunk_text")).alias("f"))
    per = first.groupBy("source_title").agg(F.array_sort(F.collect_list(item)).alias("x"))  # three each
    joined = lambda name: F.md5(F.array_join(F.transform("x", lambda r: r[name]), "\n\n"))
    return per.select("source_title", joined("w").alias("windows"), joined("f").alias("whole"))


@query
def finite_rows(spark, d):
    """Numbers that JSON doesn't have, at three depths, made null."""
    x = F.when(F.col("id") % 3 == 0, float("nan")).when(F.col("id") % 3 == 1, float("inf")).otherwise(F.col("id").cast("double"))
    rows = table(spark, d, "audit_logs").select("id", x.alias("x"), F.array(x, F.lit(1.5)).alias("a"), F.struct(F.array(F.struct(x.alias("z"))).alias("y")).alias("s"))
    return tx.finite_row(rows).select("id", "x", F.get("a", F.lit(0)).alias("first"), F.get("a", F.lit(1)).alias("second"), F.get("s.y", F.lit(0))["z"].alias("deep"))


@query
def feedback_labels(spark, d):
    return table(spark, d, "feedback_log").select("feedback_id", F.coalesce(tx.feedback_label("feedback"), F.lit(0)).alias("label"))


# filter and chunk -----------------------------------------------------------------------------------------------------


@query
def block_signals(spark, d):
    rows = quality.block_signals(spread(table(spark, d, "rag_chunks").select("chunk_id", "chunk_text")), "chunk_text")
    return rows.select("chunk_id", "words", F.round("citation_density", 6).alias("citation_density"), F.round("sentence_density", 6).alias("sentence_density"), F.array_join("reasons", "; ").alias("reasons"))


@query
def block_split(spark, d):
    kept, dropped = quality.split_blocks(table(spark, d, "rag_chunks").select("chunk_id", "chunk_text"), "chunk_text")
    parts = [x.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, x in (("kept", kept), ("dropped", dropped))]
    return parts[0].unionByName(parts[1])


@query
def drop_reasons(spark, d):
    _, dropped = quality.split_blocks(table(spark, d, "rag_chunks").select("source_url", "chunk_text"), "chunk_text")
    return quality.drop_summary(dropped.where("source_url IS NOT NULL"), "source_url")


@query
def chunk_candidates(spark, d):
    rows = spread(table(spark, d, "knowledge_sources").select("chunk_id", "source_title", "chunk_text"))
    return quality.candidates(rows, "chunk_id", "source_title", "chunk_text").select("chunk_id", "source_title")


@query
def chunk_windows(spark, d):
    return chunking.window_chunks(table(spark, d, "rag_chunks").select("chunk_id", "chunk_text"), "chunk_text")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sentence_chunks(spread(table(spark, d, "rag_chunks").select("chunk_id", "source_url", "chunk_text")), "chunk_text")


@query
def chunk_sentences(spark, d):
    return _packed(spark, d).select("chunk_id", "chunk_index", "chunk")


@query
def chunk_sections(spark, d):
    rows = spread(table(spark, d, "rag_chunks").select("chunk_id", "source_title", "chunk_text"))
    out = chunking.section_chunks(rows, "source_title", "chunk_text", size=120, overlap=30)
    return out.select("chunk_id", "chunk_index", F.md5("chunk").alias("chunk_hash"), F.length("chunk").alias("chars"))


@query
def chunk_cap(spark, d):
    rows = table(spark, d, "knowledge_sources").where("source_title IS NOT NULL").select("source_title", "chunk_id")
    return chunking.first_per_source(rows, "source_title", ["chunk_id"], 100)


# sources --------------------------------------------------------------------------------------------------------------


@query
def source_list(spark, d):
    return catalog.list_sources(table(spark, d, "knowledge_sources"))


def _store(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).select(F.col("chunk_id").cast("string").alias("chunk_id"), "source_title", "source_url", "chunk_text")


@query
def source_delete(spark, d):
    listed = table(spark, d, "query_rewrite_training").select("source_url").unionByName(table(spark, d, "rag_chunks").select("source_url"))
    kept, gone = catalog.delete_sources(_store(spark, d, "rag_chunks").unionByName(_store(spark, d, "knowledge_sources")), listed)
    total = gone.agg(F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"), F.count("*").alias("urls"))
    return kept.agg(F.count("*").alias("kept")).crossJoin(total)


@query
def source_refresh(spark, d):
    new = _store(spark, d, "rag_chunks").where("chunk_text IS NOT NULL")
    old = _store(spark, d, "rag_chunks").unionByName(_store(spark, d, "knowledge_sources"))
    return catalog.refresh_sources(old, new)[1]


@query
def trick_context(spark, d):
    return catalog.first_texts(table(spark, d, "knowledge_sources").where("source_title <> ''"), "source_title", ["chunk_id"], "chunk_text")


@query
def rewrite_pairs(spark, d):
    rows = table(spark, d, "query_rewrite_training").where("raw_user_query IS NOT NULL AND rewritten_query IS NOT NULL AND domain IS NOT NULL AND source_title IS NOT NULL AND source_url IS NOT NULL")
    return rows.orderBy("raw_user_query", "rewritten_query", "source_url").limit(50)


@query
def few_shot(spark, d):
    return catalog.sample_rows(table(spark, d, "query_rewrite_training"), "raw_user_query", ties=("rewritten_query",)).select("raw_user_query", "rewritten_query")


@query
def url_titles(spark, d):
    return table(spark, d, "rag_chunks").select("chunk_id", html.url_title("source_url").alias("title"))


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


@query
def feedback_sink(spark, d):
    path = _scratch(spark)
    tables.append_feedback(table(spark, d, "feedback_log").select("feedback_id", "question", "answer", "feedback", "corrected_answer"), path)
    return spark.read.parquet(path).select("feedback_id", "corrected_answer")


@query
def chunk_sink(spark, d):
    path, chunks = _scratch(spark), table(spark, d, "rag_chunks").select("chunk_id", "source_title", "source_url", "chunk_index", "chunk_text")
    vectors = chunks.select("chunk_id", F.array(F.length(F.coalesce("chunk_text", F.lit(""))).cast("float")).alias("embedding"))
    tables.append_chunks(chunks, vectors, "chunk_id", path)
    return spark.read.parquet(path).agg(F.count("*").alias("chunks"), F.count_distinct("chunk_id").alias("keys"))


@query
def csv_source(spark, d):
    path = _scratch(spark)
    table(spark, d, "query_rewrite_training").select("raw_user_query", "rewritten_query", "domain", "source_title", "source_url").write.csv(path, header=True, escape='"', nullValue="\\N")
    rows = tables.read_csv(spark, path, tables.REWRITES)
    return rows.select(*(F.when(F.col(c) != "\\N", F.col(c)).alias(c) for c in ("raw_user_query", "rewritten_query", "domain")))


@query
def fallback_source(spark, d):
    """The training pairs from the first place that holds any: a folder that isn't there, an empty one, then a CSV file."""
    path, empty = _scratch(spark), _scratch(spark)
    rows = table(spark, d, "query_rewrite_training").select("raw_user_query", "rewritten_query", "domain", "source_title", "source_url")
    rows.limit(0).write.parquet(empty)
    rows.write.csv(f"{path}.csv", header=True, escape='"', nullValue="\\N")
    got = tables.first_available(spark, tables.REWRITES, _scratch(spark), empty, f"{path}.csv")
    return got.select("raw_user_query", F.when(F.col("domain") != "\\N", F.col("domain")).alias("domain"))


@query
def jsonl_source(spark, d):
    path = _scratch(spark)
    log = table(spark, d, "feedback_log").where("question IS NOT NULL")
    log.select(F.col("feedback_id").cast("string").alias("id"), F.col("question").alias("query"), F.array(F.lit("a")).alias("relevant_ids")).write.json(path)
    return tables.read_jsonl(spark, path, tables.QRELS).select("id", "query")


@query
def dangling(spark, d):
    """Chunks whose number is no document's."""
    pairs = table(spark, d, "rag_chunks").select(F.col("chunk_id").alias("query_id"), F.col("chunk_index").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    return evaluation.dangling(pairs, table(spark, d, "documents").select("doc_id"))


@query
def url_check(spark, d):
    return html.url_check(table(spark, d, "knowledge_sources").select("chunk_id", "source_url"), "source_url").select("chunk_id", "host", "valid")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of the stored texts: each line a paragraph, under the title, beside furniture the parser must drop."""
    rows = spread(table(spark, d, "rag_chunks").where("chunk_text IS NOT NULL"))
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform(F.split("chunk_text", "\n"), lambda x: F.concat(F.lit("<p>"), safe(x))), "")
    page = F.concat(F.lit("<html><nav><li>Home and everything else that a menu may hold</li></nav><h1>"), safe(F.coalesce("source_title", F.lit(""))), F.lit("</h1>"), body, F.lit("<footer><p>All rights reserved</p></footer></html>"))
    return rows.select(F.col("chunk_id").alias("page_id"), F.coalesce("source_url", F.lit("")).alias("url"), page.alias("html"))


@query
def html_blocks(spark, d):
    blocks = html.page_blocks(_pages(spark, d), "page_id", "html").where("tag = 'p' AND text <> ''")
    return blocks.groupBy("page_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


@query
def html_titles(spark, d):
    return html.page_blocks(_pages(spark, d), "page_id", "html").where("tag = 'title'").select("page_id", "title")


@query
def page_titles(spark, d):
    out = html.page_text(_pages(spark, d), "page_id", "html")
    return out.select("page_id", "title", F.length("raw_text").alias("chars"))


@query
def ingest_pages(spark, d):
    store = table(spark, d, "rag_chunks").select("chunk_id", "source_title", "source_url", "chunk_index", "chunk_text")
    return ingest(_pages(spark, d), "page_id", "url", "html", store)[1]


# retrieval ------------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 100 = 0"), v


@query
def cosine_topk(spark, d):
    q, v = _vectors(spark, d)
    return retrieval.cosine_topk(q, v, "vec_id", "embedding", 15).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query
def bm25_index(spark, d):
    _, terms, _ = retrieval.bm25_index(_docs(spark, d), "doc_id", "text")
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk(spark, d):
    return _bm25(spark, d, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query
def bm25_all_docs(spark, d):
    asked, docs = _asked(spark, d), _docs(spark, d)
    full = rankings.bm25_all(asked, docs, *NAMES)
    if full is None:
        scores = retrieval.bm25_scores(asked, docs, *NAMES)
        full = retrieval.ranked(retrieval.with_zeros(scores, asked, docs, "query_id", "doc_id"))
    return full.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query
def lexical_rank(spark, d):
    return _lexical(spark, d, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _fused(spark: SparkSession, d: str, weights: tuple[float, float]) -> DataFrame:
    rows = rankings.fused_top(_asked(spark, d), _docs(spark, d), *NAMES, limit=20, weights=weights)
    if rows is None:
        rows = _hybrid(spark, d, weights).where("fused_rank <= 20").select("query_id", "doc_id", F.col("fused").alias("score"), F.col("fused_rank").alias("rank"))
    return rows.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query
def rrf_fuse(spark, d):
    return _fused(spark, d, (1.0, 1.0))


@query
def rrf_weighted(spark, d):
    return _fused(spark, d, (2.0, 0.5))


def _dense(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, and their whole dense and BM25 scorings: each document with a vector, asked by its own text and vector."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    docs = _docs(spark, d).join(v.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    asked = docs.where("doc_id % 100 = 0 AND text IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("text").alias("q_text"))
    held = v.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    barred = held.join(asked.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").withColumn("bar", F.lit(-2.0))
    dense = retrieval.cosine_above(barred, held, "vec_id", "embedding", "bar").where("query_id <> doc_id").select("query_id", "doc_id", "score")
    words = retrieval.bm25_scores(asked, docs, "query_id", "q_text", "doc_id", "text").where("query_id <> doc_id")
    return asked, dense, words


@query
def rrf_dense(spark, d):
    _, dense, words = _dense(spark, d)
    rows = retrieval.hybrid_ranks(dense, words).where("fused_rank <= 20")
    return rows.select("query_id", "doc_id", F.round("fused", 6).alias("score"), F.col("fused_rank").alias("rank"))


@query
def pool_rerank(spark, d):
    whole = rankings.reranked(_asked(spark, d), _docs(spark, d), *NAMES)
    if whole is not None:
        return whole
    rows = _hybrid(spark, d).where("first_rank IS NOT NULL")
    return rows.select("query_id", "doc_id", "first_rank", F.col("reranked").alias("rank"))


def _mmr(spark: SparkSession, d: str, trade: float) -> DataFrame:
    rows = _bm25(spark, d, 15).join(_docs(spark, d), "doc_id")
    return diversity.mmr(rows, k=6, trade=trade)


@query
def mmr_50(spark, d):
    return _mmr(spark, d, 0.5)


@query
def mmr_80(spark, d):
    return _mmr(spark, d, 0.8)


@query
def mmr_100(spark, d):
    return _mmr(spark, d, 1.0)


@query
def mmr_hook(spark, d):
    """Diversity with another similarity: the share of the smaller text's tokens that both hold."""
    rows = _bm25(spark, d, 15).join(_docs(spark, d), "doc_id")
    share = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))
    return diversity.mmr(rows, k=6, trade=0.6, similarity=share)


@query
def unique_sources(spark, d):
    urls = table(spark, d, "documents").select("doc_id", "source_title", F.col("source").alias("source_url"))
    out = retrieval.unique_sources(_bm25(spark, d, 20).join(urls, "doc_id"))
    return out.select("query_id", "source_url", "source_title", "pos")


@query
def retrieve_prompts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source_title", "text")
    out = retrieve(_asked(spark, d), docs, "query_id", "q_text", "doc_id", "source_title", "text")
    return out.select("query_id", F.length("prompt").alias("chars"), F.md5("prompt").alias("prompt_hash"))


# evaluation -----------------------------------------------------------------------------------------------------------


RUNS = ["1_lexical", "2_bm25", "3_fused", "4_reranked", "5_oracle"]


def _evaluated(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """Metrics of every run and query of ``asked`` from whole rankings, which are made once; only ranks of relevant documents go on."""
    hits = rankings.found(asked, docs, *NAMES, runs=RUNS, most=max(evaluation.CUTS))
    return evaluation.metrics_of_hits(hits, asked, RUNS)


@query
def retrieval_per_query(spark, d):
    per = _evaluated(_questions(spark, d), _docs(spark, d))
    return per.select("run", "query_id", *(F.round(c, 6).alias(c) for c in per.columns[2:]))


@query
def ranker_compare(spark, d):
    return evaluation.against_previous(evaluation.mean_metrics(_evaluated(_questions(spark, d), _docs(spark, d))))


def _text(spark: SparkSession, report: str) -> DataFrame:
    return spark.createDataFrame([(report,)], "report string")


@query
def report_rankers(spark, d):
    means = evaluation.against_previous(evaluation.mean_metrics(_evaluated(_asked(spark, d), _docs(spark, d))))
    means = means.orderBy("run").collect()  # a row a run
    return _text(spark, reports.rankers([r.asDict() for r in means], (1, 3)))


@query
def report_classes(spark, d):
    judged = _judged(spark, d)
    per = {r["label"]: r.asDict() for r in verification.class_metrics(judged).collect()}
    cells = [r.asDict() for r in verification.confusion(judged).collect()]
    return _text(spark, reports.classification([per[x] for x in verification.LABELS], verification.overall_metrics(judged).first().asDict(), cells))


@query
def run_detail(spark, d):
    out = evaluation.run_detail(_bm25(spark, d, 5), _relevant(spark, d), _asked(spark, d), 5)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("query_id", text("relevant").alias("relevant"), text("top").alias("top"), "hit")


@query
def diversity_sweep(spark, d):
    """Mean metrics at 5 of the diversified pool for each trade of relevance for diversity, beside the mean redundancy."""
    pool, rel = cut(_bm25(spark, d, 15).join(_docs(spark, d), "doc_id")), cut(_relevant(spark, d))
    runs = None
    for trade in (1.0, 0.9, 0.8, 0.7, 0.5):
        part = diversity.mmr(pool, k=6, trade=trade).select(F.lit(f"{trade:.1f}").alias("run"), "query_id", "doc_id", F.col("pos").alias("rank"))
        runs = part if runs is None else runs.unionByName(part)
    per = evaluation.per_query_metrics(runs, rel, _asked(spark, d), runs=[f"{t:.1f}" for t in (1.0, 0.9, 0.8, 0.7, 0.5)])
    return evaluation.mean_metrics(per).select("run", "queries", "mrr", "hit_5", "ndcg_5")


@query
def oracle_full(spark, d):
    sums = rankings.oracle_sums(_asked(spark, d), _docs(spark, d), *NAMES, weight=lambda ids: np.fmod(ids, 97))
    if sums is not None:
        return sums
    every = retrieval.oracle_full(_docs(spark, d).select("doc_id"), _relevant(spark, d), _asked(spark, d))
    return every.groupBy("query_id").agg(F.count("*").alias("ranked"), F.sum(F.col("rank") * (F.col("doc_id") % 97)).alias("checksum"))


def _screened(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    gold = q.select(F.col("vec_id").alias("query_id"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 2)).alias("doc_id"))
    bars = evaluation.gold_bars(retrieval.cosine_of(gold, v, "vec_id", "embedding"))
    barred = q.join(bars, F.col("vec_id") == F.col("query_id"))
    over = retrieval.cosine_above(barred, v, "vec_id", "embedding", "bar").where("query_id <> doc_id")
    return evaluation.screen_candidates(over, gold)


@query
def distractor_screen(spark, d):
    return _screened(spark, d).select("doc_id", "query_id", *(F.round(c, 6).alias(c) for c in ("score", "bar", "margin")))


@query
def distractor_rejects(spark, d):
    out = evaluation.top_rejects(_screened(spark, d))
    return out.select("doc_id", "query_id", F.round("margin", 6).alias("margin"), "remaining")


@query
def gold_corpus(spark, d):
    return evaluation.gold_corpus(table(spark, d, "rag_chunks").select("chunk_id"), "chunk_id")


@query
def valid_chunks(spark, d):
    return chunking.valid_chunks(table(spark, d, "knowledge_sources").select("chunk_id", "chunk_text"), "chunk_id", "chunk_text").select("chunk_id")


def _solved(spark: SparkSession, d: str) -> DataFrame:
    q = _asked(spark, d).select("query_id", F.explode(tx.content_tokens("q_text", tx.RETRIEVAL_STOP)).alias("t"))
    size = q.groupBy("query_id").agg(F.count("*").alias("n"))
    first = _lexical(spark, d, 1)
    held = _docs(spark, d).join(F.broadcast(first.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.explode(tx.content_tokens("text", tx.RETRIEVAL_STOP)).alias("t"))
    both = first.select("query_id", "doc_id").join(q, "query_id").join(held, ["doc_id", "t"])
    both = both.groupBy("query_id", "doc_id").agg(F.count("*").alias("k"), F.collect_set("t").alias("shared")).join(size, "query_id")  # a query's tokens
    return evaluation.transparency(first, _relevant(spark, d), both.select("query_id", "doc_id", (F.col("k") / F.col("n")).alias("overlap"), "shared"))


@query
def transparency(spark, d):
    return _solved(spark, d).select("query_id", "doc_id", "overlap", F.array_join("shared", " ").alias("shared"), "pos")


@query
def share_solved(spark, d):
    return evaluation.share_solved(_solved(spark, d), _asked(spark, d)).select("solved", "queries", F.round("share", 6).alias("share"))


@query
def ranking_review(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source_title", F.lit("")).alias("source_title"), "text")
    heads = rankings.overlap_heads(_asked(spark, d), _docs(spark, d), *NAMES, top=3)
    if heads is None:
        ranked, relevant = _lexical(spark, d), _relevant(spark, d)
    else:
        heads = cut(heads)
        ranked, relevant = heads.where("rank > 0").drop("is_rel"), heads.where("is_rel").select("query_id", "doc_id")
    out = evaluation.ranking_review(ranked, relevant, docs=docs)
    shown = F.array_join(F.transform("beaten", lambda x: F.concat_ws(": ", x["source_title"], x["text"])), " | ")
    return out.select("query_id", "gold_rank", F.array_join(F.transform("beaten_by", lambda x: x.cast("string")), ",").alias("beaten_by"), F.coalesce(shown, F.lit("")).alias("beaten"))


# verification ---------------------------------------------------------------------------------------------------------


@query
def lexical_verifier(spark, d):
    share = verification.support("answer", F.array(F.coalesce("question", F.lit("")), F.coalesce("corrected_answer", F.lit(""))))
    rows = table(spark, d, "feedback_log").select("feedback_id", F.coalesce(share, F.lit(0.0)).alias("share"))
    return rows.select("feedback_id", F.round("share", 3).alias("overlap"), verification.lexical_verdict(F.col("share")).alias("verdict"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """The claims (sentences) of each answer and the verdicts on each against two windows, the question and its rewriting, by word support."""
    log = spread(table(spark, d, "audit_logs").select("id", "query", "rewritten_query", "answer"))
    rows = log.withColumn("claims", verification.kept_claims(tx.sentences("answer")))
    word = lambda s: F.when(s >= 0.3, "Entailed ").when(s > 0.1, "baseless").when(s > 0, "unknown").otherwise("contradicted")
    found = verification.shares(F.col("claims"), F.array(F.coalesce("query", F.lit("")), F.coalesce("rewritten_query", F.lit(""))))
    return rows.select("id", "claims", F.transform(found, lambda x: F.transform(x, word)).alias("verdicts"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _claims(spark, d).select("id", F.posexplode("verdicts").alias("claim", "v"))
    return rows.select("id", "claim", F.posexplode("v").alias("window", "verdict"))


@query
def or_join(spark, d):
    return verification.over_windows(_windows(spark, d), ["id", "claim"], "verdict")


@query
def aggregate_verdict(spark, d):
    joined = F.transform("verdicts", verification.claim_verdict)
    return _claims(spark, d).select("id", verification.answer_verdict(joined).alias("verdict"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the two passes as JSON: the first leaves out every third claim, numbers claims as text, gives the first
    claim an empty list before its verdicts and adds a claim that isn't there; the second, fenced, speaks of even claims."""
    item = lambda i, v, e: F.struct(i.cast("string").alias("claim_index"), v.alias("window_verdicts"), e.alias("evidence"), F.lit("query").alias("source_title"))
    per = F.transform("claims", lambda c, i: item(i, F.get(F.col("verdicts"), i), F.left(c, F.lit(20))))
    per = F.filter(per, lambda x: x["claim_index"].cast("int") % 3 != 2)
    empty = F.array().cast("array<string>")
    first = F.array(item(F.lit(0), empty, F.lit("none")), item(F.lit(99), empty, F.lit("none")))
    second = F.transform("claims", lambda c, i: F.struct(i.alias("claim_index"), F.when(F.length(c) % 2 == 0, " Entailed").otherwise("Contradicted").alias("verdict"), F.right(c, F.lit(10)).alias("evidence")))
    second = F.filter(second, lambda x: x["claim_index"] % 2 == 0)
    return _claims(spark, d).select("id", "claims", F.to_json(F.concat(first, per)).alias("local"), F.concat(F.lit("```json\n"), F.to_json(second), F.lit("\n```")).alias("global"))


@query
def local_verdicts(spark, d):
    rows = _payloads(spark, d).select("id", F.posexplode(verification.local_verdicts(F.col("claims"), "local")).alias("claim", "r"))
    return rows.select("id", "claim", F.array_join("r.verdicts", ",").alias("verdicts"), "r.verdict", "r.evidence", "r.source_title")


@query
def final_verdicts(spark, d):
    rows = _payloads(spark, d).withColumn("first", verification.local_verdicts(F.col("claims"), "local"))
    asked = F.array_join(F.transform(verification.unresolved(F.col("first")), lambda i: i.cast("string")), ",")
    rows = rows.select("id", asked.alias("unresolved"), F.posexplode(verification.final_verdicts(F.col("claims"), F.col("first"), "global")).alias("claim", "r"))
    return rows.select("id", "claim", "unresolved", "r.verdict", "r.evidence", "r.source_title")


@query
def judged_cases(spark, d):
    """Every case by the lexical verifier; the mark of the feedback stands for its gold verdict."""
    log = table(spark, d, "feedback_log").withColumn("gold", F.when(tx.feedback_label("feedback") == 1, "entailed").otherwise("baseless"))
    contexts = F.array(F.coalesce("question", F.lit("")), F.coalesce("corrected_answer", F.lit("")))
    return verification.judged_cases(log, "lexical", "answer", contexts, "gold", ["feedback_id"])


@query
def oracle_cases(spark, d):
    log = table(spark, d, "feedback_log").withColumn("gold", F.when(tx.feedback_label("feedback") == 1, "entailed").otherwise("baseless"))
    return verification.judged_cases(log, "oracle", "answer", F.array(F.col("question")), "gold", ["feedback_id"])


@query
def rare_labels(spark, d):
    log = table(spark, d, "feedback_log").select(F.coalesce(F.lower(tx.strip("feedback")), F.lit("")).alias("gold"))
    return verification.too_few(log, 500)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "audit_logs")
    log = log.select(F.lower(tx.strip("risk_level")).alias("level"), tx.analysis("hallucination_analysis")["score"].alias("score"))
    level, score = F.col("level"), F.col("score")
    gold = F.when(level == "low", "entailed").when(level == "medium", "baseless").when(level == "high", "contradicted").otherwise("none")
    pred = F.when(score == 0, "entailed").when(score == 1, "baseless").when(score == 2, "contradicted").otherwise("none")
    return log.select(gold.alias("gold"), pred.alias("pred"))


@query
def confusion_matrix(spark, d):
    return verification.confusion(_judged(spark, d))


@query
def class_metrics(spark, d):
    return verification.class_metrics(_judged(spark, d))


@query
def overall_metrics(spark, d):
    return verification.overall_metrics(_judged(spark, d))


# learning -------------------------------------------------------------------------------------------------------------


def _features(spark: SparkSession, d: str) -> DataFrame:
    log = spread(table(spark, d, "audit_logs").select("id", "answer", "hallucination_analysis", "risk_level")).withColumn("claims", tx.sentences("answer"))
    claims = F.col("claims")
    named = F.transform(claims, lambda c: F.when(tx.denies(c), "Contradicted").when(F.length(c) % 2 == 0, "entailed").otherwise("other"))
    null = F.lit(None).cast("int")
    return learning.answer_features(
        log, score=tx.analysis("hallucination_analysis")["score"], risk=null, level=F.col("risk_level"), contexts=null, verdicts=named, sources=F.size(claims), answer="answer"
    )


@query
def answer_features(spark, d):
    return _features(spark, d).select("id", *(F.round(c, 6).alias(c) for c in learning.FEATURES))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "feedback_log").where("question IS NOT NULL")
    a, q = tx.plain_tokens("answer"), tx.plain_tokens("question")
    rows = log.select("feedback_id", F.coalesce(tx.feedback_label("feedback"), F.lit(0)).alias("label"), a.alias("a"), q.alias("q"), F.coalesce("answer", F.lit("")).alias("t"))
    return rows.select(
        "feedback_id", "label", F.size("a").cast("double").alias("n_answer"), F.size("q").cast("double").alias("n_question"),
        tx.jaccard(F.col("a"), F.col("q")).alias("overlap"), F.col("t").rlike(r"[.!?]\s*$").cast("double").alias("stopped"),
    )


_TEXT_FEATURES = ("n_answer", "n_question", "overlap", "stopped")


@query
def quality_predict(spark, d):
    rows = learning.split_by_class(_labelled(spark, d), "feedback_id", "label")
    model = learning.quality_model(rows.where("NOT held_out"), "label", _TEXT_FEATURES)
    return learning.predict_quality(model, rows.where("held_out"), _TEXT_FEATURES).select("feedback_id", "label", F.round("quality", 4).alias("quality"))


@query
def quality_auc(spark, d):
    return learning.auc(_labelled(spark, d), "label", "overlap").select(F.round("auc", 6).alias("auc"))


@query
def quality_report(spark, d):
    out = learning.training_report(_labelled(spark, d), "feedback_id", "label", _TEXT_FEATURES)
    return out.select(*(F.round(F.col(c).cast("double"), 4).alias(c) for c in out.columns))


@query
def quality_trees(spark, d):
    rows = learning.split_by_class(_labelled(spark, d), "feedback_id", "label")
    model = learning.quality_model(rows.where("NOT held_out"), "label", _TEXT_FEATURES, trees=True)
    return learning.predict_quality(model, rows.where("held_out"), _TEXT_FEATURES).select("feedback_id", "label", F.round("quality", 4).alias("quality"))


@query
def quality_weights(spark, d):
    model = learning.quality_model(_labelled(spark, d), "label", _TEXT_FEATURES)
    return spark.createDataFrame(learning.coefficients(model, _TEXT_FEATURES), "feature string, weight double")  # a row a feature


@query
def quality_split(spark, d):
    return learning.split_by_class(_labelled(spark, d), "feedback_id", "label").groupBy("label").agg(F.count("*").alias("n"), F.count_if("held_out").alias("held_out"))


@query
def quality_rule(spark, d):
    m = learning.binary_metrics(_labelled(spark, d), "label", "overlap", 0.3)
    return m.select(*(F.round(F.col(c).cast("double"), 6).alias(c) for c in m.columns))


# audit ----------------------------------------------------------------------------------------------------------------


@query
def audit_stats(spark, d):
    return audit.risk_stats(table(spark, d, "audit_logs"), "risk_level")


@query
def audit_stats_latest(spark, d):
    return audit.risk_stats(latest(table(spark, d, "audit_logs").select("id", "risk_level"), "id"), "risk_level")


@query
def top_questions(spark, d):
    return audit.top_questions(table(spark, d, "audit_logs"), "query")


@query
def recent_logs(spark, d):
    return audit.recent(table(spark, d, "audit_logs").select("id", "query", "risk_level", "created_at"), "id", "created_at").select("id", "query", "risk_level")


@query
def audit_page(spark, d):
    return audit.page_of(table(spark, d, "audit_logs").select("id", "created_at"), "id", "created_at", 3).select("id", "pos", "pages")


@query
def cache_hits(spark, d):
    out = audit.cache_hits(table(spark, d, "audit_logs"), "query", "created_at")
    return out.groupBy("key").agg(F.count_if(~F.col("hit")).alias("misses"), F.sum("n").alias("accesses"))


@query
def cache_stats(spark, d):
    return audit.cache_stats(audit.cache_hits(table(spark, d, "audit_logs"), "query", "created_at"))


@query
def log_report(spark, d):
    log = table(spark, d, "audit_logs").select("id", "query", "risk_level", "created_at")
    out = audit.log_report(log, "id", "created_at", "query")
    ids = F.array_join(F.transform("logs", lambda r: r["id"].cast("string")), ",")
    top = F.array_join(F.transform("top_questions", lambda r: F.concat_ws("=", r["question"], r["n"].cast("string"))), "|")
    return out.select("count", "returned", ids.alias("logs"), top.alias("top_questions"))


def _accesses(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "audit_logs").where("created_at IS NOT NULL").withColumn("key", tx.norm("query")).where("key <> ''")
    return log.select("id", "key", "query", "created_at", F.unix_timestamp(F.col("created_at").cast("timestamp")).alias("at"))


@query
def lru_hits(spark, d):
    out = audit.lru_trace(_accesses(spark, d), "key", ["at", "id"], size=256)
    return out.select("seq", F.md5("key").alias("key"), "hit")


@query
def lru_ttl(spark, d):
    out = audit.lru_trace(_accesses(spark, d), "key", ["at", "id"], size=256, ttl=3600.0, time_col="at")
    return out.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count("evicted").alias("evicted"))


@query
def cached_answers(spark, d):
    """What a cache that holds each question's first answer finds for every request, up to a day later, emptied at noon of the middle day."""
    log = _accesses(spark, d)
    first = table(spark, d, "audit_logs").where("created_at IS NOT NULL AND answer IS NOT NULL").withColumn("key", tx.norm("query")).where("key <> ''")
    at = F.unix_timestamp(F.col("created_at").cast("timestamp"))
    first = first.groupBy("key").agg(F.min_by(F.md5("answer"), F.struct(at, F.col("id"))).alias("value"), F.min(at).alias("set_at"))
    ends = log.agg(F.floor((F.min("at") + F.max("at")) / 2).alias("m")).first()[0] or 0
    out = audit.cached_values(log, first, "query", "created_at", ttl=86400.0, cleared=F.lit(float(ends // 86400 * 86400 + 43200)))
    return out.select("id", "value")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The audit log as a stream of its files."""
    kind = table(spark, d, "audit_logs").schema
    return spark.readStream.schema(kind).parquet(f"{d}/audit_logs.parque[t]").select("id", "query", "risk_level", "created_at")


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """What the stream has given when all that is there has been read."""
    name = f"run_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", _scratch(stream.sparkSession)).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def _appended(stream: DataFrame) -> DataFrame:
    """The same of a stream that only adds rows, by way of files: they are as many as its input, too many for the driver."""
    path, spark = _scratch(stream.sparkSession), stream.sparkSession
    logs.append_audit(stream, path, _scratch(spark)).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query
def stream_append(spark, d):
    path = _scratch(spark)
    logs.append_audit(_stream(spark, d), path, _scratch(spark)).awaitTermination()
    return spark.read.parquet(path).select("id", "risk_level")


@query
def stream_risk_counts(spark, d):
    out = _run(logs.risk_counts(_stream(spark, d), "created_at", "risk_level"), "complete")
    return out.groupBy(F.unix_timestamp("from").alias("hour"), F.coalesce("level", F.lit("")).alias("level")).agg(F.sum("n").alias("n"))


@query
def stream_cache(spark, d):
    out = _appended(logs.cached_answers(_stream(spark, d), "query", "created_at"))
    return out.groupBy("key").agg(F.count_if(~F.col("hit")).alias("misses"), F.count("*").alias("accesses"))


@query
def risk_by_hour(spark, d):
    rows = table(spark, d, "audit_logs").where("created_at IS NOT NULL")
    hour = F.date_trunc("hour", F.col("created_at").cast("timestamp"))
    return rows.groupBy(F.unix_timestamp(hour).alias("hour"), F.coalesce(tx.strip("risk_level"), F.lit("")).alias("level")).agg(F.count("*").alias("n"))
