"""Rankings made query by query against those of joins and windows."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import evaluation, rankings, retrieval
from tessera.plans import queries as registered
from tessera.plans.pipeline import retrieve


LETTERS = [f"{chr(97 + i // 6)}x{chr(97 + i % 6)}" for i in range(40)]


def _words(spark):
    rng = random.Random(5)
    words = [*LETTERS, "the", "of", "H-1B", "i-9", "2024"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(0, 25))) if i % 50 else None) for i in range(300)], "d long, t string").repartition(5)
    return spark.createDataFrame([(i, " ".join(rng.choices(words, k=6))) for i in range(9)] + [(98, "zzz"), (99, "of 2024")], "q int, t string"), docs


def _writes(spark, made):
    """Bytes that ``made(spark)`` shuffles."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30000)
        own = context.statusStore().executorList(False)
        return sum(own.apply(i).totalShuffleWrite() for i in range(own.size()))

    before = written()
    made(spark)
    return written() - before


NAMES = ("q", "t", "d", "t")


def _whole(asked, docs, **more):
    return retrieval.hybrid_ranks(retrieval.bm25_scores(asked, docs, *NAMES), retrieval.lexical_scores(asked, docs, *NAMES), **more)


@pytest.mark.parametrize("weights", [(1.0, 1.0), (2.0, 0.5)])
def test_fusion_by_query(spark, weights):
    asked, docs = _words(spark)
    whole = {tuple(r) for r in _whole(asked, docs, weights=weights).where("fused_rank <= 20").select("query_id", "doc_id", F.round("fused", 9), "fused_rank").collect()}
    got = rankings.fused_top(asked, docs, *NAMES, limit=20, weights=weights)
    assert {tuple(r) for r in got.select("query_id", "doc_id", F.round("score", 9), "rank").collect()} == whole
    named = docs.withColumn("d", F.concat(F.lit("id"), F.col("d").cast("string")))
    whole = {tuple(r) for r in _whole(asked, named, weights=weights).where("fused_rank <= 20").select("query_id", "doc_id", "fused_rank").collect()}
    assert {tuple(r) for r in rankings.fused_top(asked, named, *NAMES, limit=20, weights=weights).select("query_id", "doc_id", "rank").collect()} == whole
    assert rankings.fused_top(asked, docs.limit(0), *NAMES, limit=20).count() == 0 and rankings.fused_top(asked.limit(0), docs, *NAMES, limit=20).count() == 0
    more = docs.unionByName(spark.createDataFrame([(None, "axb axc"), (None, "axd")], "d long, t string"))  # counted, not ranked
    assert rankings.fused_top(asked, more, *NAMES, limit=400).where("doc_id IS NULL").count() == 0


def test_pool_by_query(spark):
    asked, docs = _words(spark)
    whole = {tuple(r) for r in _whole(asked, docs).where("first_rank IS NOT NULL").select("query_id", "doc_id", "first_rank", "reranked").collect()}
    assert {tuple(r) for r in rankings.reranked(asked, docs, *NAMES).select("query_id", "doc_id", "first_rank", "rank").collect()} == whole


def test_all_documents_by_query(spark):
    asked, docs = _words(spark)
    full = retrieval.ranked(retrieval.with_zeros(retrieval.bm25_scores(asked, docs, *NAMES), asked, docs, "q", "d"))
    whole = {(r["query_id"], r["doc_id"], r["rank"]) for r in full.collect()}
    got = rankings.bm25_all(asked, docs, *NAMES)
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got.collect()} == whole and len(whole) == 11 * 300
    assert all(r["score"] == 0 for r in got.where("query_id = 98").collect())


def _relevant(asked, docs):
    terms = lambda x, i, name: x.select(F.col(i).alias(name), F.explode(F.array_distinct(tx.ident_tokens("t"))).alias("term"))
    return terms(asked, "q", "query_id").where("term RLIKE '[0-9]'").join(terms(docs, "d", "doc_id"), "term").select("query_id", "doc_id").distinct()


def test_metrics_by_query(spark):
    asked, docs = _words(spark)
    rel = _relevant(asked, docs).cache()
    rows = _whole(asked, docs).join(rel, ["query_id", "doc_id"])
    runs = retrieval.oracle_ranking(docs.select(F.col("d").alias("doc_id")), rel).select(F.lit("5").alias("run"), "query_id", "doc_id", "rank")
    for name, c in zip("1234", ("second_rank", "first_rank", "fused_rank", "reranked")):
        runs = runs.unionByName(rows.where(F.col(c).isNotNull()).select(F.lit(name).alias("run"), "query_id", "doc_id", F.col(c).alias("rank")))
    queries = asked.select(F.col("q").alias("query_id"))
    whole = evaluation.per_query_metrics(runs, rel, queries, runs=list("12345"))
    hits = rankings.found(asked, docs, *NAMES, runs=list("12345"), most=5)
    close = lambda df: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()}
    assert close(evaluation.metrics_of_hits(hits, queries, list("12345"))) == close(whole) and whole.count() == 55


def test_review_by_query(spark):
    asked, docs = _words(spark)
    asked = asked.unionByName(spark.createDataFrame([(i, " ".join([*LETTERS[i : i + 5], "2024"])) for i in range(20, 36)], "q int, t string"))
    rel = _relevant(asked, docs)
    whole = evaluation.ranking_review(retrieval.ranked(retrieval.lexical_scores(asked, docs, *NAMES)), rel).collect()
    heads = rankings.overlap_heads(asked, docs, *NAMES, top=3)
    got = evaluation.ranking_review(heads.where("rank > 0").drop("is_rel"), heads.where("is_rel").select("query_id", "doc_id")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, whole)) and whole


def test_oracle_sums_are_those_of_the_whole_ranking(spark):
    asked, docs = _words(spark)
    ids = docs.select(F.col("d").alias("doc_id"))
    every = retrieval.oracle_full(ids, _relevant(asked, docs), asked.select(F.col("q").alias("query_id")))
    whole = every.groupBy("query_id").agg(F.count("*").alias("ranked"), F.sum(F.col("rank") * (F.col("doc_id") % 97)).alias("checksum"))
    got = rankings.oracle_sums(asked, docs, *NAMES, weight=lambda x: x % 97)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in whole.collect()} and got.count() == 11


@pytest.mark.parametrize("name", ["rrf_fuse", "rrf_weighted", "pool_rerank", "bm25_all_docs", "oracle_full", "retrieval_per_query", "ranker_compare", "report_rankers", "ranking_review"])
def test_no_ranking_is_shuffled(spark, name, tmp_path):
    """What is shuffled is the documents' index, some hundred kB here; 600,000 pairs of a query and a document take 5 MB and more."""
    docs = [(i, f"w{i % 7} w{i % 11} a{i % 13} b{i % 17} 2024", "T", "u") for i in range(6000)]
    spark.createDataFrame(docs, "doc_id long, text string, source_title string, source string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i * 100, f"w{i % 7} w{i % 11} a{i % 13} b{i % 17} 2024") for i in range(100)], "feedback_id long, question string").write.parquet(str(tmp_path / "feedback_log.parquet"))
    made = registered.queries()[name]
    assert _writes(spark, lambda s: made(s, str(tmp_path)).write.format("noop").mode("overwrite").save()) < 3_000_000


def test_best_by_query(spark):
    asked, docs = _words(spark)
    whole = retrieval.ranked(retrieval.bm25_scores(asked, docs, *NAMES)).where("rank <= 7")
    got = rankings.bm25_top(asked, docs, *NAMES, k=7)
    assert {tuple(r) for r in got.select("query_id", "doc_id", "rank").collect()} == {tuple(r) for r in whole.select("query_id", "doc_id", "rank").collect()}


def test_prompts_score_their_pool_only(spark, monkeypatch):
    asked, docs = _words(spark)
    named = docs.withColumn("title", F.lit("T"))
    monkeypatch.setattr(retrieval, "lexical_scores", None)  # the overlap of all pairs isn't made
    from tessera.plans import pipeline

    monkeypatch.setattr(pipeline, "lexical_scores", None, raising=False)
    assert retrieve(asked, named, "q", "t", "d", "title", "t").count() == 10



def _questions(spark, path):
    """Documents and a log of twelve questions, of which the id of one is divisible by 100; two are equal but for order and case, one is null."""
    words = ["visa", "cap", "lottery", "rules", "H-1B", "i-9", "2024", "the"]
    docs = [(i, " ".join(words[(i * k) % 8] for k in range(1, 2 + i % 9))) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    asked = [(90 + i, f"{words[i % 8]} {words[(3 * i + 1) % 8]} i-9") for i in range(9)] + [(99, "Rules H-1B the cap"), (100, "cap the rules h-1b"), (101, None)]
    spark.createDataFrame(asked, "feedback_id long, question string").write.parquet(f"{path}/feedback_log.parquet")
    return [i for i, q in asked if q]


def test_metrics_of_every_question(spark, tmp_path, monkeypatch):
    ids = _questions(spark, tmp_path)
    asked, docs = registered._questions(spark, str(tmp_path)), registered._docs(spark, str(tmp_path))
    rows = retrieval.ranked(retrieval.bm25_scores(asked, docs, *registered.NAMES))
    rel = _relevant(asked.selectExpr("query_id AS q", "q_text AS t"), docs.selectExpr("doc_id AS d", "text AS t"))
    first = {r[0]: round(1 / r[1], 6) for r in rows.join(rel, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank")).collect()}
    monkeypatch.setattr(retrieval, "MOST_TERMS", 0)  # however many they are, no plan that shuffles the pairs is used
    monkeypatch.setattr(registered, "_hybrid", None)
    got = registered.queries()["retrieval_per_query"](spark, str(tmp_path)).collect()
    assert sorted((r["run"], r["query_id"]) for r in got) == sorted((run, i) for run in registered.RUNS for i in ids)
    assert {r["query_id"]: r["mrr"] for r in got if r["run"] == "2_bm25"} == first and len(first) == len(ids)
    assert len({tuple(r)[2:] for r in got if r["run"] == "3_fused" and r["query_id"] in (99, 100)}) == 1


def test_rankers_are_compared_by_every_question(spark, tmp_path):
    ids = _questions(spark, tmp_path)
    got = registered.queries()["ranker_compare"](spark, str(tmp_path)).collect()
    per = registered.queries()["retrieval_per_query"](spark, str(tmp_path)).groupBy("run").agg(F.avg("mrr")).collect()
    assert {r["run"]: r["queries"] for r in got} == dict.fromkeys(registered.RUNS, len(ids))
    assert {r["run"]: r["mrr"] for r in got} == pytest.approx({r[0]: r[1] for r in per}, abs=1e-4)


def test_whole_rankings_are_written_in_little_room(spark, tmp_path):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(LETTERS, k=rng.randrange(1, 25)))) for i in range(5000)], "d long, t string").repartition(5)
    asked = spark.createDataFrame([(i, " ".join(rng.choices(LETTERS, k=6))) for i in range(150)], "q int, t string")
    rankings.bm25_all(asked, docs, *NAMES).write.parquet(str(tmp_path / "out"))
    files = [pq.ParquetFile(x).metadata for x in (tmp_path / "out").glob("*.parquet")]
    size = sum(m.row_group(g).column(3).total_compressed_size for m in files for g in range(m.num_row_groups))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.groupBy("query_id").agg(F.count_distinct("doc_id").alias("d"), F.count_distinct("rank").alias("r"), F.max("rank").alias("m")).where("d = 5000 AND r = 5000 AND m = 5000").count() == 150
    assert size < 1.0 * 150 * 5000  # bytes of ranks
