"""Retrieval metrics, comparisons of rankers, and checks of a benchmark's hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import snippet

CUTS = (1, 3, 5)


def per_query_metrics(rankings: DataFrame, relevant: DataFrame, queries: DataFrame, cuts: tuple[int, ...] = CUTS, *, runs: list[str] | None = None) -> DataFrame:
    """One row per run and query: ``mrr`` and hit, recall, precision and nDCG at each cut.

    ``rankings(run, query_id, doc_id, rank)``, ``relevant(query_id, doc_id)`` without repeats, ``queries(query_id)``.
    A query without relevant or ranked documents scores 0; precision divides by the cut, not by what was returned. Only
    rows of relevant documents count, so ``rankings`` may hold just those with their ranks. Naming the ``runs`` saves
    reading the rankings for them.
    """
    found = rankings.join(relevant, ["query_id", "doc_id"])
    size = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    rows = _grid(rankings, queries, runs).join(size, "query_id", "left").join(found.groupBy("run", "query_id").agg(*_sums(cuts)), ["run", "query_id"], "left")
    return rows.select("run", "query_id", *_metrics(cuts))


def metrics_of_hits(hits: DataFrame, queries: DataFrame, runs: list[str], cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """The same from ``hits(run, query_id, rank, n_rel)``: a run's ranks of relevant documents, all up to the last cut and the first of all.

    ``n_rel`` is the query's number of relevant documents.
    """
    sums = hits.groupBy("run", "query_id").agg(F.max("n_rel").alias("n_rel"), *_sums(cuts))
    return _grid(hits, queries, runs).join(sums, ["run", "query_id"], "left").select("run", "query_id", *_metrics(cuts))


def _sums(cuts: tuple[int, ...]) -> list[Column]:
    """The first rank, and of each cut the hits and their gain."""
    sums = [F.min("rank").alias("first")]
    for k in cuts:
        inside = F.col("rank") <= k
        sums += [F.count_if(inside).alias(f"n{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1))).alias(f"g{k}")]
    return sums


def _metrics(cuts: tuple[int, ...]) -> list[Column]:
    out = [F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr")]
    for k in cuts:
        n = F.coalesce(F.col(f"n{k}"), F.lit(0))
        best = F.least(F.coalesce("n_rel", F.lit(0)), F.lit(k)).cast("int")
        ideal = F.when(best > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(best, F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1)))
        out += [
            (n > 0).cast("double").alias(f"hit_{k}"),
            F.coalesce(F.try_divide(n, F.col("n_rel")), F.lit(0.0)).alias(f"recall_{k}"),
            (n / k).alias(f"precision_{k}"),
            F.coalesce(F.col(f"g{k}") / ideal, F.lit(0.0)).alias(f"ndcg_{k}"),
        ]
    return out


def _grid(rankings: DataFrame, queries: DataFrame, runs: list[str] | None) -> DataFrame:
    """Every query under every run; runs are a handful."""
    if runs is not None:
        return queries.select("query_id", F.explode(F.array(*map(F.lit, runs))).alias("run"))
    names = F.array_sort(F.collect_set("run"))
    return queries.select("query_id").crossJoin(F.broadcast(rankings.agg(names.alias("runs")))).select("query_id", F.explode("runs").alias("run"))


def run_detail(rankings: DataFrame, relevant: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """``(query_id, relevant, top, hit)`` of every query of one run: its relevant documents, the first ``top`` and whether one is relevant.

    Arrays are empty where there is nothing.
    """
    rel = relevant.groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("relevant"))
    head = rankings.where(F.col("rank") <= top).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("head"))
    rows = queries.select("query_id").join(rel, "query_id", "left").join(head, "query_id", "left")
    kind = relevant.schema["doc_id"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    rows = rows.select("query_id", F.coalesce("relevant", none).alias("relevant"), F.coalesce(F.transform("head", lambda x: x["doc_id"]), none).alias("top"))
    return rows.withColumn("hit", F.arrays_overlap("relevant", "top"))


def mean_metrics(per_query: DataFrame, digits: int = 4) -> DataFrame:
    """Means over all queries, per run."""
    names = [c for c in per_query.columns if c not in ("run", "query_id")]
    return per_query.groupBy("run").agg(F.count("*").alias("queries"), *(F.round(F.avg(c), digits).alias(c) for c in names))


def against_previous(means: DataFrame, order: str = "run") -> DataFrame:
    """``means`` with ``mrr_delta``, the difference to the run before; null for the first."""
    return means.withColumn("mrr_delta", F.round(F.col("mrr") - F.lag("mrr").over(Window.orderBy(order)), 4))


def gold_bars(gold_scores: DataFrame) -> DataFrame:
    """``(query_id, bar)``: the lowest score of a query's gold documents."""
    return gold_scores.groupBy("query_id").agg(F.min("score").alias("bar"))


def screen_candidates(over: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates too close to a query: ``(doc_id, query_id, score, bar, margin)`` of the widest collision of each.

    ``over(query_id, doc_id, score, bar)`` are the pairs that reach the query's bar, ``gold(query_id, doc_id)`` its gold
    documents, which are no candidates. Of equal margins the smaller query wins.
    """
    other = over.join(gold.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("margin", F.round(F.col("score") - F.col("bar"), 9))
    best = other.groupBy("doc_id").agg(F.max(F.struct("margin", (-F.col("query_id")).alias("q"), "score", "bar")).alias("b"))
    return best.select("doc_id", (-F.col("b.q")).alias("query_id"), "b.score", "b.bar", "b.margin")


def top_rejects(screened: DataFrame, limit: int = 15) -> DataFrame:
    """The ``limit`` rejected candidates of the widest margins with ``remaining``, the number of the others; ties by document."""
    total = screened.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("remaining"))
    return screened.orderBy(F.desc("margin"), "doc_id").limit(limit).crossJoin(F.broadcast(total))


def gold_corpus(docs: DataFrame, id_col: str, prefix: str = "d") -> DataFrame:
    """``docs`` without those whose id, as text, begins with ``prefix``, the mark of added distractors; null ids are left out."""
    return docs.where(~F.col(id_col).cast("string").startswith(prefix))


def transparency(rankings: DataFrame, relevant: DataFrame, overlap: DataFrame) -> DataFrame:
    """Queries whose first document is relevant: ``(query_id, doc_id, overlap, shared, pos)``, the most transparent first.

    ``overlap(query_id, doc_id, overlap, shared)`` holds the share of the query's tokens found in the document and
    those tokens; ``shared`` comes out sorted, ``pos`` counts from 1, ties by query.
    """
    first = rankings.where("rank = 1").join(relevant, ["query_id", "doc_id"], "left_semi")
    rows = first.join(overlap, ["query_id", "doc_id"]).select("query_id", "doc_id", F.round("overlap", 3).alias("overlap"), F.array_sort("shared").alias("shared"))
    # a row a query
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("overlap"), "query_id")))


def share_solved(solved: DataFrame, queries: DataFrame) -> DataFrame:
    """``(solved, queries, share)``: how many queries ``solved`` holds; the share is 0 for no queries."""
    n = solved.agg(F.count("*").alias("solved")).crossJoin(queries.agg(F.count("*").alias("queries")))
    return n.withColumn("share", F.coalesce(F.try_divide("solved", "queries"), F.lit(0.0)))


def ranking_review(rankings: DataFrame, relevant: DataFrame, top: int = 3, *, docs: DataFrame | None = None, chars: int = 160) -> DataFrame:
    """Queries whose first document isn't relevant: ``(query_id, gold_rank, beaten_by)``.

    ``gold_rank`` is the first relevant rank (null if none was ranked), ``beaten_by`` the other documents among the
    first ``top``, in rank order. Queries without relevant documents are left out. With ``docs(doc_id, source_title,
    text)`` a column ``beaten`` of structs holds those documents' titles and snippets of ``chars`` characters.
    """
    marked = rankings.join(relevant.withColumn("is_rel", F.lit(True)), ["query_id", "doc_id"], "left").join(relevant.select("query_id").distinct(), "query_id", "left_semi")
    wrong = F.when((F.col("rank") <= top) & F.col("is_rel").isNull(), F.struct("rank", "doc_id"))
    out = marked.groupBy("query_id").agg(F.min(F.when(F.col("is_rel"), F.col("rank"))).alias("gold_rank"), F.array_sort(F.collect_list(wrong)).alias("w"))
    out = out.where(F.coalesce(F.col("gold_rank"), F.lit(0)) != 1)
    plain = out.select("query_id", "gold_rank", F.transform("w", lambda x: x["doc_id"]).alias("beaten_by"))
    if docs is None:
        return plain
    shown = out.select("query_id", F.explode("w").alias("x")).select("query_id", F.col("x.rank").alias("rank"), F.col("x.doc_id").alias("doc_id"))
    shown = shown.join(docs.select("doc_id", "source_title", snippet("text", chars).alias("text")), "doc_id")
    shown = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "source_title", "text"))).alias("beaten"))  # at most ``top``
    return plain.join(shown, "query_id", "left")


def dangling(relevant: DataFrame, docs: DataFrame) -> DataFrame:
    """Relevant pairs whose document doesn't exist; must be empty."""
    return relevant.join(docs.select("doc_id"), "doc_id", "left_anti")
