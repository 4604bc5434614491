"""Ranking documents for queries: cosine in blocks, BM25 and word overlap in the document's row, fusion, re-ranking.

Word scores need a query's terms only, so the terms of all queries, counted to be at most ``MOST_TERMS`` pairs, are
broadcast and every document is scored where it is read: nothing is shuffled but scores, and with ``k`` only the best
of each query and task. Beyond that number the terms are joined to an inverted index instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import IDENT_TOKEN, PLAIN_TOKEN, RETRIEVAL_STOP, content_tokens, ident_tokens
from ..session import cut, spread

K1, B = 1.5, 0.75
RRF_K = 60
BLOCK = 4096
MOST_TERMS = 2_000_000  # pairs of a query and a term that are broadcast
CELLS = 1 << 21  # scores of a block of documents against all queries at once
DIGITS = 9  # scores are rounded before ranking, so that the order of summation can't flip a tie


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            vectors = part.column(1).to_pylist()
            ok = [i for i, v in enumerate(vectors) if v]
            if not ok:
                continue
            m = np.array([vectors[i] for i in ok], np.float64)
            ids = part.column(0).take(pa.array(ok)).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([m.tobytes()])], names=["ids", "m"])


def _block_top(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, ma, b, mb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                q, d = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                x, y = np.frombuffer(ma).reshape(len(q), -1), np.frombuffer(mb).reshape(len(d), -1)
                norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
                s = np.divide(x @ y.T, norm, out=np.zeros((len(q), len(d))), where=norm > 0)
                s = np.round(s, DIGITS) + 0.0
                # ties go to the smaller id: order the documents by id, then pick stably
                by = np.argsort(d, kind="stable")
                s, d = s[:, by], d[by]
                top = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
                rows = np.repeat(np.arange(len(q)), top.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q[rows]), pa.array(d[top.ravel()]), pa.array(s[rows, top.ravel()])], names=["query_id", "doc_id", "score"]
                )

    return run


MOST_BLOCKS = 256  # packed blocks of queries that are broadcast; each holds up to BLOCK vectors


def _few(blocks: DataFrame) -> DataFrame:
    """``blocks`` marked for broadcast if they are counted to be few, else left to Spark's own choice of product."""
    return F.broadcast(blocks) if blocks.limit(MOST_BLOCKS + 1).count() <= MOST_BLOCKS else blocks


def cosine_topk(queries: DataFrame, docs: DataFrame, id_col: str, vec_col: str, k: int, *, skip_self: bool = True) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the ``k`` nearest documents of each query by cosine in double precision.

    Vectors meet in packed blocks, so one block product replaces millions of row pairs and only ``k`` rows per query
    and block leave it. A zero vector has similarity 0 with everything; null and empty vectors take no part. Ties rank
    by id. ``skip_self`` leaves a query's own id out.
    """
    pack = "ids binary, m binary"
    left = queries.select(F.col(id_col).cast("long"), vec_col).mapInArrow(_pack, pack).select(F.col("ids").alias("qi"), F.col("m").alias("qm"))
    right = docs.select(F.col(id_col).cast("long"), vec_col).mapInArrow(_pack, pack)
    near = right.crossJoin(_few(left)).select("qi", "qm", "ids", "m").mapInArrow(_block_top(k), "query_id long, doc_id long, score double")
    if skip_self:
        near = near.where("query_id <> doc_id")
    return ranked(near).where(F.col("rank") <= k)


def _pack_barred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            bars = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
            for packed in _pack(iter([part.select([0, 1])])):
                yield pa.RecordBatch.from_arrays([*packed.columns, pa.array([bars])], names=["ids", "m", "bars"])


def _block_above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, ma, bars, b, mb in zip(*(batch.column(i).to_pylist() for i in range(5))):
            q, d, bar = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(bars)
            x, y = np.frombuffer(ma).reshape(len(q), -1), np.frombuffer(mb).reshape(len(d), -1)
            norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
            s = np.round(np.divide(x @ y.T, norm, out=np.zeros((len(q), len(d))), where=norm > 0), DIGITS) + 0.0
            i, j = np.nonzero(s >= bar[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(d[j]), pa.array(s[i, j]), pa.array(bar[i])], names=["query_id", "doc_id", "score", "bar"])


def cosine_of(pairs: DataFrame, vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``pairs(query_id, doc_id)`` with their cosine as ``score``, by two equi-joins; 0 where a norm is 0."""
    q = vectors.select(F.col(id_col).alias("query_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("__q"))
    d = vectors.select(F.col(id_col).alias("doc_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("__d"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot("__q", "__q")) * F.sqrt(dot("__d", "__d"))
    score = F.coalesce(F.round(F.try_divide(dot("__q", "__d"), norm), DIGITS), F.lit(0.0))
    return pairs.join(q, "query_id").join(d, "doc_id").select("query_id", "doc_id", score.alias("score"))


def cosine_above(queries: DataFrame, docs: DataFrame, id_col: str, vec_col: str, bar_col: str) -> DataFrame:
    """``(query_id, doc_id, score, bar)`` of the documents whose cosine reaches their query's bar, by block products.

    Vectors must not be null or empty.
    """
    left = queries.select(F.col(id_col).cast("long"), vec_col, bar_col).mapInArrow(_pack_barred, "ids binary, m binary, bars binary")
    left = left.select(F.col("ids").alias("qi"), F.col("m").alias("qm"), "bars")
    right = docs.select(F.col(id_col).cast("long"), vec_col).mapInArrow(_pack, "ids binary, m binary")
    return right.crossJoin(_few(left)).select("qi", "qm", "bars", "ids", "m").mapInArrow(_block_above, "query_id long, doc_id long, score double, bar double")


def ranked(scores: DataFrame) -> DataFrame:
    """``scores(query_id, doc_id, score)`` with ``rank``, best first, ties by document."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order))


def bm25_index(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(postings(doc_id, term, tf, n_tokens), terms(term, df, idf), stats(n_docs, avg_tokens))``.

    Documents without tokens count in ``n_docs`` and the average. ``stats`` is one row.
    """
    tokens = docs.select(F.col(id_col).alias("doc_id"), ident_tokens(text_col).alias("t")).withColumn("n_tokens", F.size("t"))
    postings = tokens.select("doc_id", "n_tokens", F.explode("t").alias("term")).groupBy("doc_id", "n_tokens", "term").agg(F.count("*").alias("tf"))
    stats = tokens.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("n_tokens"), F.lit(0.0)).alias("avg_tokens"))
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = counts.crossJoin(F.broadcast(stats.select("n_docs"))).select("term", "df", idf.alias("idf"))
    return postings, terms, stats


@dataclass
class _Terms:
    """The queries' terms: of each term the queries that hold it (their places) and the weight it has there."""

    ids: np.ndarray  # of the queries, ascending
    term: dict[str, int]
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray


def _terms(asked: DataFrame, weight: str) -> _Terms | None:
    """``asked(query_id, term, <weight>)`` on the driver, or None if it is larger than ``MOST_TERMS``."""
    rows = asked.select("query_id", "term", F.col(weight).cast("double").alias("w")).limit(MOST_TERMS + 1).toArrow()
    if rows.num_rows > MOST_TERMS:
        return None
    ids, query = np.unique(rows.column("query_id").to_numpy(), return_inverse=True)
    coded = rows.column("term").combine_chunks().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(at, kind="stable")
    names = coded.dictionary.to_pylist()
    start = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(names)))))
    return _Terms(ids, {t: i for i, t in enumerate(names)}, start, query[order], rows.column("w").to_numpy()[order])


def _counted_tokens(texts: list[str | None], pattern: re.Pattern, term: dict[str, int], stop: frozenset[str] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and number of times of the known terms in each text, and each text's number of tokens.

    With ``stop`` tokens are distinct and without the stop words.
    """
    of, at, sizes = [], [], np.zeros(len(texts), np.int64)
    for d, text in enumerate(texts):
        tokens = pattern.findall(text.lower()) if text else []
        if stop is not None:
            tokens = set(tokens) - stop
        sizes[d] = len(tokens)
        known = [i for i in map(term.get, tokens) if i is not None]
        of += [d] * len(known)
        at += known
    key, times = np.unique(np.array(of, np.int64) * max(len(term), 1) + np.array(at, np.int64), return_counts=True)
    return *np.divmod(key, max(len(term), 1)), times, sizes


def _best(q: np.ndarray, d: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of each query: by rounded score, ties by document."""
    order = np.lexsort((d, -np.round(s, DIGITS), q))
    q, d, s = q[order], d[order], s[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], d[keep], s[keep]


def _score(shared, pattern: str, stop: frozenset[str] | None, value, k: int | None):
    """Scores of documents against all queries; ``value(sums, pairs' places, sizes)`` turns sums of weights into scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: _Terms = shared.value
        compiled, width = re.compile(pattern), max(len(terms.ids), 1)
        held: list[tuple] = []

        def out(q, d, s):
            return pa.RecordBatch.from_arrays([pa.array(terms.ids[q]), pa.array(d), pa.array(s)], names=["query_id", "doc_id", "score"])

        for batch in batches:
            step = max(CELLS // width, 1)
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                of, at, times, sizes = _counted_tokens(part.column(1).to_pylist(), compiled, terms.term, stop)
                count = terms.start[at + 1] - terms.start[at]
                place = np.repeat(terms.start[at] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
                doc = np.repeat(of, count)
                cell = doc * width + terms.query[place]
                sums = np.bincount(cell, weights=value[0](terms.weight[place], np.repeat(times, count), sizes[doc]), minlength=part.num_rows * width)
                held_here = np.flatnonzero(np.bincount(cell, minlength=1))
                d, q = np.divmod(held_here, width)
                s = value[1](sums[held_here], q, sizes[d])
                names = part.column(0).take(pa.array(d)).to_numpy(zero_copy_only=False)
                names = names.astype(str) if names.dtype == object else names
                if k is None:
                    yield out(q, names, s)
                    continue
                held.append((q, names, s))
                if sum(len(x[0]) for x in held) > max(4 * k * width, CELLS):
                    held = [_best(*(np.concatenate(c) for c in zip(*held)), k)]
        if held:
            yield out(*_best(*(np.concatenate(c) for c in zip(*held)), k))

    return run


def bm25_scores(queries: DataFrame, docs: DataFrame, q_id: str, q_text: str, d_id: str, d_text: str, *, k: int | None = None) -> DataFrame:
    """``(query_id, doc_id, score)`` of the documents that share a term with the query; a repeated query term counts again.

    With ``k`` at least the ``k`` best of each query are among the rows, and no more than that for each task. Null
    texts and those without tokens count as documents and score nothing.
    """
    asked = queries.select(F.col(q_id).alias("query_id"), F.explode(ident_tokens(q_text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    terms = _terms(asked, "qtf")
    if terms is None:
        return _bm25_by_join(asked, docs, d_id, d_text)
    rows = spread(docs.select(F.col(d_id).alias("doc_id"), F.col(d_text).alias("text")))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Terms = shared.value
        compiled = re.compile(IDENT_TOKEN)
        df, docs_seen, tokens = np.zeros(len(known.term), np.int64), 0, 0
        for batch in batches:
            _, at, _, sizes = _counted_tokens(batch.column(0).to_pylist(), compiled, known.term, None)
            df += np.bincount(at, minlength=len(df))
            docs_seen, tokens = docs_seen + batch.num_rows, tokens + int(sizes.sum())
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])), pa.array(np.append(df[used], [docs_seen, tokens]))], names=["at", "n"])

    counts = rows.select("text").mapInArrow(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a term
    number = dict(zip(counts.column("at").to_pylist(), counts.column("n").to_pylist()))
    n_docs = number.pop(-1, 0)
    average = number.pop(-2, 0) / n_docs if n_docs else 0.0
    df = np.zeros(len(terms.term))
    df[list(number)] = list(number.values())
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    weighted = _Terms(terms.ids, terms.term, terms.start, terms.query, terms.weight * np.repeat(idf, np.diff(terms.start)))

    def part(weight, times, size):
        return weight * times * (K1 + 1) / (times + K1 * (1 - B + B * size / average))

    kind = rows.schema["doc_id"].dataType.simpleString()
    run = _score(context.broadcast(weighted), IDENT_TOKEN, None, (part, lambda s, q, n: s), k)
    return rows.mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc_id {kind}, score double")


def _bm25_by_join(asked: DataFrame, docs: DataFrame, d_id: str, d_text: str) -> DataFrame:
    """The same where the queries' terms are too many to broadcast: they meet the documents' postings in joins.

    Only postings of the queries' terms are scored: the terms are joined before the document frequencies are counted.
    """
    tokens = docs.select(F.col(d_id).alias("doc_id"), ident_tokens(d_text).alias("t")).withColumn("n_tokens", F.size("t"))
    stats = tokens.agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("avg_tokens"))
    wanted = asked.select("term").distinct()
    postings = (
        tokens.select("doc_id", "n_tokens", F.explode("t").alias("term")).join(wanted, "term", "left_semi")
        .groupBy("doc_id", "n_tokens", "term").agg(F.count("*").alias("tf"))
    )
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    norm = K1 * (1 - B + B * F.col("n_tokens") / F.col("avg_tokens"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return (
        postings.join(df, "term").join(asked, "term").crossJoin(F.broadcast(stats))
        .groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score"))
    )


def with_zeros(scores: DataFrame, queries: DataFrame, docs: DataFrame, q_id: str, d_id: str) -> DataFrame:
    """``scores`` and a zero for every other document of every query: the full ranking, as large as queries times documents."""
    grid = queries.select(F.col(q_id).alias("query_id")).crossJoin(docs.select(F.col(d_id).alias("doc_id")))
    return grid.join(scores, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def lexical_scores(queries: DataFrame, docs: DataFrame, q_id: str, q_text: str, d_id: str, d_text: str, *, k: int | None = None) -> DataFrame:
    """``(query_id, doc_id, score)``: Jaccard of stop-word-free token sets, of the documents with a token in common; ``k`` as in ``bm25_scores``."""
    q = queries.select(F.col(q_id).alias("query_id"), content_tokens(q_text, RETRIEVAL_STOP).alias("t"))
    qt = q.select("query_id", F.size("t").alias("nq"), F.explode("t").alias("term"))
    terms = _terms(qt, "nq")
    if terms is None:
        d = docs.select(F.col(d_id).alias("doc_id"), content_tokens(d_text, RETRIEVAL_STOP).alias("t"))
        dt = d.select("doc_id", F.size("t").alias("nd"), F.explode("t").alias("term")).join(qt.select("term").distinct(), "term", "left_semi")
        both = qt.join(dt, "term").groupBy("query_id", "doc_id", "nq", "nd").agg(F.count("*").alias("n"))
        return both.select("query_id", "doc_id", (F.col("n") / (F.col("nq") + F.col("nd") - F.col("n"))).alias("score"))
    size = np.zeros(len(terms.ids))
    size[terms.query] = terms.weight  # a query's number of tokens stands with each of its terms
    rows = spread(docs.select(F.col(d_id).alias("doc_id"), F.col(d_text).alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    value = (lambda weight, times, n: np.ones(len(weight)), lambda s, q, n: s / (size[q] + n - s))
    run = _score(docs.sparkSession.sparkContext.broadcast(terms), PLAIN_TOKEN, frozenset(RETRIEVAL_STOP), value, k)
    return rows.mapInArrow(run, f"query_id {qt.schema['query_id'].dataType.simpleString()}, doc_id {kind}, score double")


def overlap_of(pairs: DataFrame, queries: DataFrame, docs: DataFrame, q_id: str, q_text: str) -> DataFrame:
    """``pairs(query_id, doc_id)`` with the score ``lexical_scores`` gives them, without those that share no token; ``docs(doc_id, text)``."""
    q = queries.select(F.col(q_id).alias("query_id"), content_tokens(q_text, RETRIEVAL_STOP).alias("__q"))
    d = docs.select("doc_id", content_tokens("text", RETRIEVAL_STOP).alias("__d"))
    both = F.size(F.array_intersect("__q", "__d"))
    rows = pairs.join(q, "query_id").join(d, "doc_id").withColumn("__n", both).where("__n > 0")
    return rows.select("query_id", "doc_id", (F.col("__n") / (F.size("__q") + F.size("__d") - F.col("__n"))).alias("score"))


def reciprocal_rank_fusion(rankings: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` of the union of rankings ``(query_id, doc_id, rank)``.

    Order: fused score, then best rank anywhere, then the id as text. Weights must be as many as rankings.
    """
    weights = weights or [1.0] * len(rankings)
    if len(weights) != len(rankings):
        raise ValueError("as many weights as rankings are needed")
    if not rankings:
        raise ValueError("no ranking to fuse")
    parts = [r.select("query_id", "doc_id", "rank", F.lit(float(w)).alias("w")) for r, w in zip(rankings, weights)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    fused = rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "best", F.col("doc_id").cast("string"))
    return fused.withColumn("rank", F.row_number().over(order)).drop("best")


def rerank_pool(first: DataFrame, second: DataFrame, pool: int = 15) -> DataFrame:
    """``first(query_id, doc_id, rank)`` with its first ``pool`` documents in the order of ``second(query_id, doc_id, score)``.

    ``second`` is any scorer's table, a cross-encoder's or another ranking's. A pool document without a second score
    keeps its place after those with one; the tail stays as it is.
    """
    rows = first.join(second.select("query_id", "doc_id", F.col("score").alias("second")), ["query_id", "doc_id"], "left")
    order = Window.partitionBy("query_id").orderBy(*_pool_order("rank", F.col("second"), pool))
    return rows.select("query_id", "doc_id", F.col("rank").alias("first_rank"), F.row_number().over(order).alias("rank"))


def _pool_order(rank: str, second: Column, pool: int) -> list[Column]:
    inside = F.when(F.col(rank) <= pool, 0).otherwise(1)
    return [inside, F.when(inside == 0, F.round(second, DIGITS)).desc_nulls_last(), F.col(rank)]


def hybrid_ranks(first: DataFrame, second: DataFrame, *, weights: tuple[float, float] = (1.0, 1.0), k: int = RRF_K, pool: int = 15) -> DataFrame:
    """``(query_id, doc_id, first, second, first_rank, second_rank, fused, fused_rank, reranked)`` of two scorings ``(query_id, doc_id, score)``.

    Every ranking is whole: a document without a score in one has no rank there, and ``reranked`` (the first ranking
    with its ``pool`` in the second's order) is null without a first rank. All ranks of a query come from one exchange.
    """
    a = first.select("query_id", "doc_id", F.col("score").alias("first"), F.lit(None).cast("double").alias("second"))
    b = second.select("query_id", "doc_id", F.lit(None).cast("double").alias("first"), F.col("score").alias("second"))
    # pairs meet after the exchange by query, so the windows below need no other
    rows = a.unionByName(b).repartition("query_id").groupBy("query_id", "doc_id").agg(F.max("first").alias("first"), F.max("second").alias("second"))
    per = Window.partitionBy("query_id")
    place = lambda c: F.when(F.col(c).isNotNull(), F.row_number().over(per.orderBy(F.round(c, DIGITS).desc_nulls_last(), "doc_id")))
    rows = rows.withColumn("first_rank", place("first")).withColumn("second_rank", place("second"))
    share = lambda w, c: F.coalesce(F.lit(float(w)) / (k + F.col(c)), F.lit(0.0))
    rows = rows.withColumn("fused", share(weights[0], "first_rank") + share(weights[1], "second_rank"))
    order = per.orderBy(F.desc(F.round("fused", DIGITS)), F.least("first_rank", "second_rank"), F.col("doc_id").cast("string"))
    pooled = F.when(F.col("first_rank").isNotNull(), F.row_number().over(per.orderBy(F.col("first_rank").isNull(), *_pool_order("first_rank", F.col("second"), pool))))
    return rows.withColumn("fused_rank", F.row_number().over(order)).withColumn("reranked", pooled)


def oracle_ranking(docs: DataFrame, relevant: DataFrame) -> DataFrame:
    """Relevant documents first, in id order: ``relevant(query_id, doc_id)`` ranked; the rest adds nothing to any metric.

    ``oracle_full`` gives the rest too.
    """
    order = Window.partitionBy("query_id").orderBy("doc_id")
    return relevant.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("rank", F.row_number().over(order))


def oracle_full(docs: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """The perfect ranking of all documents for every query: the relevant in id order, then the rest in id order.

    As large as queries times documents by its definition. A document's place follows from its place among all
    documents and the relevant ones before it, so nothing but the relevant is ranked per query.
    """
    every = ranked_ids(docs.select("doc_id"), "doc_id")
    own = relevant.join(every, "doc_id")
    order = Window.partitionBy("query_id").orderBy("place")
    own = own.withColumn("rank", F.row_number().over(order))
    taken = own.groupBy("query_id").agg(F.array_sort(F.collect_list("place")).alias("taken"))  # a query's relevant documents
    grid = queries.select("query_id").join(taken, "query_id", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<bigint>")))
    rest = every.crossJoin(F.broadcast(grid)).where(~F.array_contains("taken", F.col("place")))
    before = F.size(F.filter("taken", lambda x: x < F.col("place")))
    rest = rest.select("query_id", "doc_id", (F.col("place") + F.size("taken") - before).cast("int").alias("rank"))
    return own.select("query_id", "doc_id", "rank").unionByName(rest)


def ranked_ids(df: DataFrame, by: str) -> DataFrame:
    """``df`` with ``place``, its rows' place from 1 in the order of ``by``, over range partitions and their sizes."""
    rows = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("__p", F.spark_partition_id())
    rows = cut(rows.withColumn("__m", F.monotonically_increasing_id()))
    first = rows.groupBy("__p").agg(F.min("__m").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    first = first.select("__p", "__first", before.alias("__before"))
    return rows.join(F.broadcast(first), "__p").select(*df.columns, (F.col("__before") + F.col("__m") - F.col("__first") + 1).alias("place"))


def unique_sources(ranked_docs: DataFrame, limit: int = 5) -> DataFrame:
    """The first ``limit`` distinct non-empty urls of each query, in rank order; an absent title is 'Untitled Source'."""
    rows = ranked_docs.where(F.col("source_url") != "")
    first = rows.groupBy("query_id", "source_url").agg(F.min_by("source_title", "rank").alias("source_title"), F.min("rank").alias("first_rank"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank"))
    return first.withColumn("pos", pos).where(F.col("pos") <= limit).withColumn("source_title", F.coalesce("source_title", F.lit("Untitled Source"))).drop("first_rank")
