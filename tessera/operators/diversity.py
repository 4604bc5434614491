"""Maximal marginal relevance over a bounded pool per query, as one higher-order aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, plain_tokens

POOL = 15  # candidates per query; the pool is the only thing gathered in one row


def mmr(
    ranked_docs: DataFrame, *, k: int, trade: float = 0.7, pool: int = POOL,
    similarity: Callable[[Column, Column], Column] = jaccard, features: Callable[[str], Column] = plain_tokens,
) -> DataFrame:
    """``(query_id, doc_id, pos, mmr_score, max_redundancy)`` from ``(query_id, doc_id, rank, score, text)``.

    The first ``pool`` documents of each query by ``rank`` compete. Relevance is scaled to 0..1 within the pool (1 where
    all are equal); each step takes the best ``trade * relevance - (1 - trade) * similarity`` to what is taken, the
    earlier rank on ties. ``trade >= 1`` keeps the ranking and leaves both scores null. ``k <= 0`` gives no rows.
    ``similarity`` compares what ``features`` makes of the texts.
    """
    rows = ranked_docs.where(F.col("rank") <= pool)
    if trade >= 1 or k <= 0:
        plain = rows.where(F.col("rank") <= k)
        null = F.lit(None).cast("double")
        return plain.select("query_id", "doc_id", F.col("rank").cast("int").alias("pos"), null.alias("mmr_score"), null.alias("max_redundancy"))
    item = F.struct(F.col("rank").alias("rank"), F.col("doc_id").alias("doc_id"), F.col("score").cast("double").alias("score"), features("text").alias("t"))
    pools = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("p"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    span = F.col("hi") - F.col("lo")
    scaled = F.transform("p", lambda c, i: F.struct(
        i.alias("i"), c["doc_id"].alias("doc_id"), F.when(span == 0, 1.0).otherwise((c["score"] - F.col("lo")) / F.nullif(span, F.lit(0.0))).alias("rel"), c["t"].alias("t")
    ))
    pools = pools.select("query_id", scaled.alias("p"))
    pick = "struct<value:double,before:int,redundancy:double>"
    doc_type = ranked_docs.schema["doc_id"].dataType.simpleString()
    token_type = pools.schema["p"].dataType.elementType["t"].dataType.simpleString()
    taken = f"array<struct<i:int,doc_id:{doc_type},value:double,redundancy:double,t:{token_type}>>"

    def step(sel: Column, _: Column) -> Column:
        def value(c: Column) -> Column:
            redundancy = F.array(F.coalesce(F.array_max(F.transform(sel, lambda s: similarity(s["t"], c["t"]))), F.lit(0.0)))
            scored = lambda r: F.struct(F.round(trade * c["rel"] - (1 - trade) * r, 9).alias("value"), (-c["i"]).alias("before"), r.alias("redundancy"))
            return F.transform(redundancy, scored)[0].cast(pick)

        # each intermediate is bound once, by a one-element transform
        open_ = F.array(F.filter(F.col("p"), lambda c: ~F.exists(sel, lambda s: s["i"] == c["i"])))

        def chosen(free: Column) -> Column:
            best = F.array(F.array_max(F.transform(free, value)))
            take = lambda b: F.transform(F.filter(free, lambda c: c["i"] == -b["before"]), lambda c: F.struct(
                c["i"].alias("i"), c["doc_id"].alias("doc_id"), b["value"].alias("value"), b["redundancy"].alias("redundancy"), c["t"].alias("t")
            ))
            return F.flatten(F.transform(best, take))

        return F.concat(sel, F.flatten(F.transform(open_, chosen)).cast(taken))

    out = pools.select("query_id", F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(min(k, pool))), F.array().cast(taken), step)).alias("at", "s"))
    return out.select("query_id", F.col("s.doc_id").alias("doc_id"), (F.col("at") + 1).alias("pos"), F.round("s.value", 4).alias("mmr_score"), F.round("s.redundancy", 4).alias("max_redundancy"))
