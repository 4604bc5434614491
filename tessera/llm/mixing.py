"""Problem 9: mixing sources to target shares of a corpus-sized whole, with capped repetition.

Sizes are tokens of a public tokenizer. Each source's demand is its share of the corpus size, at most its tokens times
its repeat cap; what a cap cuts off goes to the sources with room left, in proportion to their shares (water filling).
A source's documents stand in a fixed pseudo-random order and are drawn pass after pass until the demand is met to
within half a document. Their running token offsets come from a two-level prefix sum (buckets of the hash, then within
each bucket), so no source, however large, meets in one task.

The order of the mix is a Pfair schedule: a source with share w releases its j-th block at slot floor(j/w) with deadline
ceil((j+1)/w); each slot goes to the released block with the earliest deadline, which keeps every source within one
block of its ideal share at all times. A block holds ``BLOCK_DOCS`` documents of mean size, so that a document across
its edge is a small part of it, and more where there would be over ``MOST_BLOCKS``, which the driver lays out.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .byte_bpe import DEFAULT_VOCABULARY, token_counts


BLOCK_DOCS = 16
MOST_BLOCKS = 1_000_000  # slots of the schedule
BUCKET_ROWS = 100_000  # documents of a source in a bucket of its order, about


def fill(total: float, shares: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """Demand of each source: ``total`` split by shares, at most each cap, the rest going to those with room."""
    demand = dict.fromkeys(shares, 0.0)
    left, open_ = float(total), {s for s in shares if shares[s] > 0 and caps[s] > 0}
    while open_ and left > 1e-9:
        weight = sum(shares[s] for s in open_)
        full = {s for s in open_ if demand[s] + left * shares[s] / weight >= caps[s] - 1e-9}
        if not full:
            for s in open_:
                demand[s] += left * shares[s] / weight
            return demand
        for s in full:
            left -= caps[s] - demand[s]
            demand[s] = float(caps[s])
        open_ -= full
    return demand


def pfair(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """Earliest-deadline-first order of the blocks ``(source, j)``."""
    total = sum(blocks.values())
    release = [(0, math.ceil(total / n), s, 0) for s, n in blocks.items() if n > 0]
    heapq.heapify(release)
    ready: list[tuple[int, str, int]] = []
    order = []
    for slot in range(total):
        while release and (release[0][0] <= slot or not ready):
            _, deadline, s, j = heapq.heappop(release)
            heapq.heappush(ready, (deadline, s, j))
        _, s, j = heapq.heappop(ready)
        order.append((s, j))
        if j + 1 < (n := blocks[s]):
            heapq.heappush(release, ((j + 1) * total // n, -(-(j + 2) * total // n), s, j + 1))
    return order


def mix(
    docs: DataFrame, targets: DataFrame, id_col: str, source_col: str, text_col: str, *,
    vocabulary: str = DEFAULT_VOCABULARY, blocks: int | None = None, buckets: int | None = None, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """``(drawn, shares)``.

    ``drawn(slot, offset, source, <id>, repeat, tokens)``: one row per use of a document; ordering by slot and offset
    gives the mix. ``shares(source, target_share, max_repeats, available_tokens, drawn_tokens, actual_share)``: one row
    per row of ``targets(source, target_share, max_repeats)``. Sources without a target, null sources and documents
    without tokens are never drawn but count towards the size of the whole; a target without documents reaches 0.
    Null shares or caps count as 0. ``blocks`` and ``buckets`` follow from the tokens and the largest source's documents
    unless given. ``targets`` is a small table of one row per source; it is read by the driver.
    """
    spark = docs.sparkSession
    sizes = cut(token_counts(docs, [id_col, source_col], text_col, vocabulary=vocabulary))
    wanted = {
        r["source"]: (max(float(r["target_share"] or 0), 0.0), max(int(r["max_repeats"] or 0), 0))
        for r in targets.where("source IS NOT NULL").select("source", "target_share", "max_repeats").collect()
    }
    sums = sizes.groupBy(F.when(F.col(source_col).isin(list(wanted)), F.col(source_col)).alias("source")).agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")).collect()
    buckets = buckets or max(256, -(-max((r["docs"] for r in sums if r["source"] is not None), default=1) // BUCKET_ROWS))
    have = {r["source"]: int(r["n"] or 0) for r in sums}
    total = sum(have.values())
    demand = fill(total, {s: w for s, (w, _) in wanted.items()}, {s: have.get(s, 0) * c for s, (_, c) in wanted.items()})
    blocks = blocks or min(max(sum(r["docs"] for r in sums) // BLOCK_DOCS, 1), MOST_BLOCKS)
    block = max(total / blocks, 1.0)
    used = {s: d for s, d in demand.items() if d > 0}
    order = pfair({s: math.ceil(d / block) for s, d in used.items()})
    schedule = spark.createDataFrame([(s, j, slot) for slot, (s, j) in enumerate(order)], "source string, block long, slot long")
    plan = spark.createDataFrame([(s, d, have[s], math.ceil(d / have[s])) for s, d in used.items()], "source string, demand double, size long, passes int")

    key = F.xxhash64(F.lit(seed), id_col)
    pool = (
        sizes.where("tokens > 0").withColumnRenamed(source_col, "source").join(F.broadcast(plan), "source")
        .withColumn("key", key).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    )
    base = pool.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", id_col).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        pool.withColumn("at", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(F.broadcast(base), ["source", "bucket"])
        .withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
        .withColumn("offset", F.col("base") + F.col("at") + F.col("repeat") * F.col("size"))
        .where(F.col("offset") + F.col("tokens") / 2 <= F.col("demand"))
        .withColumn("block", F.least(F.floor(F.col("offset") / F.lit(block)), F.ceil(F.col("demand") / F.lit(block)) - 1))
    )
    drawn = cut(placed.join(F.broadcast(schedule), ["source", "block"]).select("slot", "offset", "source", id_col, "repeat", "tokens"))
    reached = drawn.groupBy("source").agg(F.sum("tokens").alias("drawn_tokens"))
    sizes_by_source = spark.createDataFrame([(s, w, c, have.get(s, 0)) for s, (w, c) in wanted.items()], "source string, target_share double, max_repeats int, available_tokens long")
    whole = reached.agg(F.sum("drawn_tokens").alias("whole"))
    shares = (
        sizes_by_source.join(reached, "source", "left").crossJoin(F.broadcast(whole))
        .select(
            "source", "target_share", "max_repeats", "available_tokens", F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"),
            F.coalesce(F.try_divide("drawn_tokens", "whole"), F.lit(0.0)).alias("actual_share"),
        )
    )
    return drawn, shares


def deviation(drawn: DataFrame) -> DataFrame:
    """``(source, actual_share, blocks)``: by how many mean blocks a source is at most ahead of or behind its share anywhere in the mix.

    Only the sums of the slots are ordered, at most ``MOST_BLOCKS`` and some rows, whatever the corpus. No rows for an empty mix.
    """
    per = drawn.groupBy("slot", "source").agg(F.sum("tokens").alias("n"))
    upto = Window.orderBy("slot", "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = per.withColumn("all", F.sum("n").over(upto)).withColumn("own", F.sum("n").over(own))
    whole = per.groupBy("source").agg(F.sum("n").alias("s")).crossJoin(F.broadcast(per.agg(F.sum("n").alias("w"), F.avg("n").alias("block"))))
    share = F.col("s") / F.col("w")
    rows = rows.join(F.broadcast(whole), "source")  # a row a source
    after = F.abs(F.col("own") - share * F.col("all"))
    before = F.abs(F.col("own") - F.col("n") - share * (F.col("all") - F.col("n")))
    return rows.groupBy("source").agg(F.max(share).alias("actual_share"), (F.max(F.greatest(before, after)) / F.max("block")).alias("blocks"))
