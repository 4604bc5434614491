"""Reports over the audit log and the answer cache's behaviour over an access log."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import norm, strip
from ..session import cut

LEVELS = ("Low", "Medium", "High")


def risk_stats(log: DataFrame, level_col: str) -> DataFrame:
    """``(total, low, medium, high, grounded_pct)``: levels stripped, nulls left out; the share is null for no rows."""
    v = strip(level_col)
    counts = log.agg(F.count(v).alias("total"), *(F.count_if(v == x).alias(x.lower()) for x in LEVELS))
    return counts.withColumn("grounded_pct", F.round(F.try_divide(F.col("low") * 100.0, F.col("total")), 1))


def top_questions(log: DataFrame, query_col: str, limit: int = 8) -> DataFrame:
    """``(question, n)``: the most frequent non-blank questions, stripped; ties by question."""
    q = strip(query_col)
    return log.select(q.alias("question")).where("question <> ''").groupBy("question").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "question").limit(limit)


def recent(log: DataFrame, id_col: str, time_col: str, limit: int = 20) -> DataFrame:
    """The newest ``limit`` rows; rows without a time come last, ties go to the larger id; null strings become ''."""
    rows = log.orderBy(F.col(time_col).desc_nulls_last(), F.col(id_col).desc()).limit(limit)
    return rows.na.fill("")


def page_of(log: DataFrame, id_col: str, time_col: str, page: int, size: int = 5) -> DataFrame:
    """Page ``page`` (from 1) of the log, newest first, with ``pages``, the number of pages.

    A top-k of ``page * size`` rows, so no global sort; the position is counted among those only.
    """
    head = log.orderBy(F.col(time_col).desc_nulls_last(), F.col(id_col).desc()).limit(page * size)
    order = Window.orderBy(F.col(time_col).desc_nulls_last(), F.col(id_col).desc())
    total = log.agg(F.ceil(F.count("*") / size).alias("pages"))
    rows = head.withColumn("pos", F.row_number().over(order)).where(F.col("pos") > (page - 1) * size)
    return rows.crossJoin(F.broadcast(total))


def _ttl(seconds: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, expires = None, 0.0
        for batch in batches:
            keys, times = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hit = []
            for key, t in zip(keys, times):
                live = key == last and t <= expires
                hit.append(live)
                if not live:
                    last, expires = key, t + seconds
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.bool_()), batch.column(2)], names=["key", "at", "hit", "n"])

    return run


def cache_hits(log: DataFrame, query_col: str, time_col: str, *, ttl: float = 3600.0) -> DataFrame:
    """``(key, at, hit, n)`` of every access of a cache whose entries live ``ttl`` seconds from when they were set.

    The key is the normal form of the query; accesses without query or time are left out, ``at`` is in seconds. An
    entry is still found at the very second it expires; reading does not renew it. Each task streams its keys in time
    order and holds one key's expiry at a time, so a hot key costs time but no memory; equal accesses (same key and
    second) are one row with their number ``n``, which bounds a key's share by the seconds it spans.
    """
    rows = log.select(norm(query_col).alias("key"), F.unix_timestamp(F.col(time_col).cast("timestamp")).cast("double").alias("at")).where("key <> '' AND at IS NOT NULL")
    once = rows.groupBy("key", "at").agg(F.count("*").alias("n")).repartition("key").sortWithinPartitions("key", "at")
    return once.mapInArrow(_ttl(ttl), "key string, at double, hit boolean, n long")


def cached_values(log: DataFrame, cache: DataFrame, query_col: str, time_col: str, *, ttl: float | None = 3600.0, cleared: Column | None = None) -> DataFrame:
    """``log`` with ``value``, what ``cache(key, value, set_at)`` holds for the normal form of its query at that time.

    Of a key's entries the latest set by then counts; it is found up to ``ttl`` seconds later (``None``: always), and
    not at all if it was set before ``cleared``, the time the cache was last emptied. Times are in seconds; a null
    query or time finds nothing.
    """
    at = F.unix_timestamp(F.col(time_col).cast("timestamp")).cast("double")
    rows = log.withColumn("__key", norm(query_col)).withColumn("__at", at).withColumn("__row", F.monotonically_increasing_id())
    held = cache.select(F.col("key").alias("__key"), F.col("set_at").cast("double").alias("__set"), F.col("value").alias("__value"))
    if cleared is not None:
        held = held.where(F.col("__set") >= cleared)
    alive = (F.col("__set") <= F.col("__at")) & (F.lit(True) if ttl is None else F.col("__at") <= F.col("__set") + ttl)
    found = rows.select("__row", "__key", "__at").join(held, "__key").where(alive).groupBy("__row").agg(F.max_by("__value", "__set").alias("value"))
    return rows.join(found, "__row", "left").drop("__row", "__key", "__at")


def cache_stats(hits: DataFrame) -> DataFrame:
    """``(hits, misses, hit_rate)``; of equal accesses the first may miss, the rest hit."""
    h = F.sum(F.when(F.col("hit"), F.col("n")).otherwise(F.col("n") - 1))
    m = F.count_if(~F.col("hit"))
    out = hits.agg(F.coalesce(h, F.lit(0)).alias("hits"), m.alias("misses"))
    return out.withColumn("hit_rate", F.coalesce(F.round(F.try_divide("hits", F.col("hits") + F.col("misses")), 4), F.lit(0.0)))


def _recent(size: int):
    """The last ``size`` distinct keys of a task's accesses, oldest first, with their segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, None] = {}
        segment, rows = None, 0
        for batch in batches:
            rows += batch.num_rows
            if batch.num_rows:
                segment = batch.column(0)[0].as_py()
            for key in batch.column(1).to_pylist():
                held.pop(key, None)
                held[key] = None
                if len(held) > size:
                    del held[next(iter(held))]
        if segment is not None:
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([rows], pa.int64()), pa.array([list(held)], pa.list_(pa.string()))], names=["segment", "n", "keys"])

    return run


def _held(size: int, starts: dict[int, tuple[int, list[str | None]]]):
    """Each access with whether its key is held, and what it evicts, from the keys held where the segment begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, None] | None = None
        at = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                at, keys = starts[batch.column(0)[0].as_py()]
                held = dict.fromkeys(keys)
            found, out = [], []
            for key in batch.column(1).to_pylist():
                found.append(key in held)
                held.pop(key, None)
                held[key] = None
                gone = None
                if len(held) > size:
                    gone = next(iter(held))
                    del held[gone]
                out.append(gone)
            seq = pa.array(range(at + 1, at + batch.num_rows + 1), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([seq, batch.column(1), batch.column(2), pa.array(found, pa.bool_()), pa.array(out, pa.string())], names=["seq", "key", "at", "held", "evicted"])

    return run


def _expired(ttl: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, expires, first = None, 0.0, True
        for batch in batches:
            hit = []
            for key, at, held in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                live = held and not first and key == last and at <= expires
                hit.append(live)
                if not live:
                    last, expires, first = key, at + ttl, False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.bool_()), batch.column(4)], names=["seq", "key", "hit", "evicted"])

    return run


def lru_trace(log: DataFrame, key_col: str, order: list[str], *, size: int, ttl: float | None = None, time_col: str | None = None) -> DataFrame:
    """``(seq, key, hit, evicted)`` of a least-recently-used cache of ``size`` entries over the log in order.

    With ``ttl`` an entry is found up to and at that many seconds (of ``time_col``, a number) after it was set, reading
    doesn't renew it, and one that has expired keeps its place until it is asked for or evicted. ``order`` should tell
    all rows apart; equal ones come in any order.

    What is held before an access are the last ``size`` keys asked for, whether found or not, so the log is cut into
    segments by range: each gives its last ``size`` keys, their fold gives what every segment begins with (segments
    times ``size`` keys on the driver), and then all segments run at once. Expiry is settled key by key after that.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    at = F.col(time_col).cast("double") if time_col else F.lit(0.0)
    rows = log.select(F.col(key_col).cast("string").alias("key"), at.alias("at"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    by = [f"o{i}" for i in range(len(order))]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("segment"), "key", "at")
    rows = cut(rows)  # both passes see the same segments
    starts, held, seq = {}, [], 0
    for r in sorted(rows.mapInArrow(_recent(size), "segment int, n long, keys array<string>").collect(), key=lambda r: r["segment"]):
        starts[r["segment"]] = (seq, held)
        seq += r["n"]
        held = list(dict.fromkeys(reversed([*held, *r["keys"]])))[:size][::-1]
    shared = log.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _held(size, shared.value)(batches)

    traced = rows.mapInArrow(run, "seq long, key string, at double, held boolean, evicted string")
    if ttl is None:
        return traced.select("seq", "key", F.col("held").alias("hit"), "evicted")
    return traced.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(_expired(ttl), "seq long, key string, hit boolean, evicted string")


def log_report(log: DataFrame, id_col: str, time_col: str, query_col: str, limit: int = 20) -> DataFrame:
    """One row: ``(count, returned, logs, top_questions)``, the newest rows and the most frequent questions as arrays of structs."""
    newest = recent(log, id_col, time_col, limit)
    order = F.struct(F.col(time_col).isNotNull().alias("dated"), F.col(time_col), F.col(id_col))
    logs = newest.agg(F.reverse(F.array_sort(F.collect_list(F.struct(order.alias("by"), F.struct(*newest.columns).alias("row"))))).alias("l"))  # at most limit rows
    logs = logs.select(F.transform("l", lambda x: x["row"]).alias("logs"))
    top = top_questions(log, query_col).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("by"), "question", "n"))).alias("t"))
    top = top.select(F.transform("t", lambda x: F.struct(x["question"].alias("question"), x["n"].alias("n"))).alias("top_questions"))
    total = log.agg(F.count("*").alias("count"))
    return total.crossJoin(F.broadcast(logs)).crossJoin(F.broadcast(top)).select("count", F.size("logs").alias("returned"), "logs", "top_questions")
