"""Audit rows as a stream: idempotent appends, windowed counts, and the answer cache as keyed state."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import norm, strip


def append_audit(stream: DataFrame, path: str, checkpoint: str):
    """Starts appending micro-batches as parquet under their batch number; a replayed batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def risk_counts(stream: DataFrame, time_col: str, level_col: str, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(from, to, level, n)`` per tumbling window; rows later than ``late`` behind the newest are dropped by the watermark."""
    rows = stream.select(F.col(time_col).cast("timestamp").alias("at"), strip(level_col).alias("level")).where("at IS NOT NULL")
    counts = rows.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "level").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "level", "n")


BUCKETS = 1024  # of keys; a call for each key would cost more than its rows


def cached_answers(stream: DataFrame, query_col: str, time_col: str, *, ttl: float = 3600.0, late: str = "1 hour") -> DataFrame:
    """``(key, at, hit)``: whether each access would have found a live entry; a bucket's state is one expiry time a key.

    An entry lives up to and at the second it expires. It goes when the watermark, ``late`` behind the newest access,
    has passed that, so the store holds the keys of the last ``ttl`` and ``late`` only.
    """
    at = F.col(time_col).cast("timestamp")
    rows = stream.select(norm(query_col).alias("key"), at.alias("seen"), F.unix_timestamp(at).cast("double").alias("at")).where("key <> '' AND at IS NOT NULL")
    rows = rows.withColumn("bucket", F.pmod(F.hash("key"), F.lit(BUCKETS)))

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live: dict[str, float] = json.loads(state.get[0]) if state.exists else {}
        passed = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            own = pd.concat([pdf[["key", "at"]] for pdf in batches]).sort_values(["key", "at"])
            hits = []
            for key, t in zip(own["key"], own["at"]):
                hits.append(t <= live.get(key, -math.inf))
                if not hits[-1]:
                    live[key] = t + ttl
            yield own.assign(hit=hits)
        live = {key: expires for key, expires in live.items() if int(expires * 1000) + 1000 > passed}
        if live:
            state.update((json.dumps(live),))
            state.setTimeoutTimestamp(int(min(live.values()) * 1000) + 1000)
        elif state.exists:
            state.remove()

    return (
        rows.withWatermark("seen", late).groupBy("bucket")
        .applyInPandasWithState(step, "key string, at double, hit boolean", "live string", "append", GroupStateTimeout.EventTimeTimeout)
    )
