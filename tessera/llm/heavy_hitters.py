"""Problem 3: the most frequent values of a column, by iceberg multi-hash filtering in bounded memory.

Pass 1 counts, exactly, how many rows fall into each of a number of buckets under each of ``HASHES`` hash functions,
however many distinct values there are; the number follows from the share asked for (``buckets_for``), so that a bucket
holds an eighth of it on average. A value that holds a share s of the
rows lies in a bucket of at least that count under every hash, so only values all of whose buckets reach the threshold
survive; at most 1/s buckets per hash can, which bounds what the driver learns. Pass 2 counts the survivors exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

HASHES = 3
LEAST_BITS, MOST_BITS = 14, 21  # disjoint bits of one 64-bit hash
LITERALS = 1000  # buckets that are looked up as literals; more are joined


def buckets_for(share: float) -> int:
    """Bits of the bucket number: 2**bits is eight times ``1 / share`` or the next power of two, within the bounds.

    Shares below 2**-18 leave more values to be counted exactly, but none out.
    """
    return min(max(math.ceil(math.log2(8 / share)), LEAST_BITS), MOST_BITS)


def stripped(c: Column) -> Column:
    """``c`` without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _count_buckets(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((HASHES, 1 << bits), np.int64)
        total = 0
        for batch in batches:
            total += batch.num_rows
            x = batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(HASHES):
                at = ((x >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                counts[k] += np.bincount(at, minlength=1 << bits)
        k, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(k, -1).astype(np.int32)),
                pa.array(np.append(bucket, 0).astype(np.int64)),
                pa.array(np.append(counts[k, bucket], total)),
            ],
            names=["k", "bucket", "n"],
        )

    return run


def frequent_values(df: DataFrame, col: str, *, share: float) -> DataFrame:
    """``(value, n)``: values of string column ``col``, outer white space dropped, on at least ``share`` of all rows.

    Rows with null or blank values count towards "all rows" but are no values. An empty table gives no rows.
    ``n`` is exact. ``share`` must be in (0, 1].
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    value = stripped(F.col(col))
    values = df.select(F.when(value != "", value).alias("value")).withColumn("h", F.when(F.col("value").isNotNull(), F.xxhash64("value")))
    bits = buckets_for(share)
    counted = values.select("h").mapInArrow(_count_buckets(bits), "k int, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    counted = cut(counted)  # a row per hash and bucket, read twice
    total = counted.where("k = -1").select("n").first()
    total = total[0] if total else 0
    need = max(1, int(np.ceil(share * total - 1e-9)))
    heavy = counted.where((F.col("k") >= 0) & (F.col("n") >= need)).select("k", "bucket")
    held = heavy.collect()  # at most 1/share per hash
    rows = values.where(F.col("h").isNotNull())
    for k in range(HASHES):
        own = [r["bucket"] for r in held if r["k"] == k]
        at = F.shiftrightunsigned("h", bits * k).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        if len(own) <= LITERALS:
            rows = rows.where(at.isin(own) if own else F.lit(False))
        else:
            rows = rows.join(F.broadcast(heavy.where(F.col("k") == k).select("bucket")), at == F.col("bucket"), "left_semi")
    return rows.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= need)
