"""Problem 1: near-duplicate texts (word triples, Jaccard similarity at or above a threshold).

Plan
----
1. One Arrow pass turns each text into a fingerprint set (64-bit hashes of its distinct word triples), of which it
   keeps the *segment-popcount embedding* (the hash space is cut into ``SEGMENTS`` segments; the vector holds how many
   fingerprints fall into each) and band keys of several min-hashes each (``banding``). The rows are persisted.
2. Band keys travel as packed blobs (one row per input batch and target partition), each entry with the four coarse
   popcounts of its text. Inside a band key's bucket, texts lie on a grid of total popcount; only neighbours whose
   coarse Manhattan distance is within the bound become candidates (range join on the grid). Band keys that hold too
   much for a task are found by exact coarse counts before anything is gathered; their entries are cut into blocks by
   a hash of the text, and each two blocks meet in a task of their own.
3. Candidates meet the full popcount vectors: for sets A and B the Manhattan distance of the vectors is at most
   |A symmetric-difference B|, and similarity t allows at most (1-t)/(1+t) (|A|+|B|) of that, so a larger distance
   rejects the pair exactly.
4. What is left is verified on the texts themselves.

The popcounts alone cannot select at a similarity as low as 0.6 (two unrelated texts of like length are within the
bound in every grid of few dimensions), hence the band keys in front of them: a pair at similarity s shares a bucket
with probability 1-(1-s**rows)**bands. ``banding`` takes the longest keys that reach ``RECALL`` at the threshold within
``MOST_BANDS``: at 0.6 64 bands of 5, i.e. 0.994 at 0.60, 0.9996 at 0.65 and 0.99999 at 0.70; at 0.8 57 bands of 11.

Equal texts are one node throughout (identified by a 64-bit hash of the text), so a group of copies, however large,
is compared once.

Groups are the connected components of the links, found by alternating large-star and small-star contraction over the
edges (a logarithmic number of rounds where label propagation needs one a step of the longest chain), each round cut to
the shared folder; no node's neighbours are gathered and nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, width
from .textcodes import distinct_per_text, mix, ngram_hashes, word_hashes

SEGMENTS, COARSE = 64, 4
RECALL, MOST_BANDS = 0.994, 64  # of pairs just at the threshold; band keys a text has
EXPANDED_COPIES = 64  # default of the parameter ``expand``
BATCH = 2048
SLICE = 1 << 20
ENTRIES = 1_500_000  # of band keys in a task of the grid join, 17 bytes each
LARGE_BUCKET = 8192  # texts in a band key's bucket from which its blocks go to other tasks
BLOCK = 2048
COUNTERS = 1 << 16  # coarse counters of band keys
HOT = 65_536  # entries, and HOT_SHARE of a counter's mean, from which a counter's keys are cut into blocks
HOT_SHARE = 4
HOT_BLOCK = 4096  # entries of a block of such a key
REMEMBERED = 200_000  # texts a task remembers, so that a text on many rows is embedded once
_ENTRY = np.dtype([("sig", "<u4"), ("node", "<i8"), ("seg", "u1", (COARSE,))])


def banding(threshold: float, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """``(bands, rows)``: the most min-hashes a key with which ``most`` bands miss at most ``1 - recall`` of the pairs at the threshold."""
    if threshold >= 1:
        return 1, 1
    need = lambda rows: math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
    rows = max((r for r in range(1, 17) if need(r) <= most), default=1)
    return need(rows), rows


def _multipliers(n: int) -> np.ndarray:
    x = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def fingerprint(texts: list[str], shingle: int):
    """Distinct n-gram hashes, their text indexes and their numbers per text."""
    x, of = distinct_per_text(*ngram_hashes(*word_hashes(texts), shingle))
    return x, of, np.bincount(of, minlength=len(texts))


def popcounts(x: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """The segment-popcount vectors, capped at 255 (a cap can only lower a distance)."""
    cell = of * SEGMENTS + (x >> np.uint64(58)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=texts * SEGMENTS), 255).astype(np.uint8).reshape(texts, SEGMENTS)


def _embed(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _multipliers(bands * rows)
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                node = part.column(0).to_numpy(zero_copy_only=False)
                node, first = np.unique(node, return_index=True)
                if seen:
                    fresh = np.fromiter((x not in seen for x in node.tolist()), bool, len(node))
                    node, first = node[fresh], first[fresh]
                if len(seen) < REMEMBERED:
                    seen.update(node.tolist())
                if not len(node):
                    continue
                texts = part.column(1).take(pa.array(first)).to_pylist()
                x, of, n = fingerprint(texts, shingle)
                has = np.flatnonzero(n)
                if not len(has):
                    continue
                start = np.concatenate(([0], np.cumsum(n[has])[:-1]))
                short = (x >> np.uint64(13)).astype(np.uint32)
                sig = np.empty((len(has), bands), np.uint32)
                for band in range(bands):
                    h = np.full(len(has), band + 1, np.uint64)
                    for j in range(band * rows, band * rows + rows):
                        h = mix(h + np.minimum.reduceat((short ^ a[j - 1]) * a[j], start))
                    sig[:, band] = (h >> np.uint64(32)).astype(np.uint32)
                vec = popcounts(x, of, len(texts))[has]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node[has]),
                        pa.array(n[has].astype(np.int32)),
                        pa.array([v.tobytes() for v in vec], pa.binary()),
                        pa.array([s.tobytes() for s in sig], pa.binary()),
                    ],
                    names=["node", "n", "vec", "sig"],
                )

    return run


def _keys(sig: np.ndarray) -> np.ndarray:
    """The hash of each band key ``[text, band]``: it depends on the band and the key, so one band spreads over all partitions."""
    return mix(sig.astype(np.uint64) + np.arange(sig.shape[1], dtype=np.uint64)[None, :] * np.uint64(1 << 32))


def _signatures(column: pa.Array, bands: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, bands)


def _count_keys(bands: int):
    """Entries of each coarse counter of band keys, one row per counter used in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            if batch.num_rows:
                counts += np.bincount((_keys(_signatures(batch.column(0), bands)) >> np.uint64(48)).astype(np.int64).ravel(), minlength=COUNTERS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["counter", "n"])

    return run


def _spread(entry: np.ndarray, key: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries, bands and keys with those of counters of several blocks once for each pair of blocks of theirs."""
    band = np.broadcast_to(np.arange(entry.shape[1], dtype=np.uint8), entry.shape)
    parts = blocks[(key >> np.uint64(48)).astype(np.int64)]
    cold = parts == 1
    out = [(entry[cold], band[cold], key[cold])]
    for i, j in zip(*np.nonzero(~cold)):
        r = int(parts[i, j])
        own = int(mix(entry["node"][i, j].view(np.uint64) + np.uint64(77)) % np.uint64(r))
        other = np.arange(r, dtype=np.uint64)
        pair = np.minimum(own, other) * np.uint64(r) + np.maximum(own, other)
        salted = mix(key[i, j] + mix(pair + np.uint64(1)))
        copies = np.repeat(entry[i, j], r)
        copies["sig"] = (salted >> np.uint64(16)).astype(np.uint32)  # its own bucket in the grid join
        out.append((copies, np.full(r, j, np.uint8), salted))
    return tuple(np.concatenate(x) for x in zip(*out))


def _scatter(parts: int, bands: int, blocks: np.ndarray | None = None):
    """Embedded rows -> blobs of entries, one per batch and target partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy(zero_copy_only=False)
            vec = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, COARSE, SEGMENTS // COARSE)
            seg = np.minimum(vec.sum(axis=2, dtype=np.int64) // 2, 255).astype(np.uint8)
            sig = _signatures(batch.column(2), bands)
            entry = np.empty((len(node), bands), _ENTRY)
            entry["sig"], entry["node"], entry["seg"] = sig, node[:, None], seg[:, None, :]
            key = _keys(sig)
            if blocks is None:
                flat, key, band = entry.ravel(), key.ravel(), np.tile(np.arange(bands, dtype=np.uint8), len(node))
            else:
                flat, band, key = _spread(entry, key, blocks)
            where = (key % np.uint64(parts)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            flat, band, where = flat[order], band[order], where[order]
            cuts = np.searchsorted(where, np.arange(parts + 1))
            used = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used.astype(np.int32)),
                    pa.array([band[cuts[p] : cuts[p + 1]].tobytes() + flat[cuts[p] : cuts[p + 1]].tobytes() for p in used], pa.large_binary()),
                ],
                names=["part", "blob"],
            )

    return run


def _near(seg_a: np.ndarray, seg_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether coarse (halved) popcounts leave room for the threshold; halving loses at most one per segment and side."""
    near = np.abs(seg_a - seg_b).sum(axis=1)
    total = seg_a.sum(axis=1) + seg_b.sum(axis=1)
    bound = (1 - threshold) / (1 + threshold)
    return (2 * near - 2 * COARSE <= bound * (2.0 * total + 2 * COARSE)) | (seg_a.max(axis=1) == 255) | (seg_b.max(axis=1) == 255)


def _reach(size: np.ndarray, threshold: float) -> np.ndarray:
    """The largest half popcount whose text can still be similar to one of ``size``."""
    return np.where(size >= COARSE * 255, 1 << 20, np.floor((size + COARSE) / threshold).astype(np.int64) + COARSE)


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    if not len(pair):
        return None
    none = pa.nulls(len(pair), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), none, none], names=["node_a", "node_b", "left", "right"])


def _grid_join(threshold: float):
    """Blobs of one partition -> candidate pairs within each band key's bucket, and the block pairs of oversized buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, entries = [], []
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                count = len(blob) // (1 + _ENTRY.itemsize)
                bands.append(np.frombuffer(blob, np.uint8, count))
                entries.append(np.frombuffer(blob, _ENTRY, count, offset=count))
        if not entries:
            return
        key = (np.concatenate(bands).astype(np.uint64) << np.uint64(32)) | np.concatenate([e["sig"] for e in entries])
        node = np.concatenate([e["node"] for e in entries])
        seg = np.concatenate([e["seg"] for e in entries])
        del bands, entries
        order = np.argsort(key, kind="stable")
        key, node, seg = key[order], node[order], seg[order]
        alone = np.ones(len(key), bool)
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[1:] != key[:-1]
        key, node, seg = key[~alone], node[~alone], seg[~alone].astype(np.int16)
        if not len(key):
            return
        size = seg.sum(axis=1).astype(np.int64)  # half the popcount: the grid's axis
        order = np.lexsort((node, size, key))
        key, node, seg, size = key[order], node[order], seg[order], size[order]
        keep = np.ones(len(key), bool)  # copies met in several batches
        keep[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, seg, size = key[keep], node[keep], seg[keep], size[keep]
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        large = np.repeat(np.diff(edge) > LARGE_BUCKET, np.diff(edge))
        for lo, hi in zip(edge[:-1], edge[1:]):
            if hi - lo > LARGE_BUCKET:  # other tasks compare its blocks
                yield from _block_pairs(node[lo:hi], seg[lo:hi], size[lo:hi], threshold)
        key, node, seg, size = key[~large], node[~large], seg[~large], size[~large]
        if not len(key):
            return
        bucket = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
        axis = bucket * (1 << 21) + size
        last = np.searchsorted(axis, bucket * (1 << 21) + _reach(size, threshold), side="right")
        count = last - np.arange(len(key)) - 1
        done = np.concatenate(([0], np.cumsum(count)))
        at = 0
        while at < len(key):  # slices of bounded size: a bucket row has fewer than LARGE_BUCKET neighbours
            to = max(at + 1, int(np.searchsorted(done, done[at] + SLICE, side="right")) - 1)
            c = count[at:to]
            i = np.repeat(np.arange(at, to), c)
            j = i + 1 + np.arange(len(i)) - np.repeat(done[at:to] - done[at], c)
            ok = _near(seg[i], seg[j], threshold)
            if (out := _pairs_batch(node[i[ok]], node[j[ok]])) is not None:
                yield out
            at = to

    return run


def _block_pairs(node: np.ndarray, seg: np.ndarray, size: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """The blocks of a bucket in size order, each with every block in its reach, for ``_compare_blocks``."""
    entry = np.empty(len(node), _ENTRY)
    entry["sig"], entry["node"], entry["seg"] = 0, node, seg
    starts = np.arange(0, len(node), BLOCK)
    for lo in starts:
        left = entry[lo : lo + BLOCK]
        end = int(np.searchsorted(size, _reach(size[lo : lo + BLOCK][-1:], threshold)[0], side="right"))
        for other in starts[(starts >= lo) & (starts < end)]:
            where = pa.array([int(lo)]), pa.array([int(other)])
            yield pa.RecordBatch.from_arrays(
                [*where, pa.array([left.tobytes()], pa.binary()), pa.array([entry[other : other + BLOCK].tobytes()], pa.binary())], names=["node_a", "node_b", "left", "right"]
            )


def _compare_blocks(threshold: float):
    """Passes candidate pairs on and compares block pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = batch.column(2).is_null()
            yield batch.filter(plain).select([0, 1])
            for x, y in zip(*(batch.filter(pa.compute.invert(plain)).column(c).to_pylist() for c in (2, 3))):
                a, b = np.frombuffer(x, _ENTRY), np.frombuffer(y, _ENTRY)
                sa, sb = a["seg"].astype(np.int16), b["seg"].astype(np.int16)
                for lo in range(0, len(a), 256):
                    i = np.repeat(np.arange(lo, min(lo + 256, len(a))), len(b))
                    j = np.tile(np.arange(len(b)), len(i) // len(b))
                    ok = (a["node"][i] != b["node"][j]) & _near(sa[i], sb[j], threshold)
                    if (out := _pairs_batch(a["node"][i[ok]], b["node"][j[ok]])) is not None:
                        yield out.select([0, 1])

    return run


def _within_bound(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            va, vb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SEGMENTS).astype(np.int16) for c in (4, 5))
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            ok = np.abs(va - vb).sum(axis=1) <= (1 - threshold) / (1 + threshold) * n + 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["node_a", "node_b"]).filter(pa.array(ok))

    return run


def _verify(shingle: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            ids, first = np.unique(np.concatenate([a, b]), return_index=True)
            texts = pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(first)).to_pylist()
            x, of, n = fingerprint(texts, shingle)
            cut_at = np.cumsum(n)[:-1]
            sets = np.split(x, cut_at)
            pa_, pb_ = np.searchsorted(ids, a), np.searchsorted(ids, b)
            both = np.fromiter((len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(pa_, pb_)), np.int64, len(a))
            sim = both / np.maximum(n[pa_] + n[pb_] - both, 1)
            keep = pa.array(sim >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], names=["node_a", "node_b", "similarity"]).filter(keep)

    return run


def near_duplicate_links(docs: DataFrame, id_col: str, text_col: str, *, shingle: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Similar texts of ``docs``.

    Returns ``(links, members)``: ``links(node_a, node_b, similarity)`` between different texts, ``node_a < node_b``,
    and ``members(node, <id_col>)``, the rows of each text. Null texts and texts of fewer than ``shingle`` words are
    in neither links nor members. Columns of ``docs`` other than the two named are not read. No pair within a group
    of equal texts is made here.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = docs.sparkSession
    bands, rows = banding(threshold)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    texts = texts.withColumn("node", F.xxhash64("text"))
    embedded = (
        texts.select("node", "text")
        .mapInArrow(_embed(shingle, bands, rows), "node long, n int, vec binary, sig binary")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    # the counts fill the cache; a task of the grid join gets about ENTRIES entries whatever the table's size
    blocks, entries = _hot_blocks(embedded, bands)
    parts = max(width(spark), -(-entries // ENTRIES))
    pairs = (
        embedded.select("node", "vec", "sig")
        .mapInArrow(_scatter(parts, bands, blocks), "part int, blob binary")
        .repartitionById(parts, "part")
        .mapInArrow(_grid_join(threshold), "node_a long, node_b long, left binary, right binary")
        .repartition(parts, "node_a", "node_b")
        .mapInArrow(_compare_blocks(threshold), "node_a long, node_b long")
        .distinct()
    )
    vectors = embedded.select("node", "n", "vec").dropDuplicates(["node"])
    va = vectors.select(F.col("node").alias("node_a"), F.col("n").alias("n_a"), F.col("vec").alias("vec_a"))
    vb = vectors.select(F.col("node").alias("node_b"), F.col("n").alias("n_b"), F.col("vec").alias("vec_b"))
    near = (
        pairs.join(va, "node_a").join(vb, "node_b").select("node_a", "node_b", "n_a", "n_b", "vec_a", "vec_b")
        .mapInArrow(_within_bound(threshold), "node_a long, node_b long")
    )
    near = cut(near)
    embedded.unpersist()
    wanted = near.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct()
    bodies = texts.select("node", "text").join(_small(wanted), "node", "left_semi").dropDuplicates(["node"])
    ta = bodies.select(F.col("node").alias("node_a"), F.col("text").alias("text_a"))
    tb = bodies.select(F.col("node").alias("node_b"), F.col("text").alias("text_b"))
    links = (
        near.join(ta, "node_a").join(tb, "node_b").select("node_a", "node_b", "text_a", "text_b")
        .mapInArrow(_verify(shingle, threshold), "node_a long, node_b long, similarity double")
    )
    members = texts.where(_enough("text", shingle)).select("node", F.col("id").alias(id_col))
    return links, members


def _hot_blocks(embedded: DataFrame, bands: int) -> tuple[np.ndarray | None, int]:
    """The blocks the keys of each coarse counter are cut into (None if each is one), and the entries this makes.

    A counter is hot if it holds ``HOT`` entries and ``HOT_SHARE`` times the mean, so that one of its keys does.
    """
    counts = embedded.select("sig").mapInArrow(_count_keys(bands), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    need = max(HOT, HOT_SHARE * total / COUNTERS)
    hot = counts.where(F.col("n") >= need).collect() if total >= need else []  # at most COUNTERS / HOT_SHARE
    if not hot:
        return None, total
    blocks = np.ones(COUNTERS, np.int64)
    for r in hot:
        blocks[r["counter"]] = -(-r["n"] // HOT_BLOCK)
    return blocks, total + sum(r["n"] * int(blocks[r["counter"]] - 1) for r in hot)


def _enough(text: str, shingle: int) -> Column:
    """Whether a text has at least ``shingle`` words."""
    return F.col(text).rlike(r"(?:[\p{L}\p{N}]+[^\p{L}\p{N}]+){%d}[\p{L}\p{N}]" % (shingle - 1))


SMALL_ROWS = 500_000


def _small(ids: DataFrame) -> DataFrame:
    """``ids``, marked for broadcast if it is counted to be under ``SMALL_ROWS`` rows (8 bytes each)."""
    return F.broadcast(ids) if ids.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else ids


def near_duplicate_pairs(docs: DataFrame, id_col: str, text_col: str, *, shingle: int = 5, threshold: float = 0.8, expand: int | None = EXPANDED_COPIES) -> DataFrame:
    """Pairs of rows ``(<id>_a, <id>_b)``, a < b, of similar or equal texts.

    A group of more than ``expand`` equal texts is not expanded: its rows are paired with the group's smallest id only,
    and other texts with that id only, so that the links stay whole but linear in the rows. With ``None`` every group is
    expanded into all its pairs, whose number is the square of its rows. ``near_duplicate_links`` has one form, links
    between texts and the rows of each text, at every size; ``near_duplicate_groups`` counts every link of every row.
    """
    links, members = near_duplicate_links(docs, id_col, text_col, shingle=shingle, threshold=threshold)
    a, b = f"{id_col}_a", f"{id_col}_b"
    copies = members.groupBy("node").agg(F.min(id_col).alias("head"), F.count("*").alias("copies"))
    many = copies.where("copies > 1")
    linked = links.select(F.explode(F.array("node_a", "node_b")).alias("node"))
    used = members.join(linked.unionByName(many.select("node")).distinct(), "node", "left_semi")
    used = cut(used.join(many, "node", "left"))
    large = F.lit(False) if expand is None else F.coalesce(F.col("copies"), F.lit(1)) > expand
    shown = used.where(~large | (F.col(id_col) == F.col("head"))).select("node", id_col)
    across = (
        links.join(shown.select(F.col("node").alias("node_a"), F.col(id_col).alias("x")), "node_a")
        .join(shown.select(F.col("node").alias("node_b"), F.col(id_col).alias("y")), "node_b")
        .select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b))
    )
    few = used.where((F.col("copies") > 1) & ~large).select("node", id_col)
    within = few.select("node", F.col(id_col).alias(a)).join(few.select("node", F.col(id_col).alias(b)), "node").where(F.col(a) < F.col(b)).select(a, b)
    star = used.where(large & (F.col(id_col) != F.col("head"))).select(F.col("head").alias(a), F.col(id_col).alias(b))
    return across.unionByName(within).unionByName(star)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(node_a, node_b)``; the root is the smallest node of the component."""
    edges = cut(edges.where("node_a <> node_b").select(F.greatest("node_a", "node_b").alias("u"), F.least("node_a", "node_b").alias("v")).distinct())
    state = None
    while True:
        # large star: a node's larger neighbours are hung on the smallest of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours are hung on the smallest of them
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        moved = hung.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # the rounds end when one changes no edge: each node then hangs on its component's smallest
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicate_groups(docs: DataFrame, id_col: str, text_col: str, *, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(<id>, class_id, links)``: every row of ``docs`` once, with its group and its number of similar or equal rows.

    A group holds the rows that chains of similar texts connect; ``class_id`` is its smallest id. ``links`` counts
    every other row at or above the threshold, equal texts included, whatever the size of a group of copies. A null
    text, one of fewer than ``shingle`` words and one like no other stand alone: their own id and 0.
    """
    links, members = near_duplicate_links(docs, id_col, text_col, shingle=shingle, threshold=threshold)
    links = cut(links.select("node_a", "node_b"))
    texts = cut(members.groupBy("node").agg(F.min(id_col).alias("head"), F.count("*").alias("copies")))
    roots = components(links)
    classes = roots.join(texts, "node").groupBy("root").agg(F.min("head").alias("class_id"))
    linked = roots.join(classes, "root").select("node", "class_id")
    either = links.unionByName(links.select(F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b")))
    others = either.join(texts.select(F.col("node").alias("node_b"), "copies"), "node_b").groupBy(F.col("node_a").alias("node")).agg(F.sum("copies").alias("others"))
    known = texts.join(linked, "node", "left").join(others, "node", "left").select(
        "node", F.coalesce("class_id", "head").alias("class_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links")
    )
    grouped = members.join(known, "node").select(id_col, "class_id", "links")
    alone = docs.where(~F.coalesce(_enough(text_col, shingle), F.lit(False))).select(F.col(id_col), F.col(id_col).alias("class_id"), F.lit(0).cast("long").alias("links"))
    return grouped.unionByName(alone)
