"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary.

Texts are cut into pre-tokens by the vocabulary's pattern. A pre-token's bytes form a doubly linked list of symbols; a
priority queue holds the ranks of adjacent pairs, and the lowest rank merges first (ties: leftmost). Entries made stale
by a merge are skipped when they come up. Each Python worker keeps the pre-tokens it has encoded in a bounded table, so
the queue runs once per distinct pre-token. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed value: the pattern that cuts a text into pre-tokens
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
REMEMBERED = 300_000  # pre-tokens a worker keeps
REMEMBERED_LENGTH = 64  # of at most so many bytes each


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> id from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # symbol i spans piece[i:end[i]]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    queue = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            queue.append((rank, i, i + 2))
    heapify(queue)
    while queue:
        _, i, stop = heappop(queue)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue  # stale
        alive[j] = False
        end[i] = stop
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get(piece[i : end[k]])
            if rank is not None:
                heappush(queue, (rank, i, end[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get(piece[h:stop])
            if rank is not None:
                heappush(queue, (rank, h, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts; remembers pre-tokens up to a bound."""

    def __init__(self, data: bytes):
        self.ranks = load_ranks(data)
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace")
                ids = merge(raw, self.ranks)
                if len(raw) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "tokens"):
            self.tokens = {i: token for token, i in self.ranks.items()}
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(data: bytes) -> Encoder:
    """A worker's encoder of a vocabulary, kept from task to task with what it remembers."""
    return Encoder(data)


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [encode(t) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return run


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(shared.value).decode
        for batch in batches:
            texts = [None if ids is None else decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def _shared(df: DataFrame, vocabulary: str):
    """The vocabulary file, under a megabyte, read once by the driver and sent to the workers."""
    return df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())


def token_ids(docs: DataFrame, id_col: str, text_col: str, *, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(<id>, ids)``: one row per row of ``docs``; empty and null texts give the empty list. No special tokens."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encode(_shared(docs, vocabulary)), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, keep: list[str], text_col: str, *, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of tokens of each text (0 for null)."""
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_count(_shared(docs, vocabulary)), f"{schema}, tokens long")


def texts_of(tokens: DataFrame, id_col: str, ids_col: str, *, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(<id>, text)``: the texts of lists of ids; the empty list gives '', a null list null."""
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_decode(_shared(tokens, vocabulary)), f"id {kind}, text string").withColumnRenamed("id", id_col)
