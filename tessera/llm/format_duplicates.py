"""Problem 2: records that differ only in white space, case, punctuation or field order.

One Arrow pass streams the code points of a batch through a skip-and-fold table (0 for what does not count, else the
lower-cased code) into two rolling polynomial hashes per record; no canonical string is built there. A record of
fields (``word: value`` items between ``;``, ``|`` and line breaks) gets the sum of its mixed item hashes instead, which
does not depend on the order of the items. Counting runs on the 128 bits with map-side combination, so a group of any
size costs one row per task, and only rows whose key another row has are shuffled with their texts (the keys are
broadcast if counted to be few), groups of over ``SLICE`` rows in several slices. There each row is held against the
first of its group and slice by a two-pointer comparison that skips what does not count; records that share their 128
bits and still differ are groups of their own. The canonical text is made once per group and slice, as the result asks
for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut
from .textcodes import codes_of, mix, word_char_table

_BASES = (np.uint64(0x9E6C63D0876A9A47), np.uint64(0xC2B2AE3D27D4EB4F))
_SEPARATORS = ";|\r\n"


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """0 for code points that do not count, else the code of the lower-cased character."""
    table = np.zeros(0x110000, np.uint32)
    for i in np.flatnonzero(word_char_table()):
        table[i] = ord(chr(i).lower()[0])
    return table


@lru_cache(maxsize=1)
def _space_table() -> np.ndarray:
    return np.fromiter((chr(i).isspace() for i in range(0x110000)), dtype=bool, count=0x110000)


def _sums(value: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sum modulo 2**64 of ``value`` over the ascending ``group`` numbers."""
    out = np.zeros(groups, np.uint64)
    if len(value):
        at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        out[group[at]] = np.add.reduceat(value, at)
    return out


def _poly(folded: np.ndarray, group: np.ndarray, groups: int, base: np.uint64) -> np.ndarray:
    """Rolling polynomial hash of the folded codes of each group."""
    if not len(folded):
        return np.zeros(groups, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    length = np.diff(np.concatenate((first, [len(group)])))
    place = np.arange(len(group)) - np.repeat(first, length)
    powers = np.ones(int(length.max()) + 1, np.uint64)
    powers[1:] = base
    powers = np.multiply.accumulate(powers)
    return mix(_sums(mix(folded.astype(np.uint64) * base) * powers[place], group, groups))


def record_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each record and whether anything in it counts."""
    codes = codes_of("\n".join(texts) + "\n")
    rows = len(texts)
    limits = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, rows))
    folded = fold_table()[codes]
    at = np.flatnonzero(folded)
    row = np.searchsorted(limits, at, side="right")
    kept = folded[at]
    filled = np.bincount(row, minlength=rows) > 0
    # items: between separators; the break that joins the rows is one too
    is_sep = np.isin(codes, np.fromiter(map(ord, _SEPARATORS), np.uint32))
    item_of_code = np.cumsum(is_sep) - is_sep
    items = int(item_of_code[-1]) + 1 if len(codes) else 0
    item = item_of_code[at]
    used = np.unique(item)
    begins = np.searchsorted(item, used)  # first counting character of each item
    stop = np.searchsorted(item, used, side="right")
    ends_word = np.ones(len(at), bool)
    ends_word[:-1] = at[1:] != at[:-1] + 1
    word_end = np.flatnonzero(ends_word)
    name_end = word_end[np.searchsorted(word_end, begins)]
    solid = np.flatnonzero(~_space_table()[codes] | is_sep)  # what is not blank
    lead = solid[np.searchsorted(solid, at[begins]) - 1] if len(begins) else begins
    starts_item = (np.searchsorted(solid, at[begins]) == 0) | is_sep[lead] if len(begins) else np.zeros(0, bool)
    after = solid[np.minimum(np.searchsorted(solid, at[name_end], side="right"), len(solid) - 1)] if len(begins) else begins
    marked = (codes[after] == ord(":")) | (codes[after] == ord("="))
    is_field = starts_item & marked & (name_end + 1 < stop)
    item_row = row[begins] if len(begins) else begins
    many = np.bincount(item_row, minlength=rows)
    good = np.bincount(item_row, weights=is_field, minlength=rows)
    fields = (many >= 2) & (good == many)
    out = []
    for base in _BASES:
        plain = _poly(kept, row, rows, base)
        if fields.any():
            by_item = _poly(kept, item, items, base)
            bag = _sums(mix(by_item[used] + base), item_row, rows)
            plain = np.where(fields, mix(bag + np.uint64(1)), plain)
        out.append(plain.view(np.int64))
    return out[0], out[1], filled


def split_fields(text: str) -> list[str] | None:
    """The items of a record of fields, or None if the text is not one."""
    parts = text.replace("|", ";").replace("\r", ";").replace("\n", ";").split(";")
    parts = [p for p in parts if any(map(str.isalnum, p))]
    if len(parts) < 2:
        return None
    for part in parts:
        body = part.lstrip()
        n = next((i for i, ch in enumerate(body) if not ch.isalnum()), len(body))
        rest = body[n:].lstrip()
        if not n or rest[:1] not in (":", "=") or not any(map(str.isalnum, rest)):
            return None
    return parts


def canonical(text: str) -> str:
    """The text's letters and digits, lower-cased; of a record of fields its items so made, sorted, joined by '|'."""
    fold = fold_table()

    def squeeze(s: str) -> str:
        return "".join(map(chr, filter(None, fold[codes_of(s)].tolist())))

    fields = split_fields(text)
    return "|".join(sorted(map(squeeze, fields))) if fields else squeeze(text)


def _alike(x: list[int], y: list[int]) -> bool:
    """Two pointers over folded codes, each skipping what does not count."""
    i = j = 0
    n, m = len(x), len(y)
    while True:
        while i < n and not x[i]:
            i += 1
        while j < m and not y[j]:
            j += 1
        if i == n or j == m:
            return i == n and j == m
        if x[i] != y[j]:
            return False
        i += 1
        j += 1


def same_record(a: str, b: str) -> bool:
    """Two-pointer comparison over what counts; of records of fields, item by item, whatever their order."""
    if a == b:
        return True
    fold = fold_table()
    folded = lambda s: fold[codes_of(s)].tolist()
    fa, fb = split_fields(a), split_fields(b)
    if fa is None and fb is None:
        return _alike(folded(a), folded(b))
    if fa is None or fb is None or len(fa) != len(fb):
        return False
    left = list(map(folded, fb))
    for item in map(folded, fa):  # mostly the first that is left
        at = next((k for k, other in enumerate(left) if _alike(item, other)), None)
        if at is None:
            return False
        del left[at]
    return True


def _keys(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, filled = record_hashes(batch.column(1).to_pylist())
            cols, names = [batch.column(0), pa.array(h1), pa.array(h2)], ["row_id", "h1", "h2"]
            if with_text:
                cols, names = [*cols, batch.column(1)], [*names, "text"]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(filled))

    return run


SLICE = 1_000_000  # rows of a group that meet in one task
FEW_KEYS = 500_000  # keys of 28 bytes that are broadcast


class _Group:
    """The rows of one key and slice, by what they really are: each kind's first text, canonical text, held-back row, least id and number."""

    def __init__(self, key: tuple):
        self.key = key
        self.kinds: list[list] = []

    def add(self, row_id, text: str) -> Iterator[tuple]:
        """Rows ``(row_id, canonical text)`` that this one settles: a kind's first row waits for a second."""
        for kind in self.kinds:
            if same_record(text, kind[0]):
                if kind[2] is not None:
                    yield kind[2][0], kind[1]
                    kind[2] = None
                yield row_id, kind[1]
                kind[3], kind[4] = min(kind[3], row_id), kind[4] + 1
                return
        self.kinds.append([text, canonical(text), (row_id,), row_id, 1])

    def rest(self) -> Iterator[tuple]:
        """A row alone in its slice has its like in another, unless the key turned out to hold several kinds."""
        if len(self.kinds) == 1 and self.kinds[0][2] is not None:
            yield self.kinds[0][2][0], self.kinds[0][1]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Group | None, list[tuple]]]:
    """Finished groups and settled rows, batch by batch; the input is ordered by key and slice."""
    group: _Group | None = None
    for batch in batches:
        out = []
        for row_id, *key, text in zip(*(batch.column(c).to_pylist() for c in range(5))):
            if group is None or group.key != tuple(key):
                if group is not None:
                    out += group.rest()
                    yield group, []
                group = _Group(tuple(key))
            out += group.add(row_id, text)
        yield None, out
    if group is not None:
        yield group, list(group.rest())


def _confirm(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, out in _groups(batches):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], kind), pa.array([t for _, t in out], pa.string())], names=["row_id", "norm_text"])

    return run


def _tally(kind: pa.DataType):
    """The kinds of each key: a digest of what the rows are, their least id and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out():
            cols = list(zip(*held)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), kind, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["h1", "h2", "digest", "first_id", "copies"])

        for group, _ in _groups(batches):
            if group is not None:
                held += [(*group.key[:2], blake2b(k[1].encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), k[3], k[4]) for k in group.kinds]
            if len(held) >= 10_000:
                yield out()
                held = []
        yield out()

    return run


def record_keys(docs: DataFrame, id_col: str, text_col: str, *, with_text: bool = False) -> DataFrame:
    """``(row_id, h1, h2)``, and ``text`` if asked, of the rows in which anything counts; null and contentless texts are left out."""
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    text = ", text string" if with_text else ""
    return rows.mapInArrow(_keys(with_text), f"row_id {rows.schema['row_id'].dataType.simpleString()}, h1 long, h2 long{text}")


def _counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(h1, h2, copies, first_id)`` of every key."""
    return record_keys(docs, id_col, text_col).groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("row_id").alias("first_id"))


def _shared_rows(docs: DataFrame, id_col: str, text_col: str, repeated: DataFrame) -> DataFrame:
    """``(row_id, h1, h2, slice, text)`` of the rows whose key is among ``repeated(h1, h2, copies)``, key by key and slice by slice."""
    few = repeated.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    rows = record_keys(docs, id_col, text_col, with_text=True).join(F.broadcast(repeated) if few else repeated, ["h1", "h2"])
    part = F.pmod(F.xxhash64("row_id", F.lit(5)), F.ceil(F.col("copies") / SLICE)).cast("int")
    rows = rows.select("row_id", "h1", "h2", part.alias("slice"), "text")
    return rows.repartition("h1", "h2", "slice").sortWithinPartitions("h1", "h2", "slice")


def duplicate_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row_id, norm_text)`` of every row whose normalised text another row has too.

    Null texts and texts without letters or digits are in no group. Repeated ids are kept as rows. Columns other
    than the two named are ignored; an empty table gives no rows.
    """
    repeated = cut(_counts(docs, id_col, text_col).where("copies > 1").select("h1", "h2", "copies"))
    rows = _shared_rows(docs, id_col, text_col, repeated)
    field = rows.schema["row_id"].dataType
    return rows.mapInArrow(_confirm(to_arrow_type(field)), f"row_id {field.simpleString()}, norm_text string")


def collapsed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct record: ``(first_id, copies)``; ``first_id`` is the smallest id of the group.

    Records on one row count by their key alone; those of repeated keys are compared first.
    """
    keys = cut(_counts(docs, id_col, text_col))
    rows = _shared_rows(docs, id_col, text_col, keys.where("copies > 1").select("h1", "h2", "copies"))
    field = rows.schema["row_id"].dataType
    kinds = rows.mapInArrow(_tally(to_arrow_type(field)), f"h1 long, h2 long, digest string, first_id {field.simpleString()}, copies long")
    several = kinds.groupBy("h1", "h2", "digest").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))
    return keys.where("copies = 1").select("first_id", "copies").unionByName(several.select("first_id", "copies"))
