"""Problem 7: the main body of pages whose text mixes it with menus, notices, sidebars and footers.

The markup is gone, so a *tag path* is read off each line: its shape (marker, length, capitals, separators, numbers,
stops), its first words and its last one, numbers and names masked. The path is the line's leaf-most node that recurs
in the corpus: the whole path, else its shape with the first two words, else with the last one, else the shape alone.

1. ``path_counts`` counts the nodes and words of all texts; those on a ``SHARE`` of the lines stay, at most
   ``3 / SHARE`` nodes (and as many words as lines are long) whatever the corpus.
2. ``path_sums`` aggregates per node the text length, punctuation and link-like marks of its lines, which nodes stand
   before and after it, and its words.
3. ``content_scores`` turns the sums into ratios (``_ratio``: length against the typical line without a stop,
   punctuation, separators and capitals as links have them, a bounded share of words that furniture is made of),
   smooths them over the nodes that are neighbours in the pages, and fuses them with how content-like a node's words
   are in the other nodes. No ratio exceeds ``CAP`` either way and no node carries a prior.
4. Each page's lines take the better of two states, content and furniture, in one chain (Viterbi), whose cost of a
   change smooths over the page.

Lines are read on flat code-point arrays, a batch at a time; each step is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .textcodes import codes_of, lower_table, mix, run_hashes, runs, word_char_table, word_hashes

# fixed values: words that page furniture is made of; their share of a line is one of the ratios, bounded by ``WORDING``
WORDS = """cookie cookies privacy tracking device accept reject settings agree manage essential continue
copyright rights reserved licence license imprint terms disclaimer accessibility sitemap rss hosted powered
login log logout sign register account subscribe newsletter bulletin updates mail email follow share tweet print comments comment feedback rate useful colleague
menu navigation skip jump search home contact site website page online browser script scripts javascript loading
advertisement ad sponsored promoted popular related recommended trending read viewed also version reviewed updated modified
startseite kontakt impressum datenschutz suche anmelden hilfe accueil contacts recherche connexion aide mentions inicio buscar contacto aviso privacidad ayuda"""

SHARE = 2e-5  # of all lines, from which a node or word is kept
LEAST = 3  # lines, likewise
EDGE_SHARE = 5e-6  # of all lines, from which two nodes are neighbours of their own; a rarer one counts as the mean line of its shape
CAP, WORDING = 4.0, 3.0  # bounds of a ratio and of its wording part
OFFSET = 0.4  # what a line of typical length and no other sign lacks for content
DOUBT = 2.0  # occurrences of a word that count as undecided
OWN_WORDS = 1.5  # weight of the words' evidence, itself within 2
STAY = 0.85  # chance that a line is of its neighbour's kind, in the smoothing over paths
KEEP = 0.75  # the same within a page
OWN = 0.3  # weight of a node's own score beside the smoothed one
BEFORE, AFTER = 0.8, 1.1  # weight of the lines before and after in the smoothing over paths: a heading goes with what it opens
EDGES = (-0.5, -2.0)  # scores of a page's begin and end
ROUNDS, STEPS = 3, 20
LONG, SPAN = 110, 220  # characters from which a path has no last word, and none at all

_FIELDS = ("lines", "chars", "stops", "wording", "words", "separators", "capitals", "numbers", "broken", "arrows", "colons", "columns", "log_chars", "open")
_NUMBER, _NAME = np.uint64(1), np.uint64(2)
_BEGIN, _END = np.uint64(11), np.uint64(13)  # nodes of a page's edges
_COUNT, _WORD_COUNT, _EDGE, _WORD, _RARE, _STAT = 0, 1, 2, 4, 6, 10
_BINS = np.array([12, 25, 45, 75, LONG, SPAN])


_SPACE, _UPPER, _DIGIT, _MARKER, _SEPARATOR, _ARROW, _STOP, _CLOSER, _WIDE, _JOINT, _ENDING, _WORD_CHAR = (1 << k for k in range(12))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """What each code point is, as bits."""
    table = np.zeros(0x110000, np.uint16)
    for bit, chars in ((_MARKER, "-*•·>▪‣"), (_SEPARATOR, "|•·/»›>*"), (_ARROW, "›»>"), (_STOP, ".!?;。！？؟…"), (_CLOSER, "\"'”’»)]"), (_WIDE, "。！？"), (_JOINT, ".,/–-"), (_ENDING, ".!?:;。！？؟…")):
        table[list(map(ord, chars))] |= bit
    for i, c in enumerate(map(chr, range(0x110000))):
        if c.isspace():
            table[i] |= _SPACE
        elif c.isdigit():
            table[i] |= _DIGIT
        elif c.isupper() or c.istitle():
            table[i] |= _UPPER
    table[word_char_table()] |= _WORD_CHAR
    return table


@lru_cache(maxsize=1)
def _wording() -> pa.Array:
    return pa.array(word_hashes([WORDS])[0])


@dataclass
class Lines:
    """The non-blank lines of a batch."""

    text: np.ndarray  # index of the text
    number: np.ndarray  # line number, from 0
    levels: np.ndarray  # [line, 4]: keys of the path's nodes, leaf first; 0 where a level is absent
    stats: np.ndarray  # [line, field]
    word: np.ndarray  # its words, in order
    word_line: np.ndarray


def read_lines(texts: list[str]) -> Lines:
    """The lines of the texts with their paths and figures."""
    codes = codes_of("\n".join(texts) + "\n")
    kind = _classes()[codes]
    is_ = lambda bit, at: (kind[np.minimum(at, len(kind) - 1)] & bit) != 0
    breaks = np.flatnonzero(codes == 10)
    per_text = np.fromiter((x.count("\n") + 1 for x in texts), np.int64, len(texts))
    solid = np.flatnonzero((kind & _SPACE) == 0)
    cuts = np.concatenate(([0], np.searchsorted(solid, breaks)))
    used = np.flatnonzero(np.diff(cuts))
    n = len(used)
    text = np.repeat(np.arange(len(texts)), per_text)[used]
    number = used - np.concatenate(([0], np.cumsum(per_text)[:-1]))[text]
    if not n:
        return Lines(text, number, np.zeros((0, 4), np.uint64), np.zeros((0, len(_FIELDS))), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    begin, last = solid[cuts[used]], solid[cuts[used + 1] - 1]
    # a list marker: a sign and white space, or one or two digits, a dot or bracket and white space
    sign = is_(_MARKER, begin) & is_(_SPACE, begin + 1)
    closes = lambda k: np.isin(codes[np.minimum(begin + k, len(codes) - 1)], (46, 41)) & is_(_SPACE, begin + k + 1)
    one = is_(_DIGIT, begin) & closes(1)
    two = is_(_DIGIT, begin) & is_(_DIGIT, begin + 1) & closes(2)
    after = begin + np.where(sign, 1, np.where(one, 2, np.where(two, 3, 0)))
    marked = (after > begin) & (last > after)
    start = np.where(marked, solid[np.minimum(np.searchsorted(solid, after), len(solid) - 1)], begin)
    size = last - start + 1

    def rows_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines of ascending places, and which of the places lie in the body of one."""
        row = np.repeat(np.arange(n), np.diff(np.searchsorted(at, np.append(begin[1:], len(codes))), prepend=0))
        return row, at >= start[row]

    def tally(flags: np.ndarray) -> np.ndarray:
        row, inside = rows_of(np.flatnonzero(flags))
        return np.bincount(row[inside], minlength=n)

    follows, leads = np.append(kind[1:], np.uint16(_SPACE)), np.append(np.uint16(_SPACE), kind[:-1])
    separator = (kind & _SEPARATOR) != 0
    stop = ((kind & _STOP) != 0) & (((follows & (_SPACE | _CLOSER)) != 0) | ((kind & _WIDE) != 0))
    cells = tally((codes == 124) & ((follows & leads & _SPACE) != 0) | (codes == 9))
    same = np.zeros(n, bool)  # as many cells as a neighbour has: a row of a table
    alike = (cells[1:] == cells[:-1]) & (text[1:] == text[:-1])
    same[1:] |= alike
    same[:-1] |= alike
    column = same & (cells > 1)
    # words
    w_start, w_end = runs((kind & _WORD_CHAR) != 0)
    row, inside = rows_of(w_start)
    w_start, w_end, row = w_start[inside], w_end[inside], row[inside]
    digit = is_(_DIGIT, w_start)
    joined = np.zeros(len(row), bool)  # parts of one number
    joined[1:] = digit[1:] & digit[:-1] & (row[1:] == row[:-1]) & (w_start[1:] == w_end[:-1] + 1) & is_(_JOINT, w_end[:-1])
    w_start, w_end, row, digit = w_start[~joined], w_end[~joined], row[~joined], digit[~joined]
    capital = is_(_UPPER, w_start)
    plain = run_hashes(lower_table()[codes], w_start, w_end)
    words = np.bincount(row, minlength=n)
    at = np.cumsum(words) - words  # first word of each line
    leading = np.zeros(len(row), bool)
    leading[at[words > 0]] = True
    masked = np.where(digit, _NUMBER, np.where(capital & ~leading, _NAME, plain))
    known = compute.is_in(pa.array(plain), value_set=_wording()).to_numpy(zero_copy_only=False)
    wording = np.bincount(row[known], minlength=n) + tally(codes == 0xA9)
    capitals, numbers = np.bincount(row[capital], minlength=n), np.bincount(row[digit], minlength=n)
    separators, arrows, stops = tally(separator), tally(separator & ((kind & _ARROW) != 0)), tally(stop)
    end, colon = is_(_ENDING, last), codes[last] == 58
    # shape and path
    length = np.searchsorted(_BINS, size, side="right")
    share = wording / np.maximum(words, 1)
    shape = np.zeros(n, np.uint64)
    for part in (
        np.where(column, 2, marked), length, (3 * capitals / np.maximum(words, 1)).astype(int), np.minimum(separators, 2), numbers > 0, np.minimum(stops, 2), end,
        np.where(wording == 0, 0, np.where(share < 0.12, 1, np.where(share < 0.34, 2, 3))),
    ):
        shape = mix(shape + part.astype(np.uint64) + np.uint64(97))
    word_at = lambda k: np.where(words > k, masked[np.minimum(at + k, len(masked) - 1)], np.uint64(0)) if len(masked) else np.zeros(n, np.uint64)
    final = word_at(np.maximum(words - 1, 0))
    two_words = mix(mix(shape + np.uint64(3)) + mix(word_at(0) + np.uint64(5)) * np.uint64(3) + word_at(1))
    levels = np.zeros((n, 4), np.uint64)
    levels[:, 3] = shape
    short, middle = length < 5, length < 6
    levels[short, 0] = mix(two_words + mix(word_at(2) + np.uint64(7)) * np.uint64(5) + mix(final + np.uint64(9)))[short]
    levels[middle, 1] = two_words[middle]
    levels[short, 2] = mix(mix(shape + np.uint64(15)) + mix(final + np.uint64(17)))[short]
    open_ = ~end
    stats = np.stack(
        [np.ones(n), size, stops, wording, words, separators, capitals, numbers, (stops > 0) & open_, arrows, colon, column, np.where(open_, np.log(size), 0), open_], axis=1
    ).astype(np.float64)
    return Lines(text, number, levels, stats, plain, row)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return compute.is_in(pa.array(x), value_set=pa.array(known)).to_numpy(zero_copy_only=False)


def _places(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``x`` stands in ``known``, and whether it does."""
    at = compute.index_in(pa.array(x), value_set=pa.array(known))
    return compute.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64), at.is_valid().to_numpy(zero_copy_only=False)


def _rows(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind, np.int32)), *(pa.array(x.view(np.int64)) for x in (a, b, c)), pa.array(n.astype(np.float64))], names=["kind", "a", "b", "c", "n"]
    )


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = compute.value_counts(pa.array(x))
    return counts.field("values").to_numpy(zero_copy_only=False), counts.field("counts").to_numpy(zero_copy_only=False)


_SUMS = "kind int, a long, b long, c long, n double"
SLICE = 4096


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            part = batch.slice(lo, SLICE)
            yield part, part.column(column).to_pylist()


def _count_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in _slices(batches, 0):
        lines = read_lines(texts)
        key, n = _counted(lines.levels[:, :3][lines.levels[:, :3] != 0])
        zero = np.zeros(len(key), np.uint64)
        yield _rows(_COUNT, key, zero, zero, n)
        key, n = _counted(lines.word)
        zero = np.zeros(len(key), np.uint64)
        yield _rows(_WORD_COUNT, key, zero, zero, n)
        none = np.zeros(3, np.uint64)
        total = lines.stats[:, [0, 12, 13]].sum(axis=0)
        yield _rows(_STAT, np.arange(3, dtype=np.uint64), none, none, total)


@dataclass
class Vocabulary:
    """What recurs: sorted keys of nodes and words, and the corpus's number of lines and typical length of an open line."""

    nodes: np.ndarray
    words: np.ndarray
    lines: float
    typical: float


def path_counts(docs: DataFrame, text_col: str) -> Vocabulary:
    """The nodes and words on a ``SHARE`` of all lines (and at least ``LEAST``); the share bounds their number."""
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    sums = texts.mapInArrow(_count_paths, _SUMS).groupBy("kind", "a").agg(F.sum("n").alias("n"))
    sums = cut(sums.where((F.col("kind") == _STAT) | (F.col("n") >= LEAST)))
    stat = {r["a"]: r["n"] for r in sums.where(F.col("kind") == _STAT).collect()}
    lines, logs, opened = (stat.get(i, 0.0) for i in range(3))
    kept = sums.where((F.col("kind") != _STAT) & (F.col("n") >= SHARE * lines)).select("kind", "a").toArrow()
    kind, key = kept.column("kind").to_numpy(), kept.column("a").to_numpy().view(np.uint64)
    return Vocabulary(np.sort(key[kind == _COUNT]), np.sort(key[kind == _WORD_COUNT]), lines, float(np.exp(logs / opened)) if opened else 24.0)


def _resolved(lines: Lines, nodes: np.ndarray) -> np.ndarray:
    """The node of each line: the most specific of its levels that recurs, else its shape."""
    out = lines.levels[:, 3].copy()
    for level in (2, 1, 0):
        known = _among(lines.levels[:, level], nodes)
        out[known] = lines.levels[known, level]
    return out


def _grouped(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """The triples with their numbers; ``c`` depends on ``b``."""
    key = mix(mix(a) + b)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return _rows(kind, a[first], b[first], c[first], n)


def _sum_paths(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value
        for _, texts in _slices(batches, 0):
            lines = read_lines(texts)
            if not len(lines.text):
                continue
            node, shape = _resolved(lines, vocabulary.nodes), lines.levels[:, 3]
            head = np.concatenate(([True], lines.text[1:] != lines.text[:-1]))
            tail = np.concatenate((head[1:], [True]))
            before, after = np.where(head, _BEGIN, np.roll(node, 1)), np.where(tail, _END, np.roll(node, -1))
            yield _grouped(_EDGE, node, before, np.where(head, _BEGIN, np.roll(shape, 1)))
            yield _grouped(_EDGE + 1, node, after, np.where(tail, _END, np.roll(shape, -1)))
            key, first, of = np.unique(node, return_index=True, return_inverse=True)
            word, known = _places(lines.word, vocabulary.words)
            pair, n = _counted(of[lines.word_line[known]] * len(vocabulary.words) + word[known])
            at, word = np.divmod(pair, max(len(vocabulary.words), 1))
            yield _rows(_WORD, key[at], vocabulary.words[word], np.zeros(len(pair), np.uint64), n)
            for k in range(len(_FIELDS)):
                total = np.bincount(of, weights=lines.stats[:, k])
                used = np.flatnonzero(total)  # what isn't given is 0
                yield _rows(_STAT + k, key[used], shape[first[used]], np.zeros(len(used), np.uint64), total[used])

    return run


@dataclass
class Sums:
    """The corpus seen through its paths."""

    node: np.ndarray  # sorted
    stats: np.ndarray  # [node, field]
    shape: np.ndarray  # of each node, from 0
    edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # before and after: node, neighbour, number
    rare: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # likewise, with the shape of the neighbour
    words: tuple[np.ndarray, np.ndarray, np.ndarray]  # node, word, number


def path_sums(docs: DataFrame, text_col: str, vocabulary: Vocabulary) -> Sums:
    """Figures, neighbours and words of every node, summed over all texts.

    Neighbours that meet in fewer than ``EDGE_SHARE`` of the lines are summed under the neighbour's shape, apart from
    those that are the shape itself, and words below ``SHARE`` with a node are left to the other nodes, so that what
    reaches the driver is bounded by the shares.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by SHARE
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    sums = texts.mapInArrow(_sum_paths(shared), _SUMS).groupBy("kind", "a", "b").agg(F.first("c").alias("c"), F.sum("n").alias("n"))
    edge = F.col("kind").isin(_EDGE, _EDGE + 1)
    least = F.when(F.col("kind") == _WORD, SHARE * vocabulary.lines).otherwise(0.0)
    rare = edge & (F.col("n") < EDGE_SHARE * vocabulary.lines)
    sums = sums.where(F.col("n") >= least).select(
        F.when(rare, F.col("kind") + (_RARE - _EDGE)).otherwise(F.col("kind")).alias("kind"), "a", F.when(rare, F.col("c")).otherwise(F.col("b")).alias("b"), "n"
    )
    got = sums.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).toArrow()
    kind, n = got.column("kind").to_numpy(), got.column("n").to_numpy()
    a, b = (got.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
    own = kind == _STAT  # every node that has lines, with its shape
    node = np.unique(np.concatenate((a[own], [_BEGIN, _END])))
    shapes = np.unique(np.concatenate((b[own], [_BEGIN, _END])))
    shape = np.zeros(len(node), np.int64)
    shape[np.searchsorted(node, [_BEGIN, _END])] = np.searchsorted(shapes, [_BEGIN, _END])
    shape[np.searchsorted(node, a[own])] = np.searchsorted(shapes, b[own])
    stats = np.zeros((len(node), len(_FIELDS)))
    for k in range(len(_FIELDS)):
        own = kind == _STAT + k
        stats[np.searchsorted(node, a[own]), k] = n[own]
    pairs = [(np.searchsorted(node, a[kind == e]), np.searchsorted(node if e < _RARE else shapes, b[kind == e]), n[kind == e]) for e in (_EDGE, _EDGE + 1, _RARE, _RARE + 1)]
    own = kind == _WORD
    return Sums(node, stats, shape, pairs[:2], pairs[2:], (np.searchsorted(node, a[own]), b[own], n[own]))


def _ratio(stats: np.ndarray, typical: float) -> np.ndarray:
    """Content score of lines or nodes from their figures alone, within ``CAP``; above 0 is content."""
    lines, chars, stops, wording, words, separators, capitals, numbers, broken, arrows, colons, columns = np.maximum(stats[:, :12], 0).T
    lines, words = np.maximum(lines, 1), np.maximum(words, 1)
    score = np.clip(np.log2(np.maximum(chars / lines, 1) / typical), -2, 3) + np.minimum(stops / lines, 2)
    score += 0.5 * np.minimum(numbers / lines, 2) + colons / lines + 3 * columns / lines
    score -= 0.7 * np.minimum(separators / lines, 3) * (numbers == 0) * (columns == 0) + np.minimum(arrows / lines, 2)
    score -= 1.5 * np.clip(capitals / words - 0.4, 0, 0.6) * (numbers / lines < 0.5) + 1.5 * broken / lines
    score -= WORDING * np.clip(2 * wording / words + 0.2 * np.minimum(wording / lines, 2) * np.minimum(10 * lines / words, 1), 0, 1)
    return np.clip(score - OFFSET, -CAP, CAP)


def _message(score: np.ndarray) -> np.ndarray:
    """What a neighbour's score says of a line."""
    e = np.exp(np.clip(score, -20, 20))
    return np.log((STAY * e + 1 - STAY) / ((1 - STAY) * e + STAY))


@dataclass
class Scores:
    """The fitted scores: of nodes and of words, sorted by key."""

    node: np.ndarray
    score: np.ndarray
    word: np.ndarray
    evidence: np.ndarray
    typical: float

    def of(self, lines: Lines) -> np.ndarray:
        node = _resolved(lines, self.node)
        at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        own = _fused(_ratio(lines.stats, self.typical), _mean_evidence(lines.word_line, lines.word, self, len(node)))
        # a line known by its shape only has its own figures and words
        return np.where((self.node[at] == node) & (node != lines.levels[:, 3]), self.score[at], own)


def _fused(ratio: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    return np.clip(ratio + OWN_WORDS * np.clip(evidence, -2, 2), -CAP - 2, CAP + 2)


def _mean_evidence(line: np.ndarray, word: np.ndarray, scores: Scores, lines: int) -> np.ndarray:
    if not len(scores.word) or not len(word):
        return np.zeros(lines)
    at, known = _places(word, scores.word)
    value = np.where(known, scores.evidence[at], 0.0)
    return np.bincount(line, weights=value, minlength=lines) / np.maximum(np.bincount(line, minlength=lines), 1)


def content_scores(sums: Sums, typical: float) -> Scores:
    """Ratios of the nodes, smoothed over neighbouring nodes and fused with their words' evidence."""
    n = len(sums.node)
    ratio = _ratio(sums.stats, typical)
    edge = np.searchsorted(sums.node, np.array([_BEGIN, _END], np.uint64))
    totals = [np.maximum(sum(np.bincount(a, weights=k, minlength=n) for a, _, k in both), 1) for both in zip(sums.edges, sums.rare)]
    lines = np.maximum(sums.stats[:, 0], 1e-9)  # the edges have none
    of_shape = np.bincount(sums.shape, weights=lines)
    at, word, times = sums.words
    key, of = np.unique(word, return_inverse=True)
    all_times = np.maximum(np.bincount(at, weights=times, minlength=n), 1)

    def smoothed(own: np.ndarray) -> np.ndarray:
        score = own.copy()
        for _ in range(STEPS):
            score[edge] = EDGES
            m = _message(score)
            mean = np.bincount(sums.shape, weights=lines * m) / of_shape
            around = np.zeros(n)
            for weight, (a, b, k), (c, d, j), total in zip((BEFORE, AFTER), sums.edges, sums.rare, totals):
                around += weight * (np.bincount(a, weights=k * m[b], minlength=n) + np.bincount(c, weights=j * mean[d], minlength=n)) / total
            score = 0.5 * score + 0.5 * (own + around)
        score[edge] = EDGES
        return score

    def weighed(content: np.ndarray, rest: np.ndarray, share: float) -> np.ndarray:
        """Log-odds of words for content against those of all words; 0 for a word not seen."""
        return np.clip(np.log((content + DOUBT * share) / (rest + DOUBT * (1 - share))) - np.log(share / (1 - share)), -3, 3)

    score, own, evidence = 2 * ratio, ratio, np.zeros(len(key))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        c, r = times * p[at], times * (1 - p[at])
        content, rest = np.bincount(of, weights=c, minlength=len(key)), np.bincount(of, weights=r, minlength=len(key))
        share = (content.sum() + 1) / (content.sum() + rest.sum() + 2)
        evidence = weighed(content, rest, share)
        others = weighed(np.maximum(content[of] - c, 0), np.maximum(rest[of] - r, 0), share)  # a node is judged by the other nodes
        own = _fused(ratio, np.bincount(at, weights=times * others, minlength=n) / all_times)
        score = smoothed(own)
    return Scores(sums.node, OWN * own + (1 - OWN) * score, key, evidence, typical)


def _two_states(score: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each line is furniture: the best sequence of two states in each text, all texts at once."""
    if not len(score):
        return np.zeros(0, bool)
    head = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    count = np.diff(np.concatenate((head, [len(text)])))
    stay, move = np.log(KEEP), np.log(1 - KEEP)
    order = np.argsort(-count, kind="stable")  # texts by length: the first ``live`` have a k-th line
    head, count = head[order], count[order]
    longest = int(count[0])
    live = np.searchsorted(-count, -np.arange(longest), side="left")
    back = np.zeros((len(score), 2), bool)  # whether the best way into furniture, content comes from content
    best = np.stack([np.zeros(len(head)), score[head]], axis=1)
    for k in range(1, longest):
        m = live[k]
        f, c = best[:m, 0], best[:m, 1]
        at = head[:m] + k
        back[at, 0], back[at, 1] = c + move > f + stay, c + stay > f + move
        best[:m] = np.stack([np.maximum(f + stay, c + move), np.maximum(f + move, c + stay) + score[at]], axis=1)
    state = best[:, 1] > best[:, 0]
    content = np.zeros(len(score), bool)
    for k in range(longest - 1, -1, -1):
        m = live[k] if k else len(head)
        at = head[:m] + k
        content[at] = state[:m]
        state[:m] = np.where(state[:m], back[at, 1], back[at, 0])
    return ~content


def _label(shared, form: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores: Scores = shared.value
        for part, raw in _slices(batches, 1):
            texts = [x or "" for x in raw]
            lines = read_lines(texts)
            gone = _two_states(scores.of(lines), lines.text)
            who, line = lines.text[gone], lines.number[gone]
            if form == "lines":
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), pa.array(line.astype(np.int32))], names=["id", "what"])
                continue
            cuts = np.searchsorted(who, np.arange(len(texts) + 1))
            what: list[str | None] = []
            for d, text in enumerate(raw):
                drop = set(line[cuts[d] : cuts[d + 1]].tolist())
                what.append(text if not drop else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(what, pa.string())], names=["id", "what"])

    return run


def fitted_scores(docs: DataFrame, text_col: str) -> Scores:
    """The scores of the paths of ``docs``, from all its texts."""
    vocabulary = path_counts(docs, text_col)
    return content_scores(path_sums(docs, text_col, vocabulary), vocabulary.typical)


def _run(docs: DataFrame, id_col: str, text_col: str, form: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(fitted_scores(docs, text_col))  # bounded by SHARE
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_label(shared, form), f"id {kind}, what {'int' if form == 'lines' else 'string'}").withColumnRenamed("id", id_col)


def furniture_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(<id>, line_no)`` of every non-blank line that is page furniture; lines count from 0.

    Null, empty and blank texts give no rows, nor does an empty table. Repeated ids are kept as rows. Columns other
    than the two named are not read. A text of one line is judged by that line alone.
    """
    return _run(docs, id_col, text_col, "lines").withColumnRenamed("what", "line_no")


def main_body(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(<id>, <text>)`` of every row with the furniture lines taken out; a null text stays null, an empty one empty."""
    return _run(docs, id_col, text_col, "body").withColumnRenamed("what", text_col)
