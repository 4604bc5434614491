"""Problem 10: the language of documents and of their segments.

Per language an interpolated Kneser-Ney character model of order ``ORDER`` over words (the context reaches back to the
word's start). All models share one sorted array of n-gram hashes per order, with one row of discounted probabilities
(one column per language) beside each hash, and another such array for the back-off weights of the contexts. A batch's
distinct words are scored at once by binary search; each worker remembers scored words up to a bound. A segment (a
sentence or line) takes the language of the lowest cross-entropy per character; neighbours in one document are tied by
a cost for changing language, and a segment whose best cross-entropy lies above what the training sentences of that
language reach is rejected (no language).

The models are fitted on a bounded sample: at most ``SAMPLE`` labelled documents per language, those of the lowest hashes,
and at most ``SAMPLE_SENTENCES`` sentences of each, likewise. A threshold on the hash, set from a count per language, is
applied where the table is read, so nothing is sorted or shuffled and about ``OVERDRAWN`` times the sample reaches the
driver whatever the number of tasks. Labels are partly wrong and texts partly mixed, so the sample's sentences are
reassigned to their best language and the models fitted again, ``ROUNDS`` times.

One departure from Kneser-Ney: n-grams at a word's start have no character before them whose continuations could be
counted, so the square root of their frequency is added to their continuation count.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcodes import mix

ORDER = 5
SAMPLE = 120  # labelled documents per language
SAMPLE_SENTENCES = 80  # sentences of each that are used for fitting
SAMPLE_LENGTH = 1000  # code points up to which a sentence is used for fitting
OVERDRAWN = 2.0  # times the sample that pass the threshold on the hash
ROUNDS = 3
REMEMBERED = 200_000
SWITCH = 3.0  # nats that a change of language costs
ALPHABET = 2000.0  # size of the uniform floor
SURE = 12  # letters a segment needs to be used for fitting
SHORT = 20.0  # nats by which a segment may exceed the limit of rejection, whatever its length

_SEGMENT = regex.compile(r"[^\n.!?。！？؟۔]*(?:(?:[.!?؟۔]+(?!\s|$)|[.!?؟۔]+[\"'”’»)\]]+(?!\s|$))[^\n.!?。！？؟۔]*)*(?:[.!?؟۔]+[\"'”’»)\]]*\s*|[。！？]+[」』）]*\s*|\n+|$)")
# scripts without spaces: short runs of one script stand for words
_WORD = regex.compile(r"[\p{Hiragana}]{1,5}|[\p{Katakana}ー]{1,8}|\p{Han}{1,3}|(?:(?![\p{Hiragana}\p{Katakana}\p{Han}ー])[\p{L}\p{M}])+(?:['’][\p{L}\p{M}]+)*")
# the same for texts below U+0300, where there are no combining marks and other scripts
_LATIN_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
# fixed values: format characters, which split no word
_FORMAT = re.compile("[\u00ad\u0600-\u0605\u061c\u06dd\u070f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb]+")
_LETTER = re.compile(r"[^\W\d_]")
_NOISE = regex.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\S+")


def segments(text: str) -> list[tuple[int, int]]:
    """Half-open ranges of the text's sentences and lines; together they cover it."""
    return [m.span() for m in _SEGMENT.finditer(text) if m.end() > m.start()]


def words_of(text: str) -> list[str]:
    """Comparable words: compatibility forms, no format characters, lower case, addresses left out."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _FORMAT.sub("", text))
    if "://" in text or "www." in text or "@" in text:
        text = _NOISE.sub(" ", text)
    low = text.lower()
    return (_LATIN_WORD if low.isascii() or max(low) < "\u0300" else _WORD).findall(low)


def unaccented(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes ``[order, position]`` of the n-grams ending at each predicted character of ' word ', the same for their
    contexts, the order available at each position and the word of each position."""
    joined = "".join(f" {w} " for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    of = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(codes)) - start[of]
    one = mix(codes + np.uint64(0x51ED270B))
    gram = np.zeros((ORDER + 1, len(codes)), np.uint64)
    for n in range(1, ORDER + 1):
        if n == 1:
            gram[1] = one
        else:  # hash of the last n characters from that of the n-1 before and the last
            gram[n, n - 1 :] = mix(gram[n - 1, n - 2 : -1] * np.uint64(0x9E3779B97F4A7C15) + one[n - 1 :] + np.uint64(n))
    context = np.zeros_like(gram)
    context[2:, 1:] = gram[1:-1, :-1]
    keep = place > 0
    return gram[:, keep], context[:, keep], np.minimum(place[keep] + 1, ORDER), of[keep]


class Models:
    """The fitted models of ``names``."""

    def __init__(self, names: list[str], tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], limits: np.ndarray):
        self.names, self.tables, self.limits = names, tables, limits

    def score(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word under each language."""
        out = np.zeros((len(words), len(self.names)))
        for lo in range(0, len(words), 4096):
            part = words[lo : lo + 4096]
            gram, context, order, of = _grams(part)
            p = np.full((gram.shape[1], len(self.names)), 1 / ALPHABET)
            for n in range(1, ORDER + 1):
                keys, alpha, heads, weight = self.tables[n]
                at = np.flatnonzero(order >= n)
                if n == 1:
                    p *= weight[0]
                elif len(heads):
                    i = np.minimum(np.searchsorted(heads, context[n, at]), len(heads) - 1)
                    hit = heads[i] == context[n, at]
                    p[at[hit]] *= weight[i[hit]]
                if len(keys):
                    i = np.minimum(np.searchsorted(keys, gram[n, at]), len(keys) - 1)
                    hit = keys[i] == gram[n, at]
                    p[at[hit]] += alpha[i[hit]]
            np.add.at(out, of + lo, np.log(p))
        return out


def _fit(bags: list[dict[str, int]], names: list[str]) -> Models:
    """Models from one bag of words per language."""
    per: list[list[tuple]] = [[] for _ in range(ORDER + 1)]
    for bag in bags:
        words = list(bag)
        if not words:
            for n in range(1, ORDER + 1):
                per[n].append((np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0)))
            continue
        times = np.fromiter(bag.values(), float, len(words))
        gram, context, order, of = _grams(words)
        count = times[of]
        for n in range(1, ORDER + 1):
            at = order >= n
            g, h = gram[n, at], context[n, at]
            if n == ORDER:
                keys, first, back = np.unique(g, return_index=True, return_inverse=True)
                c = np.bincount(back, weights=count[at])
            else:
                # continuation counts; n-grams from the word's start have nothing before them and add the root of their counts
                whole = order[at] == n
                longer = gram[n + 1, at]
                key = np.where(whole, mix(g + np.uint64(1)), longer)
                _, once = np.unique(key, return_index=True)
                keys, first, back = np.unique(g, return_index=True, return_inverse=True)
                c = np.bincount(back[once], minlength=len(keys)).astype(float)
                c += np.where(np.bincount(back, weights=whole) > 0, np.bincount(back, weights=count[at] * whole) ** 0.5, 0)
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5
            head, where = np.unique(h[first], return_inverse=True)
            total = np.bincount(where, weights=c)
            alpha = np.maximum(c - d, 0) / total[where]
            weight = np.bincount(where, weights=np.minimum(c, d)) / total
            per[n].append((keys, alpha, head, weight))
    tables: list[tuple] = [()]
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([t[0] for t in per[n]]))
        heads = np.unique(np.concatenate([t[2] for t in per[n]]))
        alpha = np.zeros((len(keys), len(names)), np.float32)
        weight = np.ones((max(len(heads), 1), len(names)), np.float32)
        for k, (own, a, head, w) in enumerate(per[n]):
            alpha[np.searchsorted(keys, own), k] = a
            weight[np.searchsorted(heads, head), k] = w
        tables.append((keys, alpha, heads, weight))
    return Models(names, tables, np.full(len(names), np.inf))


def _purge(bags: list[dict[str, int]]) -> None:
    """Takes out of each bag the words that are over ten times as frequent in another language."""
    size = [max(sum(bag.values()), 1) for bag in bags]
    most: dict[str, float] = defaultdict(float)
    for bag, n in zip(bags, size):
        for w, k in bag.items():
            most[w] = max(most[w], k / n)
    for bag, n in zip(bags, size):
        for w in [w for w, k in bag.items() if k / n < 0.1 * most[w]]:
            del bag[w]


def fit(samples: list[tuple[str, str]]) -> Models:
    """Models from ``(language, text)`` pairs, some of them mislabelled or mixed."""
    names = sorted({lang for lang, _ in samples})
    at = {name: k for k, name in enumerate(names)}
    sentences: list[tuple[int, list[str]]] = []
    for lang, text in samples:
        for lo, hi in segments(text):
            words = words_of(text[lo:hi])
            if sum(map(len, words)) >= SURE:
                sentences.append((at[lang], words))
    label = np.array([k for k, _ in sentences], np.int64)
    models = Models(names, [], np.full(len(names), np.inf))
    if not sentences:
        return Models([], [], np.zeros(0))
    for round_ in range(ROUNDS):
        bags: list[dict[str, int]] = [defaultdict(int) for _ in names]
        for k, (_, words) in zip(label, sentences):
            if k >= 0:
                for w in words:
                    bags[k][w] += 1
        if round_:
            _purge(bags)
        for bag in bags:
            for w, n in list(bag.items()):
                if not w.isascii() and (bare := unaccented(w)) != w:
                    bag[bare] += max(n // 4, 1)
        models = _fit(bags, names)
        index: dict[str, int] = {}
        flat = [index.setdefault(w, len(index)) for _, words in sentences for w in words]
        scores = models.score(list(index))
        chars = np.fromiter((len(w) + 1 for w in index), float, len(index))
        start = np.concatenate(([0], np.cumsum([len(w) for _, w in sentences])[:-1])).astype(int)
        total = np.add.reduceat(scores[flat], start)
        length = np.add.reduceat(chars[flat], start)
        label = total.argmax(axis=1)
        entropy = -total[np.arange(len(label)), label] / length
        if round_ + 1 < ROUNDS:
            label = np.where(entropy <= np.median(entropy) + 2.0, label, -1)
        for k in range(len(names)):
            own = entropy[label == k]
            # calibrated rejection: well above all but the oddest sentences of the language itself
            models.limits[k] = np.quantile(own, 0.995) + 0.75 if len(own) >= 20 else np.inf
    return models


class Detector:
    """Scores batches of texts; remembers words up to a bound."""

    def __init__(self, models: Models):
        self.models = models
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(models.names)), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        index = self.index
        if len(index) > REMEMBERED:
            index.clear()
            self.scores = self.scores[:0]
        fresh = [w for w in dict.fromkeys(words) if w not in index]
        if fresh:
            base = len(index)
            index.update((w, base + i) for i, w in enumerate(fresh))
            self.scores = np.concatenate([self.scores, self.models.score(fresh).astype(np.float32)])
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def detect(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float, int]]]:
        """Of each text its segments ``(start, end, language or -1, confidence, letters)``; segments without words are left out."""
        spans, words, counts, doc = [], [], [], []
        for d, text in enumerate(texts):
            if not text:
                continue
            for lo, hi in segments(text):
                own = words_of(text[lo:hi])
                if own:
                    doc.append(d)
                    spans.append((lo, hi))
                    words += own
                    counts.append(len(own))
        out: list[list[tuple[int, int, int, float, int]]] = [[] for _ in texts]
        if not counts or not self.models.names:
            return out
        rows = self._rows(words)
        start = np.concatenate(([0], np.cumsum(counts)[:-1]))
        total = np.add.reduceat(self.scores[rows].astype(np.float64), start)
        length = np.add.reduceat(np.fromiter(map(len, words), np.int64, len(words)) + 1, start)
        best = total.argmax(axis=1)
        doc = np.array(doc)
        cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1 and (best[a:b] != best[a]).any():
                best[a:b] = _tied(total[a:b])
        at = np.arange(len(best))
        top = total[at, best]
        entropy = -top / length
        rest = total.copy()
        rest[at, best] = -np.inf
        gap = top - rest.max(axis=1) if total.shape[1] > 1 else np.full(len(best), 50.0)
        sure = 1 / (1 + np.exp(-np.clip(gap, -50, 50)))
        lang = np.where(entropy <= self.models.limits[best] + SHORT / length, best, -1)
        for i in range(len(best)):
            lo, hi = spans[i]
            letters = len(_LETTER.findall(texts[doc[i]], lo, hi))
            out[doc[i]].append((lo, hi, int(lang[i]), float(sure[i]), letters))
        return out


def _tied(total: np.ndarray) -> np.ndarray:
    """The best sequence of languages under a cost for each change."""
    score, back = total[0].copy(), np.zeros(total.shape, np.int64)
    for i in range(1, len(total)):
        j = int(score.argmax())
        stay = score >= score[j] - SWITCH
        back[i] = np.where(stay, np.arange(len(score)), j)
        score = np.where(stay, score, score[j] - SWITCH) + total[i]
    path = np.empty(len(total), np.int64)
    path[-1] = int(score.argmax())
    for i in range(len(total) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def named_language(docs: DataFrame, aliases: DataFrame, lang_col: str) -> DataFrame:
    """``docs`` with ``named``, the language its label names (null if none). ``aliases(lang, alias)`` is a small table."""
    names = aliases.select(F.lower(F.trim("alias")).alias("__alias"), F.col("lang").alias("named")).where("__alias IS NOT NULL").dropDuplicates(["__alias"])
    label = F.lower(F.regexp_replace(F.col(lang_col), r"(?U)^\s+|\s+$", ""))
    return docs.withColumn("__label", label).join(F.broadcast(names), F.col("__label") == F.col("__alias"), "left").drop("__label", "__alias")


HASHES = 1 << 40


def below(key: Column, share: Column | float) -> Column:
    """Whether a key's hash lies in the lowest ``share`` of all."""
    return F.pmod(F.xxhash64(key), F.lit(HASHES)) < F.ceil(F.lit(HASHES) * (share if isinstance(share, Column) else F.lit(float(share))))


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text in batch.column(3).to_pylist():
            own = [text[a:b] for a, b in segments(text) if b - a <= SAMPLE_LENGTH]
            if len(own) > SAMPLE_SENTENCES:
                keys = sorted((crc32(x.encode("utf-8", "surrogatepass")), i) for i, x in enumerate(own))[:SAMPLE_SENTENCES]
                own = [own[i] for i in sorted(i for _, i in keys)]
            texts.append("\n".join(own))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(texts, pa.string())], names=["named", "h", "id", "text"])


def fitted(docs: DataFrame, aliases: DataFrame, id_col: str, text_col: str, lang_col: str) -> Models:
    """Models fitted on the bounded sample of ``docs``; an empty table gives models of no language."""
    labels = named_language(docs.select(F.col(lang_col).alias("label")), aliases, "label").where("named IS NOT NULL")
    counts = {r["named"]: r["count"] for r in labels.groupBy("named").count().collect()}  # a row a language
    if not counts:
        return fit([])
    rows = named_language(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label")), aliases, "label")
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("named") == name, min(OVERDRAWN * SAMPLE / n, 1.0)).otherwise(share)
    drawn = rows.where(F.col("named").isNotNull() & below(F.col("id"), share) & (F.length("text") >= SURE))
    drawn = drawn.select("named", F.pmod(F.xxhash64("id"), F.lit(HASHES)).alias("h"), F.col("id").cast("string").alias("id"), "text")
    kept: dict[str, list] = defaultdict(list)
    for r in drawn.mapInArrow(_sentences, "named string, h long, id string, text string").collect():
        kept[r["named"]].append((r["h"], r["id"], r["text"]))
    return fit([(name, text) for name in sorted(kept) for _, _, text in sorted(kept[name])[:SAMPLE]])


def _detect(shared, form: str, least: float, skip: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(shared.value)
        names = shared.value.names
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = detector.detect(part.column(1).to_pylist())
                rows: list[tuple] = []
                named = part.column(2).to_pylist() if skip else None
                for d, own in enumerate(found):
                    if form == "segments":
                        rows += [(d, k, a, b, names[g] if g >= 0 else None, sure, n) for k, (a, b, g, sure, n) in enumerate(own)]
                        continue
                    letters = sum(s[4] for s in own)
                    if skip and letters < 2 * SURE and max((s[3] for s in own), default=0) < 0.95:
                        continue  # a scrap that could be any language
                    share: dict[int, float] = defaultdict(float)
                    trust: dict[int, float] = defaultdict(float)
                    for _, _, g, sure, n in own:
                        share[g] += n
                        trust[g] += n * sure
                    for g in sorted(share):
                        if g >= 0 and letters and share[g] >= least * letters and not (skip and named[d] == names[g]):
                            rows.append((d, names[g], share[g] / letters, trust[g] / share[g]))
                width = 7 if form == "segments" else 4
                cols = list(zip(*rows)) or [()] * width
                kinds = (
                    [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
                    if form == "segments" else [pa.string(), pa.float64(), pa.float64()]
                )
                labels = ["segment", "start", "stop", "lang", "confidence", "letters"] if form == "segments" else ["lang", "share", "confidence"]
                ids = part.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], names=["id", *labels])

    return run


def segment_languages(docs: DataFrame, models: Models, id_col: str, text_col: str) -> DataFrame:
    """``(<id>, segment, start, stop, lang, confidence, letters)`` of every segment with words; ``lang`` is null where rejected.

    ``start`` and ``stop`` count code points. Null, empty and wordless texts give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, segment int, start int, stop int, lang string, confidence double, letters int"
    return rows.mapInArrow(_detect(shared, "segments", 0.0), schema).withColumnRenamed("id", id_col)


def document_languages(docs: DataFrame, models: Models, id_col: str, text_col: str, *, least: float = 0.2, skip_col: str | None = None) -> DataFrame:
    """``(<id>, lang, share, confidence)``: the languages that hold at least ``least`` of a text's letters.

    Null, empty and wordless texts give no rows. With ``skip_col``, a language equal to the row's value in it is left
    out, and so is every text of fewer than ``2 * SURE`` letters without a segment of confidence 0.95: a scrap that
    could be any language doesn't contradict its label. Without it a scrap has its row, with its low confidence.
    """
    extra = [F.col(skip_col).alias("skip")] if skip_col else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *extra).where(F.col("text").isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, lang string, share double, confidence double"
    return rows.mapInArrow(_detect(shared, "documents", least, bool(skip_col)), schema).withColumnRenamed("id", id_col)
