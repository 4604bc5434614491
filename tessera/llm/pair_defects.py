"""Problem 5: defective question-answer pairs, by a conditional random field over the clauses of the answer.

A clause is a sentence or line. The field tags each clause as answer, refusal, echo, foreign or unfinished from its
wording (declining phrases, and how strange its words are to the answers marked as correct), its overlap with the question, the language models' margin between the question's language
and the clause's, and how answers end in the table (word n-grams seen at and away from sentence ends). The tags' coverage of
the answer decides the pair's one defect; an answer without a clause, or of nothing but a placeholder, is empty.

How words end sentences is counted over all answers of the table, in a pre-aggregated pass (``ending_counts``); each
pair meets the few counts its last words need by a join on 64-bit keys. Only words seen ``KNOWN`` times and on a
``FREQUENT_SHARE`` of all words are broadcast, each with its numbers in answers marked as correct and in the others: a
clause whose words are rare in correct answers, commoner in the others and not the question's is how an answer is declined
in this table, whatever its wording.

The field and the language models are fitted on bounded samples: ``SAMPLE`` rows of the table in hash order (answers
marked as correct that end in a full stop, corrupted in known ways) and the labelled documents of problem 10. Every pair
of the table is then judged on its whole text.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .language_id import HASHES, REMEMBERED, Detector, Models, below, words_of
from .textcodes import mix

SAMPLE = 5000  # rows the field is fitted on
OVERDRAWN = 1.2  # times the sample that pass the threshold on the hash
FREQUENT = 20  # times a word is seen from which a capital doesn't make it a name
KNOWN = 3  # times a word is seen from which its numbers by mark are kept
FREQUENT_SHARE = 5e-6  # of all words, from which either holds; bounds what is broadcast
FAMILIAR = 2e-5  # of the words of correct answers, from which a word is one of theirs
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)

# fixed values: what stands for a missing answer
PLACEHOLDERS = frozenset(
    "n/a|na|n.a.|nan|null|none|nil|empty|<empty>|[empty]|no answer|[no answer]|(no answer)|no response|tbd|tba|todo|to do|pending|string|answer|text|undefined|unknown|missing|placeholder|lorem ipsum|xxx|test|keine antwort|pas de réponse|sin respuesta".split("|")
)
# fixed values: wording that declines, by part: who speaks, that it can't, what it can't do, regret, and closing phrases
SPEAKER = regex.compile(r"(?i)\b(?:i|i'm|i’m|me|my|we|as an assistant|ich|mir|wir|je|nous|puedo|podemos|dispongo|tengo|yo|ik|io|posso|eu)\b")
UNABLE = regex.compile(
    r"(?i)\b(?:can't|can’t|cannot|can not|unable|not able|could not|couldn't|won't|will not|decline|rather not|not possible|not permitted|outside what|beyond what|don't have|do not have|no information|says nothing"
    r"|nicht beantworten|keine auskunft|nicht helfen|kann .{0,30}(?:nicht|keine)|darf .{0,20}nicht|ne (?:peux|puis|suis|dispose)|pas en mesure|no (?:puedo|podemos|me es posible|dispongo|tengo)|non posso|não posso|kan niet)\b"
)
REPLY = regex.compile(
    r"(?i)\b(?:answer|respond|reply|help|assist|advice|address|discuss|comment|verify|guess|information|question|request|topic|matter|auskunft|beantworten|helfen|frage|aider|répondre|question|sujet|responder|ayudar|pregunta|contestar|rispondere|aiutare|ajudar)\b"
)
REGRET = regex.compile(r"(?i)^(?:i'm |i am )?(?:sorry|unfortunately|regrettably|i apologi[sz]e|apologies|leider|tut mir leid|désolée?|malheureusement|lo siento|lamentablemente|mi dispiace|helaas)\b")
CLOSER = regex.compile(
    r"(?i)^(?:please (?:contact|consult|ask|see|refer|try)|is there anything else|try asking|i apologi[sz]e for|can i help|anything else|bitte wenden|kann ich sonst|veuillez|puis-je|por favor|hay algo)"
)
LEAD = regex.compile(r"(?i)^(?:you asked|your question|the question(?: is| was)?|question|answer|q|a|frage|antwort|sie fragten|votre question|vous avez demandé|réponse|su pregunta|usted preguntó|respuesta|pregunta)\s*:?\s*")
# of each pattern above, words of which what it matches must hold one; at the line's begin, the first one
_ANYWHERE = (
    (SPEAKER, frozenset("i me my we as ich mir wir je nous puedo podemos dispongo tengo yo ik io posso eu".split())),
    (UNABLE, frozenset("can cannot unable not could couldn won will decline rather outside beyond don do no says nicht keine kann darf ne pas non não kan".split())),
    (REPLY, frozenset("answer respond reply help assist advice address discuss comment verify guess information question request topic matter auskunft beantworten helfen frage aider répondre sujet responder ayudar pregunta contestar rispondere aiutare ajudar".split())),
)
_AT_BEGIN = (
    (REGRET, frozenset("i sorry unfortunately regrettably apologies leider tut désolé désolée malheureusement lo lamentablemente mi helaas".split())),
    (CLOSER, frozenset("please is try i can anything bitte kann veuillez puis por hay".split())),
)
_LEADING = frozenset("you your the question answer q a frage antwort sie votre vous réponse su usted respuesta pregunta".split())

_CLAUSE = regex.compile(r"[^\n.!?。！？]*(?:[.!?](?=\S)(?![\"'”’)\]]*\s)[^\n.!?。！？]*)*(?:[.!?。！？]+[\"'”’)\]]*|$|\n)")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’.,–-][\p{L}\p{N}]+)*")
_SQUEEZE = regex.compile(r"[\p{L}\p{N}]+")
# the same two for texts below U+0300
_LATIN_WORD = re.compile(r"[^\W_]+(?:['’.,–-][^\W_]+)*")
_LATIN_SQUEEZE = re.compile(r"[^\W_]+")
_STOP = regex.compile(r"[.!?。！？][\"'”’)\]]*\s*$")
_MARKER = regex.compile(r"^\s*(?:[-*•>]|\d{1,2}[.)])\s*")
_ITEM = regex.compile(r"^\s*[-*•>]\s+(?:\S+\s+){2}")
_BARE = regex.compile(r"^\s*(?:[-*•>]|\d{1,2}[.)]?)\s*$")
_LETTER = regex.compile(r"[\p{L}\p{N}]")
FEATURES = 34
STRANGE = slice(27, 33)  # features of how strange a clause's words are, and of what speaks for other answers
WORDING = slice(1, 9)  # features read off the lists of declining wording


def is_empty(text: str | None) -> bool:
    """Missing, blank, without letters and digits, or only a placeholder."""
    if text is None or not _LETTER.search(text):
        return True
    return text.strip().lower().rstrip(".!") in PLACEHOLDERS


def is_correct(feedback: str | None) -> bool:
    return bool(feedback) and feedback.strip().lower() == "correct"


def clauses(text: str) -> list[str]:
    out: list[str] = []
    for m in _CLAUSE.finditer(text):
        part = m.group().strip()
        if not part:
            continue
        if out and _BARE.match(out[-1]) and "\n" not in text[m.start() - 1 : m.start()]:
            out[-1] = f"{out[-1]} {part}"  # a list number and its item
        else:
            out.append(part)
    return out


@lru_cache(maxsize=1 << 18)
def _code(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def word_key(word: str) -> int:
    """The key of a word's count in the vocabulary."""
    return int(np.uint64(_code("\0" + word)).astype(np.int64))


def _run_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """Keys of all runs of ``n`` codes."""
    h = np.full(max(len(codes) - n + 1, 0), n, np.uint64)
    for j in range(n):
        h = mix(h + codes[j : j + len(h)])
    return h.astype(np.int64)


def _answer_words(texts: list[str]) -> Counter[str]:
    """Words of the texts, lower-cased; a last word without a stop may be a torn one and doesn't count."""
    out: Counter[str] = Counter()
    for text in texts:
        words = _words(text)
        out.update(w.lower() for w in (words if _STOP.search(text) else words[:-1]))
    return out


class Endings:
    """Which words end sentences, by their last one, two and three words: ``table`` holds (ends, goes on) by key, and a
    word's count under ``word_key``; all counts of the texts learned, or those looked up for the pairs at hand."""

    def __init__(self, frequent: set[str] | frozenset[str] = frozenset(), marks: dict[str, tuple[int, int]] | None = None):
        self.frequent = frequent
        self.table: dict[int, tuple[int, int]] = {}
        self.marks = marks or {}  # of the known words: times in answers marked as correct, and in the others
        self.marked = tuple(max(sum(m[k] for m in self.marks.values()), 1) for k in (0, 1))
        self.kinds = {w: self._kind(*m) for w, m in self.marks.items()}
        self.unknown = self._kind(0, 0)
        self.facts: dict[str, tuple[int, bool, float, str]] = {}

    def __getstate__(self):
        return self.__dict__ | {"kinds": None, "facts": {}}

    def __setstate__(self, state):
        self.__dict__ = state
        self.kinds = {w: self._kind(*m) for w, m in self.marks.items()}

    def _kind(self, good: int, bad: int) -> tuple[bool, float]:
        """Whether correct answers don't use a word, and by how much it speaks for the others (log)."""
        g, b = self.marked
        return good < max(3, FAMILIAR * g), math.log((bad + 2 * b / (g + b)) / (good + 2 * g / (g + b)) * g / b)

    def strangeness(self, words: list[str], less: int = 0) -> tuple[float, float]:
        """Share of the words that correct answers don't use, and by how much the words speak for the other answers (log)."""
        if not self.marks:
            return 0.0, 0.0
        own = [self.facts.get(w) or self._fact(w) for w in words]
        own = [f for i, f in enumerate(own) if f[0] == 1 or f[0] == 2 and not i]
        if not own:
            return 0.0, 0.0
        if less:
            counts = [self.marks.get(f[3], (0, 0)) for f in own]
            kinds = [self._kind(max(good - less, 0), bad) for good, bad in counts]
            return sum(k[0] for k in kinds) / len(own), sum(k[1] for k in kinds) / len(own)
        return sum(f[1] for f in own) / len(own), sum(f[2] for f in own) / len(own)

    def _fact(self, word: str) -> tuple[int, bool, float, str]:
        """0 for a number, 2 for what may be a name, else 1; with the word's kind and its lower case."""
        low = word.lower()
        form = 0 if any(map(str.isdigit, word)) else 1 if word[0].islower() or low in self.frequent else 2
        if len(self.facts) > REMEMBERED:
            self.facts.clear()
        fact = self.facts[word] = (form, *self.kinds.get(low, self.unknown), low)
        return fact

    def mask(self, words: list[str]) -> list[str]:
        out = []
        for i, w in enumerate(words):
            if any(map(str.isdigit, w)):
                out.append("0" if w[0].isdigit() else "F0")
            elif w[0].isupper() and i and w.lower() not in self.frequent:
                out.append("N")
            else:
                out.append(w.lower())
        return out

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(keys, ends, goes on)`` of the word runs in the sentences of the texts."""
        codes, left, whole = [], [], []
        for text in texts:
            parts = clauses(text)
            for k, part in enumerate(parts):
                masked = self.mask(_words(_MARKER.sub("", part)))
                codes += map(_code, masked)
                left += range(len(masked), 0, -1)
                whole += [k + 1 < len(parts) or bool(_STOP.search(part))] * len(masked)
        x, left, whole = np.array(codes, np.uint64), np.array(left, np.int64), np.array(whole, bool)
        keys, ends = [], []
        for n in (1, 2, 3):
            key = _run_keys(x, n)
            at = left[: len(key)]
            used = (at > n) | ((at == n) & whole[: len(key)])
            keys.append(key[used])
            ends.append(at[used] == n)
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        end = np.bincount(of, weights=np.concatenate(ends), minlength=len(key)).astype(np.int64)
        return key, end, np.bincount(of, minlength=len(key)) - end

    def learn(self, texts: list[str]) -> None:
        words = _answer_words(texts)
        self.frequent = {w for w, n in words.items() if n >= max(FREQUENT, FREQUENT_SHARE * words.total())}
        self.table = {k: (e, g) for k, e, g in zip(*(c.tolist() for c in self.count(texts)))} | {word_key(w): (0, n) for w, n in words.items()}

    def keys(self, part: str) -> list[int]:
        """The keys that judging a last clause without a stop looks up."""
        masked = self.mask(_words(_MARKER.sub("", part)))
        return [self._key(masked, n) for n in (1, 2, 3)] + [word_key(w) for w in masked[-1:]]

    def knows(self, word: str) -> bool:
        return word_key(word) in self.table

    @staticmethod
    def _key(masked: list[str], n: int) -> int:
        own = masked[-n:]
        return int(_run_keys(np.array([_code(w) for w in own], np.uint64), len(own))[0]) if own else 0

    def chance(self, masked: list[str], less: int = 0) -> tuple[float, float]:
        """Probability that a sentence ends after the last word, and after the last three, each order backed by the lower."""
        p = first = 0.05
        for n, trust in ((1, 0.5), (2, 2.0), (3, 4.0)):
            end, go = self.table.get(self._key(masked, n), (0, 0))
            end = max(end - less, 0)
            p = (end + trust * p) / (end + go + trust)
            if n == 1:
                first = p
        return first, p


def _longest(needle: list[str], hay: list[str]) -> int:
    """Length of the longest run of ``needle`` that is a run of ``hay``."""
    best, row = 0, [0] * (len(hay) + 1)
    for a in needle:
        last = 0
        for j, b in enumerate(hay, 1):
            here = last + 1 if a == b else 0
            last, row[j] = row[j], here
            if here > best:
                best = here
    return best


def _squeezed(text: str) -> list[str]:
    low = text.lower()
    return (_LATIN_SQUEEZE if _is_latin(low) else _SQUEEZE).findall(low)


def _words(text: str) -> list[str]:
    return (_LATIN_WORD if _is_latin(text) else _WORD).findall(text)


def _apart(words: list[str]) -> list[str]:
    """The words of a Latin text in lower case, cut at what joins their parts."""
    out: list[str] = []
    for w in words:
        if w.isalnum():
            out.append(w.lower())
        else:
            out += _LATIN_SQUEEZE.findall(w.lower())
    return out


def _is_latin(text: str) -> bool:
    return text.isascii() or max(text) < "\u0300"


class Judge:
    """The features of the clauses, the fitted field and the verdict on pairs."""

    def __init__(self, models: Models, endings: Endings, prior: np.ndarray):
        self.models, self.endings, self.prior = models, endings, prior
        self.detector: Detector | None = None
        self.counts: DataFrame | None = None  # of the whole table, where the endings hold only what is looked up
        self.weights = np.zeros((FEATURES, len(TAGS)))
        self.moves = np.zeros((len(TAGS), len(TAGS)))

    def __getstate__(self):
        return self.__dict__ | {"detector": None, "counts": None}

    def languages(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text under each language."""
        if self.detector is None:
            self.detector = Detector(self.models)
        width = len(self.models.names)
        words = [words_of(t) for t in texts]
        flat = [w for own in words for w in own]
        out = np.zeros((len(texts), width))
        if flat and width:
            rows = self.detector._rows(flat)
            count = np.fromiter(map(len, words), np.int64, len(words))
            used = np.flatnonzero(count)
            start = np.concatenate(([0], np.cumsum(count[used])[:-1]))
            out[used] = np.add.reduceat(self.detector.scores[rows], start)
        return out

    def features(self, question: str, parts: list[str], margin: list[float], total_margin: float, less: int = 0) -> np.ndarray:
        """One row per clause. ``margin``: nats by which another language fits the clause better than the question's."""
        q = _squeezed(question)
        rows: list[list[float]] = []
        known = set(q)
        telling = {w for w in known if len(w) > 3}
        words = [_words(part) for part in parts]
        squeezed = [_apart(own) if _is_latin(part) else _squeezed(part) for own, part in zip(words, parts)]
        # most clauses lack the first words of the lists' wording, and the lists are looked up for the rest only
        led = [bool(w) and w[0] in _LEADING and bool(LEAD.match(part)) for w, part in zip(squeezed, parts)]
        bare = [_squeezed(LEAD.sub("", part)) if lead else w for w, part, lead in zip(squeezed, parts, led)]
        answer = [w for k, own in enumerate(squeezed) for w in (own if k else bare[0])]
        held = set(answer)
        # a run can't be longer than the number of common words, so most clauses need no comparison
        echo_all = len(answer) > 0 and bool(q) and sum(map(held.__contains__, q)) >= 0.9 * len(q) and _longest(q, answer) >= 0.9 * len(q)
        rest = len(answer) - (len(q) * (1 + (len(answer) >= 2 * len(q))) if echo_all else 0)
        for i, part in enumerate(parts):
            own = bare[i]
            run = _longest(own, q) / len(own) if own and sum(map(known.__contains__, own)) >= 0.5 * len(own) else 0.0
            own_words = set(squeezed[i])
            speaker, unable, reply = (not own_words.isdisjoint(first) and bool(pattern.search(part)) for pattern, first in _ANYWHERE)
            regret, closer = (bool(own) and squeezed[i][0] in first and bool(pattern.search(part)) for pattern, first in _AT_BEGIN)
            row = [0.0] * FEATURES
            rows.append(row)
            row[0] = 1
            row[1:9] = speaker, unable, reply, regret, closer, unable and reply, speaker and unable and reply, regret and unable
            row[9:14] = run >= 0.9, run >= 0.9 and echo_all, echo_all and rest <= 6, run < 0.5, led[i] and run >= 0.9
            strange, speaks = self.endings.strangeness(words[i], less)
            apart = telling.isdisjoint(own)  # nothing of the question's in it
            if total_margin <= 6 or margin[i] <= 0:  # another language has its own words for everything
                row[STRANGE] = strange >= 0.3, strange >= 0.6, apart and strange >= 0.3, apart and strange >= 0.6, speaks >= 0.5, apart and speaks >= 0.5
            row[14:18] = margin[i] > 3, margin[i] > 10, total_margin > 6 and margin[i] > 0, total_margin > 20 and margin[i] > 0
            if i + 1 == len(parts) and not own:
                row[18] = row[26] = 1
            elif i + 1 == len(parts):
                row[18] = 1
                stop = bool(_STOP.search(part)) and not _BARE.match(part)
                row[19] = stop
                if not stop:
                    masked = self.endings.mask(_words(_MARKER.sub("", part)))
                    one, three = self.endings.chance(masked, less)
                    row[33] = bool(_MARKER.match(part)) and not _BARE.match(part)  # items of a list carry no stop
                    row[20] = part[-1] in ",;:(-–&/"
                    row[21] = three < 0.004 or one < 0.001
                    row[22] = 0.004 <= three < 0.015
                    row[23] = 0.05 <= three < 0.2
                    row[24] = three >= 0.2
                    row[25] = part.count("(") > part.count(")") or part.count("“") > part.count("”")
                    row[26] = bool(_BARE.match(part)) or (bool(masked) and masked[-1].islower() and not self.endings.knows(masked[-1]))
        return np.array(rows, float).reshape(len(parts), FEATURES)

    def emit(self, pairs: list[tuple[str, str]], less: int = 0) -> list[tuple[list[str], np.ndarray]]:
        """Clauses and features of each pair, with the languages scored in one go."""
        parts = [clauses(a) for _, a in pairs]
        texts = [q for q, _ in pairs] + [p for own in parts for p in own]
        like = self.languages(texts)
        asked = (like[: len(pairs)] + self.prior).argmax(axis=1) if like.shape[1] else np.zeros(len(pairs), int)
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        margin, total = np.zeros(int(count.sum())), np.zeros(len(pairs))
        if like.shape[1] and len(margin):
            mine, of = like[len(pairs) :], np.repeat(np.arange(len(pairs)), count)
            margin = mine.max(axis=1) - mine[np.arange(len(mine)), asked[of]]
            used = np.flatnonzero(count)
            whole = np.add.reduceat(mine, (np.cumsum(count) - count)[used])
            total[used] = whole.max(axis=1) - whole[np.arange(len(used)), asked[used]]
        margins, totals, at = margin.tolist(), total.tolist(), 0
        out = []
        for k, own in enumerate(parts):
            out.append((own, self.features(pairs[k][0], own, margins[at : at + len(own)], totals[k], less)))
            at += len(own)
        return out

    def tags(self, x: np.ndarray) -> np.ndarray:
        """The most likely tags (Viterbi)."""
        score = x @ self.weights
        best, back = score[0], []
        for row in score[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return np.array(path[::-1])

    def verdicts(self, pairs: list[tuple[str, str]]) -> list[str | None]:
        """The defect of each pair whose answer isn't empty, or None."""
        out: list[str | None] = []
        for parts, x in self.emit(pairs):
            if not parts:
                out.append("empty")
                continue
            tags = self.tags(x)
            size = np.fromiter(map(len, parts), float, len(parts))
            cover = np.bincount(tags, weights=size, minlength=len(TAGS)) / size.sum()
            if cover[REFUSAL] > 0.5:
                out.append("refusal")
            elif cover[ECHO] > 0.5:
                out.append("copy")
            elif cover[FOREIGN] > 0.5:
                out.append("other_language")
            elif tags[-1] == UNFINISHED:
                out.append("truncated")
            else:
                out.append(None)
        return out


# fixed values: declining sentences the field is shown, with closing phrases
_DECLINES = (
    "I am sorry, but I cannot answer this question.", "I can't help with this.", "I'm unable to respond to that request.", "Unfortunately I do not have any information on this topic.",
    "I won't comment on this matter.", "We are not able to discuss that.", "It is not possible for me to answer here.", "I could not verify this.", "I must decline to help with that question.",
    "As an assistant I can't give advice.", "The passages say nothing about this, so I cannot answer.", "Leider kann ich diese Frage nicht beantworten.", "Dazu kann ich keine Auskunft geben.",
    "Désolé, je ne peux pas répondre à cette question.", "Je ne suis pas en mesure de vous aider.", "Lo siento, no puedo ayudar con esta pregunta.", "No puedo responder a eso.",
)
_CLOSES = ("Please contact the office.", "Is there anything else?", "I apologise for this.", "Please consult an adviser.", "Try asking again.")
_LEADS = ("", "", "You asked: ", "Question: ", "Your question: ")
_BREAKS = ("", "", "", "", ",", " because the", ", and the", " (see also", " within", " after", " which", " as", " for")


def _examples(clean: list[tuple[str, str, int]], rng: random.Random) -> list[tuple[str, str, int, list[int] | None]]:
    """``(question, answer, own language, tags or None for 'answer')`` corrupted in known ways."""
    out: list[tuple[str, str, int, int]] = []
    by: dict[int, list[str]] = {}
    for _, a, k in clean:
        by.setdefault(k, []).append(a)
    for q, a, k in clean:
        pick = rng.random()
        if pick < 0.3:
            out.append((q, a, k, ANSWER))
        elif pick < 0.45:
            out.append((q, a.rstrip(" .!?"), k, ANSWER))
        elif pick < 0.67:
            words = a.split()
            last = len(clauses(a)[-1].split())
            if last < 4:
                out.append((q, a, k, ANSWER))
                continue
            cut = len(words) - rng.randrange(1, last - 1)
            text = " ".join(words[:cut])
            if rng.random() < 0.4 and len(words[cut - 1]) > 3:
                text = text[: -rng.randrange(1, len(words[cut - 1]) - 1)]
            out.append((q, text + rng.choice(_BREAKS), k, UNFINISHED))
        elif pick < 0.8:
            lead = rng.choice(_LEADS)
            text = q if rng.random() < 0.7 else f"{q} {q}"
            out.append((q, lead + text + rng.choice(["", ".", "?", "\n"]), k, ECHO))
        elif pick < 0.9:
            text = rng.choice(_DECLINES)
            if rng.random() < 0.6:
                text += " " + rng.choice(_CLOSES)
            out.append((q, text, k, REFUSAL))
        else:
            other = [x for x in by if x != k]
            if other:
                out.append((q, rng.choice(by[rng.choice(other)]), k, FOREIGN))
    return out


def _train(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of the field: full-batch gradient ascent (Adam) on the conditional likelihood."""
    k, longest = len(TAGS), max(len(y) for _, y in sequences)
    n = len(sequences)
    x = np.zeros((n, longest, FEATURES))
    y = np.zeros((n, longest), int)
    on = np.zeros((n, longest))
    for i, (xs, ys) in enumerate(sequences):
        x[i, : len(ys)], y[i, : len(ys)], on[i, : len(ys)] = xs, ys, 1
    w, t = np.zeros((FEATURES, k)), np.zeros((k, k))
    gold_w = np.einsum("ntf,ntk->fk", x * on[..., None], np.eye(k)[y])
    gold_t = np.zeros((k, k))
    for i in range(longest - 1):
        np.add.at(gold_t, (y[:, i], y[:, i + 1]), on[:, i + 1])
    mw = vw = np.zeros_like(w)
    mt = vt = np.zeros_like(t)

    def lse(a, axis):
        m = a.max(axis=axis, keepdims=True)
        return np.log(np.exp(a - m).sum(axis=axis)) + m.squeeze(axis)

    for step in range(1, steps + 1):
        s = x @ w
        f = np.zeros((n, longest, k))
        b = np.zeros((n, longest, k))
        f[:, 0] = s[:, 0]
        for i in range(1, longest):
            nxt = lse(f[:, i - 1, :, None] + t, 1) + s[:, i]
            f[:, i] = np.where(on[:, i, None] > 0, nxt, f[:, i - 1])
        for i in range(longest - 2, -1, -1):
            prev = lse(t + (s[:, i + 1] + b[:, i + 1])[:, None, :], 2)
            b[:, i] = np.where(on[:, i + 1, None] > 0, prev, 0)
        z = lse(f[:, -1], 1)
        p = np.exp(f + b - z[:, None, None]) * on[..., None]
        gw = gold_w - np.einsum("ntf,ntk->fk", x, p) - 0.02 * w * n / 100
        gt = gold_t - 0.02 * t * n / 100
        for i in range(longest - 1):
            joint = f[:, i, :, None] + t + (s[:, i + 1] + b[:, i + 1])[:, None, :] - z[:, None, None]
            gt -= (np.exp(joint) * on[:, i + 1, None, None]).sum(axis=0)
        gw, gt = gw / n, gt / n
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2
        mt, vt = 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt**2
        a = 0.2 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w = w + a * mw / (np.sqrt(vw) + 1e-8)
        t = t + a * mt / (np.sqrt(vt) + 1e-8)
    return w, t


def fit_judge(models: Models, rows: list[tuple[str, str | None, str | None]], frequent: set[str] | None = None, look_up: Callable[[set[int]], dict[int, tuple[int, int]]] | None = None, marks: dict[str, tuple[int, int]] | None = None) -> Judge:
    """The judge from the language models and sampled ``(question, answer, feedback)`` rows.

    ``look_up`` gives the counts of keys over the whole table, whose frequent words are ``frequent``, with their numbers
    by mark in ``marks``; without it the endings and marks are counted on ``rows``.
    """
    rng = random.Random(17)
    known = [(q, a, f) for q, a, f in rows if q and q.strip() and a and not is_empty(a)]
    if look_up is None:
        good, bad = (_answer_words([a for _, a, f in known if is_correct(f) == right]) for right in (True, False))
        marks = {w: (good[w], bad[w]) for w in good | bad}
    endings = Endings(frequent or frozenset(), marks)
    if look_up is None:
        endings.learn([a for _, a, _ in known])
    judge = Judge(models, endings, np.zeros(len(models.names)))
    like = judge.languages([a for _, a, _ in known]) if known else np.zeros((0, len(models.names)))
    if len(models.names) and len(known):
        share = np.bincount(like.argmax(axis=1), minlength=len(models.names)) + 0.1
        # questions are short and full of names: the sample's mix of languages counts as much as a few letters
        judge.prior = np.log(share / share.sum())
        asked = (judge.languages([q for q, _, _ in known]) + judge.prior).argmax(axis=1)
        given = like.argmax(axis=1)
    else:
        asked = given = np.zeros(len(known), int)
    clean = [
        (q, a, int(k)) for (q, a, f), k, g in zip(known, asked, given)
        if k == g and is_correct(f) and (_STOP.search(a) or _ITEM.match(a.splitlines()[-1])) and len(a) > 40 and not (UNABLE.search(a) and SPEAKER.search(a)) and _longest(_squeezed(q), _squeezed(a)) < 0.9 * len(_squeezed(q))
    ]
    examples = _examples(clean, rng) + [(q, d, 0, REFUSAL) for q, _, _ in clean[:40] for d in (rng.choice(_DECLINES),)]
    if not examples:
        clean = [("What is the fee?", "The fee is due by the end of the year.", 0)]
        examples = _examples(clean * 60, rng)
    if look_up is not None:
        endings.table = look_up({k for _, a, _, _ in examples for k in _last_keys(endings, a)})
    sequences = []
    for (own, x), (_, _, _, tag) in zip(judge.emit([(q, a) for q, a, _, _ in examples], less=1), examples):
        if not own:
            continue
        y = np.full(len(own), tag if tag in (ECHO, REFUSAL, FOREIGN) else ANSWER)
        if tag == UNFINISHED:
            y[-1] = UNFINISHED
        sequences.append((x, y))
        if tag == REFUSAL and endings.marks and not x[:, 14:18].any():
            blank = x.copy()  # the same declined without the lists' wording: what is left is how its words are used here
            blank[:, WORDING] = 0
            sequences.append((blank, y))
            strange = blank.copy()  # and in words that aren't used here at all
            strange[:, STRANGE] = [[1, k, 1, k, m, m] for k, m in ((rng.randrange(2), rng.randrange(2)) for _ in own)]
            sequences.append((strange, y))
    if sum(bool(len(y)) and y[0] == FOREIGN for _, y in sequences) < 20:
        # a sample in one language has no foreign answers: show the field the margins that one would have
        for x, y in [s for s in sequences if s[1][0] == ANSWER and s[1][-1] == ANSWER][:60]:
            x = x.copy()
            x[:, 14:18] = 1
            sequences.append((x, np.full(len(y), FOREIGN)))
    judge.weights, judge.moves = _train(sequences)
    judge.detector = None
    return judge


def _last_keys(endings: Endings, text: str) -> list[int]:
    """The keys the verdict on an answer looks up; none if its last clause ends in a stop."""
    parts = clauses(text)
    return endings.keys(parts[-1]) if parts and (not _STOP.search(parts[-1]) or _BARE.match(parts[-1])) else []


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, right = batch.column(0).to_pylist(), list(map(is_correct, batch.column(1).to_pylist()))
        good, bad = (_answer_words([a for a, r in zip(texts, right) if r == kind and not is_empty(a)]) for kind in (True, False))
        words = list(good | bad)
        counts = [[c[w] for w in words] for c in (good, bad)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(map(word_key, words), pa.int64()), *(pa.array(c, pa.int64()) for c in counts)], names=["word", "key", "good", "bad"])


def _count_runs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings = Endings(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in endings.count([a for a in batch.column(0).to_pylist() if not is_empty(a)])], names=["key", "ends", "goes"])

    return run


def ending_counts(pairs: DataFrame, question: str, answer: str, feedback: str) -> tuple[DataFrame, set[str], dict[str, tuple[int, int]]]:
    """``(counts(key, ends, goes), frequent words, marks)`` over every answer with a question that isn't blank.

    ``marks`` holds the words seen ``KNOWN`` times with their numbers in answers marked as correct and in the others. Counted in each batch
    first, then summed by key; blank answers and placeholders aren't counted.
    """
    texts = pairs.where(F.col(question).rlike(r"(?U)\S") & F.col(answer).isNotNull()).select(F.col(answer).alias("a"), F.col(feedback).alias("f"))
    words = cut(texts.mapInArrow(_count_words, "word string, key long, good long, bad long").groupBy("word", "key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    total = words.agg(F.coalesce(F.sum(F.col("good") + F.col("bad")), F.lit(0))).first()[0]
    known = words.where(F.col("good") + F.col("bad") >= max(KNOWN, FREQUENT_SHARE * total))
    marks = {r["word"]: (r["good"], r["bad"]) for r in known.select("word", "good", "bad").collect()}  # at most 1 / FREQUENT_SHARE
    frequent = {w for w, n in marks.items() if sum(n) >= FREQUENT}
    runs = texts.mapInArrow(_count_runs(pairs.sparkSession.sparkContext.broadcast(frequent)), "key long, ends long, goes long")
    runs = runs.groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    return cut(runs.unionByName(words.select("key", F.lit(0).cast("long").alias("ends"), (F.col("good") + F.col("bad")).alias("goes")))), frequent, marks


def sampled_rows(pairs: DataFrame, id_col: str, question: str, answer: str, feedback: str) -> list[tuple[str, str, str | None]]:
    """The ``SAMPLE`` answered rows of the lowest hashes; a threshold set from their number keeps the rest where they are read."""
    both = pairs.where(F.col(answer).isNotNull() & F.col(question).isNotNull())
    share = min(OVERDRAWN * SAMPLE / max(both.count(), 1), 1.0)
    drawn = both.where(below(F.col(id_col), share)).select(F.pmod(F.xxhash64(id_col), F.lit(HASHES)).alias("h"), F.col(id_col).cast("string").alias("i"), question, answer, feedback)
    return [tuple(r)[2:] for r in sorted(drawn.collect(), key=lambda r: (r[0], r[1] or "", r[2], r[3]))[:SAMPLE]]


def sampled_judge(pairs: DataFrame, models: Models, id_col: str, question: str, answer: str, feedback: str) -> Judge:
    """The judge fitted on ``SAMPLE`` rows of ``pairs`` in hash order, with the endings of all its answers."""
    rows = sampled_rows(pairs, id_col, question, answer, feedback)
    counts, frequent, marks = ending_counts(pairs, question, answer, feedback)

    def look_up(keys: set[int]) -> dict[int, tuple[int, int]]:
        wanted = pairs.sparkSession.createDataFrame([(k,) for k in keys], "key long")  # bounded by the sample
        return {r["key"]: (r["ends"], r["goes"]) for r in counts.join(F.broadcast(wanted), "key").collect()}

    judge = fit_judge(models, rows, frequent, look_up, marks)
    judge.endings.table, judge.counts = {}, counts
    return judge


def _wanted(shared):
    """Texts -> the keys their verdicts look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings = shared.value.endings
        for batch in batches:
            keys = [[] if is_empty(a) else _last_keys(endings, a) for a in batch.column(1).to_pylist()]
            of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array([k for own in keys for k in own], pa.int64())], names=["node", "key"])

    return run


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge: Judge = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, questions, fields = part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist()
                answers = part.column(3).to_pylist()
                if part.num_columns > 4:
                    judge.endings.table = {f["key"]: (f["ends"], f["goes"]) for own in part.column(4).to_pylist() for f in own or ()}
                verdict: list[str | None] = ["empty" if is_empty(a) else None for a in answers]
                rest = [i for i, v in enumerate(verdict) if v is None]
                for i, v in zip(rest, judge.verdicts([(questions[i], answers[i]) for i in rest])):
                    verdict[i] = v
                keep = [i for i, v in enumerate(verdict) if v]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(keep, pa.int64())), pa.array([fields[i] for i in keep], pa.string()), pa.array([verdict[i] for i in keep], pa.string())],
                    names=["id", "answer_field", "defect"],
                )

    return run


def pair_defects(pairs: DataFrame, judge: Judge, id_col: str, question: str, answer: str, corrected: str | None = None) -> DataFrame:
    """``(<id>, answer_field, defect)`` of every defective pair, at most one defect each.

    Rows with a null or blank question are no pair; a null or ``''`` corrected answer is none either, while a null
    ``answer`` is an empty one. ``defect`` is empty, refusal, copy, other_language or truncated.
    """
    base = pairs.where(F.col(question).rlike(r"(?U)\S"))
    both = [F.struct(F.lit(answer).alias("field"), F.col(answer).alias("text"))]
    if corrected:
        both.append(F.when(F.col(corrected) != "", F.struct(F.lit(corrected).alias("field"), F.col(corrected).alias("text"))))
    rows = base.select(F.col(id_col).alias("id"), F.col(question).alias("q"), F.explode(F.array_compact(F.array(*both))).alias("a"))
    rows = rows.select("id", "q", F.col("a.field").alias("field"), F.col("a.text").alias("text"))
    shared = pairs.sparkSession.sparkContext.broadcast(judge)  # bounded by the samples
    kind = rows.schema["id"].dataType.simpleString()
    if judge.counts is not None:
        rows = rows.withColumn("node", F.xxhash64("text"))
        wanted = rows.where("text IS NOT NULL").select("node", "text").mapInArrow(_wanted(shared), "node long, key long").distinct()
        facts = wanted.join(judge.counts, "key").groupBy("node").agg(F.collect_list(F.struct("key", "ends", "goes")).alias("facts"))  # at most four a text
        rows = rows.join(facts, "node", "left").select("id", "q", "field", "text", "facts")
    return rows.mapInArrow(_judge(shared), f"id {kind}, answer_field string, defect string").withColumnRenamed("id", id_col)
