"""Operators with fitted models: held-out accuracy on texts made here, dirt, empty tables, clashing columns."""

import random

import pytest

from tessera.llm.language_id import document_languages, fit, fitted, named_language, segment_languages, segments
from tessera.llm.main_content import Vocabulary, content_scores, fitted_scores, furniture_lines, main_body, path_counts, path_sums, read_lines
from tessera.llm import main_content
from tessera.llm import pair_defects as defects
from tessera.llm.pair_defects import Endings, clauses, ending_counts, fit_judge, is_empty, pair_defects, sampled_judge

PHRASES = {
    "en": ("the clerk keeps the record", "because the form was late", "within nine days", "and shows it on request", "every month the office checks", "if nothing has changed"),
    "de": ("der Prüfer bewahrt die Akte auf", "weil das Formular zu spät kam", "innerhalb von neun Tagen", "und zeigt sie auf Wunsch", "jeden Monat prüft das Amt", "wenn sich nichts geändert hat"),
    "fr": ("le bureau garde le dossier", "parce que le formulaire est en retard", "dans les neuf jours", "et le montre sur demande", "chaque mois la caisse vérifie", "si rien n'a changé"),
    "ru": ("отдел хранит дело", "потому что форма опоздала", "в течение девяти дней", "и показывает его по запросу", "каждый месяц служба проверяет", "если ничего не изменилось"),
    "ja": ("担当者は書類を保管し", "用紙が遅れたので", "九日以内に", "求められたら見せてください", "毎月事務所は確認します", "変更がなければ"),
}
DIRT = [None, "", "  \n", "12 345 / 678", "—", "𝒳 ∑", "x" * 4000, "İ" * 30]


def sentence(rng, lang):
    stop = "。" if lang == "ja" else ". "
    return (" " if lang != "ja" else "").join(rng.sample(PHRASES[lang], 3)).capitalize() + stop


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        lang = rng.choice(list(PHRASES))
        rows.append((i, "".join(sentence(rng, lang) for _ in range(5)), lang))
    return rows


@pytest.fixture(scope="module")
def models(corpus):
    rng = random.Random(9)
    labels = list(PHRASES)
    return fit([(lang if rng.random() > 0.1 else rng.choice(labels), text) for _, text, lang in corpus])


def test_segments_cover_the_text():
    for text in ("One. Two! 3.5 is three\nnext 「はい。」そう。おわり", "no stop", "a.b.c", "\n\n"):
        spans = segments(text)
        assert "".join(text[a:b] for a, b in spans) == text


def test_documents_and_mixed_segments(spark, models):
    rng = random.Random(11)
    langs = list(PHRASES)
    rows, want = [], set()
    for i in range(80):
        a, b = rng.sample(langs, 2)
        parts = [a] * 4 if i % 2 else [a, b] * 3
        text = "".join(sentence(rng, x) for x in parts)
        text = text.upper() if i % 7 == 0 else text
        rows.append((i, text, a))
        want |= {(i, x) for x in set(parts)}
    rows += [(1000 + i, x, "en") for i, x in enumerate(DIRT)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {(r.doc_id, r.lang) for r in document_languages(df, models, "doc_id", "text").where("doc_id < 1000").collect()}
    assert len(found ^ want) <= 0.03 * len(want)
    assert not document_languages(df.where("doc_id in (1000, 1001, 1002, 1003, 1004)"), models, "doc_id", "text").count()
    seg = segment_languages(df, models, "doc_id", "text").where("doc_id = 1").collect()
    assert {s.lang for s in seg} == {rows[1][2]} and all(0 <= s.confidence <= 1 for s in seg)
    other = document_languages(df.withColumnRenamed("lang", "named"), models, "doc_id", "text", skip_col="named").where("doc_id < 80 and doc_id % 2 = 1")
    assert other.count() <= 2


def test_scraps_have_a_language_with_low_confidence(spark, models):
    from tessera.llm.language_id import Detector

    words = ["a", "e", "o", "en", "in", "es", "an", "on", "re", "se"]
    scraps = [w for w, own in zip(words, Detector(models).detect(words)) if own and own[0][2] >= 0 and own[0][3] < 0.95]
    assert scraps
    df = spark.createDataFrame([*enumerate(scraps), (99, "12")], "doc_id long, text string")
    got = {r.doc_id: r.confidence for r in document_languages(df, models, "doc_id", "text").collect()}
    assert set(got) == set(range(len(scraps))) and max(got.values()) < 0.95


def test_foreign_script_is_rejected(models):
    from tessera.llm.language_id import Detector

    out = Detector(models).detect(["ქართული ენა არის ძალიან ძველი და ლამაზი ენა რომელიც ბევრს უყვარს."])[0]
    assert out and out[0][2] == -1


def test_fitting_from_a_labelled_table(spark, corpus):
    aliases = spark.createDataFrame([(x, a) for x in PHRASES for a in (x, f"{x}-xx")] + [("en", None)], "lang string, alias string")
    rows = [(i, t, f" {x.upper()} " if i % 2 else f"{x}-XX") for i, t, x in corpus] + [(900 + i, x, None) for i, x in enumerate(DIRT)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    named = {r.doc_id: r.named for r in named_language(df, aliases, "label").collect()}
    assert len(named) == len(rows) and all(named[i] == x for i, _, x in corpus) and named[900] is None
    m = fitted(df, aliases, "doc_id", "text", "label")
    assert m.names == sorted(PHRASES)
    empty = fitted(df.limit(0), aliases, "doc_id", "text", "label")
    assert document_languages(df, empty, "doc_id", "text").count() == 0


FACTS = ["The office of {n} keeps the file for {k} days after the last visit.", "A fee of {k} crowns is due when the form of {n} is lodged.", "The record of {n} stays open until the review has ended."]


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(8)
    rows = []
    for i in range(500):
        n, k = rng.choice(["Marlo", "Tessin", "Brandt", "Orwell"]), rng.randrange(2, 99)
        rows.append((i, f"What does the office of {n} do after {k} days with my case?", " ".join(rng.sample(FACTS, 2)).format(n=n, k=k), "Correct"))
    return rows


def test_pair_defects(spark, models, pairs):
    rng = random.Random(5)
    want, rows = {}, []
    for i, q, a, _ in pairs[:200]:
        kind = rng.choice([None, "empty", "truncated", "refusal", "copy", "other_language"])
        text = {
            None: a.rstrip(".") if i % 2 else a, "empty": rng.choice([None, "", " n/a ", "...", "[no answer]"]), "truncated": a[: len(a) - rng.choice([9, 14])],
            "refusal": "I'm sorry, but I cannot help with this question. Please contact the office.", "copy": rng.choice(["", "You asked: "]) + q, "other_language": sentence(rng, "de") + sentence(rng, "de"),
        }[kind]
        rows.append((i, q, text, "Correct", "" if i % 3 else None))
        want[i] = kind
    rows += [(900, None, "x", None, "y"), (901, "  ", None, None, "n/a"), (902, "Who decides on it?", "The board decides on it within nine days of the request.", None, "none")]
    df = spark.createDataFrame(rows, "id long, question string, answer string, feedback string, corrected_answer string")
    judge = fit_judge(models, [(q, a, f) for _, q, a, f in pairs])
    got = {(r.id, r.answer_field): r.defect for r in pair_defects(df, judge, "id", "question", "answer", "corrected_answer").collect()}
    assert got[902, "corrected_answer"] == "empty" and not {k for k in got if k[0] in (900, 901)}
    wrong = [i for i, kind in want.items() if got.get((i, "answer")) != kind]
    assert len(wrong) <= 0.06 * len(want), [(want[i], got.get((i, "answer"))) for i in wrong]
    empty = df.limit(0)
    assert pair_defects(empty, sampled_judge(empty, models, "id", "question", "answer", "feedback"), "id", "question", "answer", "corrected_answer").count() == 0


def test_endings_are_counted_over_all_answers(spark, models, pairs, monkeypatch):
    """Words and sentence ends outside the sample count, and reach the verdicts."""
    monkeypatch.setattr(defects, "SAMPLE", 100)
    rare = [(1000 + i, "What does the desk of Orwell keep for my case?", "The desk keeps every such paper in a locked zarvil", "Correct") for i in range(3)]
    rare += [(2000 + i, "What does the desk of Orwell keep for my case?", "The desk keeps every such paper in a locked zarvil.", "Correct") for i in range(40)]
    rows = [r for r in pairs if r[0] < 300] + rare + [(3000, "Who?", None, None), (3001, " ", "Blank question here.", None), (3002, "Who?", "n/a", None)]
    df = spark.createDataFrame(rows, "id long, question string, answer string, feedback string")
    whole = Endings()
    whole.learn([a for _, q, a, _ in rows if q.strip() and a and not is_empty(a)])
    counts, frequent, marks = ending_counts(df, "question", "answer", "feedback")
    assert frequent == whole.frequent <= set(marks) and all(good >= 3 and not bad for good, bad in marks.values()) and {r.key: (r.ends, r.goes) for r in counts.collect()} == whole.table
    judge = sampled_judge(df, models, "id", "question", "answer", "feedback")
    got = {r.id: r.defect for r in pair_defects(df, judge, "id", "question", "answer").collect()}
    assert not {i for i in got if 1000 <= i < 3000}


def test_refusals_in_wording_unknown_to_the_module(spark, models, pairs):
    asked = "What does the office of Marlo do after 9 days with my case?"
    declined = [
        "That falls outside my remit, so you would have to look elsewhere.", "My guidelines prevent me from going into that.",
        "I would prefer to leave that to a lawyer.", "No comment.", "Let's talk about something else instead.",
    ]
    given = ["The office of Marlo keeps the file for 12 days after the last visit.", "A fee of 7 crowns is due when the form of Marlo is lodged, as I know.", "12 days."]
    wrong = [(5000 + i, asked, "I am not able to say anything on this matter.", "Incorrect") for i in range(20)]
    table = spark.createDataFrame([*pairs, *wrong, *((6000 + i, asked, a, None) for i, a in enumerate(declined + given))], "id long, question string, answer string, feedback string")
    judge = sampled_judge(table, models, "id", "question", "answer", "feedback")
    got = {r.id: r.defect for r in pair_defects(table, judge, "id", "question", "answer").collect() if r.id >= 6000}
    assert [got.get(6000 + i) for i in range(8)] == ["refusal"] * 5 + [None] * 3


def test_samples_are_the_lowest_hashes(spark, pairs, monkeypatch):
    """The sample is bounded, whole where the table is small, and the same however the table is cut."""
    monkeypatch.setattr(defects, "SAMPLE", 60)
    df = spark.createDataFrame(pairs, "id long, question string, answer string, feedback string")
    one, two = (defects.sampled_rows(x, "id", "question", "answer", "feedback") for x in (df.coalesce(1), df.repartition(7)))
    assert one == two and len(one) <= 60 and len(one) >= 45
    monkeypatch.setattr(defects, "SAMPLE", 5000)
    assert len(defects.sampled_rows(df, "id", "question", "answer", "feedback")) == len(pairs)
    assert defects.sampled_rows(df.limit(0), "id", "question", "answer", "feedback") == []


def test_clauses_and_placeholders():
    assert clauses("One. Two?\n- three\n2. four") == ["One.", "Two?", "- three", "2. four"]
    assert is_empty(" N/A. ") and is_empty(None) and is_empty(" ") and not is_empty("27 days.")


PAGE = """Skip to content
Home | News | Contact | Search
You are here: Fees / Form A-1
We use cookies to measure visits. Accept all
Who may sign the form
The clerk signs the form within nine days, and the office keeps a copy of it for as long as the case is open.
You will need:
- A letter from the office
Was this page helpful? Yes / No
- 3 copies of the form
Related pages
> News from 2020
- Tools for the clerk
Form B-2
Menus and footers of a page also fall under the act, because the law treats every part of it in the same way.
Imprint
Privacy
© 2020 Example Online. All rights reserved."""


# pages of pieces; no word of the furniture is among those the module knows, nor is any of its blocks
TOP = ["Admissions\nAthletics\nGiving\nAlumni", "Boarding / Athletics / Library hall / Alumni", "* Giving\n* Athletics\n* Term dates", "Alumni\tTerm dates\tBoarding\tGiving", "Top › Boarding › Room {b}"]
ASIDE = ["Residents looked at\n> Dormitory rules {a}\n> Sports day {b}\n> Tuck shop hours", "Pupils liked\n- Hall rules {b}\n- Sports day {a}\nTuck shop hours"]
PROMPT = ["Pin this", "Send to a friend", "Big print"]
FOOT = ["Registered charity 104455\nMade with Kolibri", "Made with Kolibri\nHall Lane {b}, Marlo", "Governors · Alumni · Giving\nRegistered charity 104455"]
BODY = [
    "Boarding charges for the {w} term\nParents pay the boarding charge of {a} crowns before the {b}th day of the term, unless the bursar has agreed to a later date in writing.",
    "The charge covers meals and laundry:\n- meals on {b} days of the week\n- laundry of up to {a} pieces\n- the use of the {w} room after supper",
    "A pupil who leaves in the course of the term has half of the charge paid back if the place is taken again within {b} weeks.",
    "Kind | Days | Charge\nMeals | {b} | {a}\nLaundry | 3 | {b}", "The {w} master keeps the list of {a} names. Each name is struck out after {b} terms, when the pupil has paid what is due.",
    "Who keeps the {w} room\nThe {w} room is kept by the pupils of the upper forms, who clean it on {b} days of the term and lock it before supper.",
]


def test_unknown_wording_is_told_by_its_ratios(spark):
    rng = random.Random(1)
    rooms = "music reading common quiet painting chess games sewing".split()
    rows, want, kept = [], set(), set()
    for i in range(300):
        pieces = [(x, True) for x in rng.sample(TOP, 2)] + [(x, False) for x in rng.sample(BODY, 4)] + [(rng.choice(FOOT), True)]
        pieces.insert(rng.randrange(3, 7), (rng.choice(ASIDE), True))
        pieces.insert(rng.randrange(3, 7), (rng.choice(PROMPT), True))
        lines = [(line.format(a=rng.randrange(100, 900), b=rng.randrange(2, 20), w=rng.choice(rooms)), f) for x, f in pieces for line in x.split("\n")]
        for k, (_, furniture) in enumerate(lines):
            (want if furniture else kept).add((i, k))
        rows.append((i, "\n".join(x for x, _ in lines)))
    df = spark.createDataFrame(rows, "id int, text string")
    found = {(r.id, r.line_no) for r in furniture_lines(df, "id", "text").collect()}
    assert len(found & want) >= 0.9 * len(want) and len(found & kept) <= 0.05 * len(kept), (len(found & want) / len(want), len(found & kept) / len(kept))


def test_rare_neighbours_count_as_their_shapes(spark, monkeypatch):
    """In a large corpus most pairs of neighbours are below the share; what stands beside a line must still count."""
    rng = random.Random(4)
    rows, kept = [], set()
    for i in range(200):
        pieces = [rng.choice(TOP), *rng.sample(BODY, 3), rng.choice(ASIDE), *rng.sample(BODY, 2), rng.choice(PROMPT), rng.choice(FOOT)]
        lines = [(x.format(a=rng.randrange(100, 900), b=rng.randrange(2, 20), w=rng.choice(["music", "chess", "games"])), p in BODY) for p in pieces for x in p.split("\n")]
        kept |= {(i, k) for k, (_, body) in enumerate(lines) if body}
        rows.append((i, "\n".join(x for x, _ in lines)))
    df = spark.createDataFrame(rows, "id int, text string")
    found = []
    for share in (0.0, 0.005):
        monkeypatch.setattr(main_content, "EDGE_SHARE", share)
        found.append({(r.id, r.line_no) for r in furniture_lines(df, "id", "text").collect()})
    assert len(found[0] ^ found[1]) <= 0.03 * len(found[0]) and len(found[1] & kept) <= 0.05 * len(kept), (len(found[0] ^ found[1]) / len(found[0]), len(found[1] & kept) / len(kept))


def test_lines_and_paths():
    lines = read_lines(["A b.\n\n - Form G-34, 1,200 x \r\nHome | News | Contact", "", "Stage | Days | Fee\nVisit | 3 | 40", "12"])
    assert lines.text.tolist() == [0, 0, 0, 2, 2, 3] and lines.number.tolist() == [0, 2, 3, 0, 1, 0]
    names = ("lines", "chars", "stops", "wording", "words", "separators", "capitals", "numbers", "broken", "arrows", "colons", "columns")
    rows = [dict(zip(names, r)) for r in lines.stats.tolist()]
    assert rows[0]["chars"] == 4 and rows[0]["stops"] == 1 and rows[1]["chars"] == 18 and rows[1]["numbers"] == 2
    assert rows[2]["separators"] == 2 and rows[2]["wording"] == 2 and rows[3]["columns"] == rows[4]["columns"] == 1 and not rows[2]["columns"]


def test_best_states_against_every_sequence():
    from itertools import product

    import numpy as np

    from tessera.llm.main_content import KEEP, _two_states

    rng = np.random.default_rng(2)
    counts = [3, 1, 6, 2]
    score, text = rng.normal(0, 2, sum(counts)), np.repeat([0, 2, 5, 6], counts)
    got, at = _two_states(score, text).tolist(), 0
    for n in counts:
        value = lambda z: sum(s * x for s, x in zip(score[at : at + n], z)) + sum(np.log(KEEP if a == b else 1 - KEEP) for a, b in zip(z, z[1:]))  # noqa: E731,B023
        assert got[at : at + n] == [not x for x in max(product((0, 1), repeat=n), key=value)]
        at += n


def test_main_content(spark):
    rows = [(str(i), PAGE.replace("\n", "\r\n") if i % 3 == 0 else PAGE, "x") for i in range(9)] + [(f"d{i}", x, "y") for i, x in enumerate(DIRT)]
    df = spark.createDataFrame(rows, "id string, text string, what string").withColumnRenamed("what", "kind")
    found = {(r.id, r.line_no) for r in furniture_lines(df, "id", "text").where("length(id) = 1").collect()}
    # one page in nine copies: what stands between furniture everywhere goes with it, but for the passage and what is plainly furniture
    assert found >= {(str(i), k) for i in range(9) for k in (0, 1, 2, 3, 8, 10, 11, 12, 13, 15, 16, 17)} and not found & {(str(i), 5) for i in range(9)}
    body = {r.id: r.text for r in main_body(df, "id", "text").collect()}
    assert len(body) == len(rows) and body["d0"] is None and body["d1"] == "" and "The clerk signs" in body["1"] and "Imprint" not in body["1"]
    empty = df.limit(0)
    assert furniture_lines(empty, "id", "text").count() == 0 and main_body(empty, "id", "text").count() == 0
    vocabulary = path_counts(df, "text")
    assert isinstance(vocabulary, Vocabulary) and vocabulary.lines == sum(len([x for x in (t or "").split("\n") if x.strip()]) for _, t, _ in rows)
    sums = path_sums(df, "text", vocabulary)
    assert sums.stats[:, 0].sum() == vocabulary.lines and abs(content_scores(sums, vocabulary.typical).score).max() <= 10
    assert len(fitted_scores(df, "text").node) == len(sums.node)
