"""Core operators on literal fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import audit, catalog, chunking, diversity, evaluation, html, learning, quality, retrieval, verification
from tessera.plans import queries as registered
from tessera.plans import reports
from tessera.plans.pipeline import ingest, retrieve
from tessera.sources import tables
from tessera.streaming import logs


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()[0]


def test_tokens_and_sentences(spark):
    assert one(spark, "Form I-983 and 214.2(f), H-1B!", tx.ident_tokens) == ["form", "i-983", "and", "214.2", "f", "h-1b"]
    assert one(spark, None, tx.ident_tokens) == [] and one(spark, "A a B", tx.plain_tokens) == ["a", "b"]
    assert one(spark, "See Dr. Smith vs. Jones. It holds 8 CFR 214.2 rules. U.S. law?  Yes!\nNext", tx.sentences) == [
        "See Dr. Smith vs. Jones.", "It holds 8 CFR 214.2 rules.", "U.S. law?", "Yes!", "Next",
    ]
    assert one(spark, " \n ", tx.sentences) == [] and one(spark, None, tx.sentences) == []
    assert one(spark, " A  b\n", tx.norm) == "a b" and one(spark, "x\n y" * 100, tx.snippet) == ("x y" * 100)[:160]
    assert one(spark, " Entailed", tx.verdict) == "entailed" and one(spark, None, tx.verdict) == "baseless"
    assert one(spark, " CORRECT ", tx.feedback_label) == 1 and one(spark, float("nan"), tx.finite, "double") is None


@pytest.mark.parametrize(
    "raw,score,reason",
    [
        ("{'hallucination_score': 1, 'reason': 'it isn\\'t'}", 1, "it isn't"),
        ('```json\n{"hallucination_score": 2, "reason": "a \\"b\\""}\n```', 2, 'a "b"'),
        ("{'hallucination_score': None, 'reason': \"don't\"}", None, "don't"),
        (" no verdict ", None, "no verdict"),
        ('{"hallucination_score": "1", "reason": "says \\"hallucination_score\\": 2"}', 1, 'says "hallucination_score": 2'),
        ('{"reason": null}', None, None),
    ],
)
def test_analysis(spark, raw, score, reason):
    got = one(spark, raw, tx.analysis)
    assert (got["score"], got["reason"]) == (score, reason)
    assert one(spark, None, tx.analysis) is None


def test_no_number_beyond_json_is_left(spark):
    df = spark.sql("SELECT double('nan') AS a, array(1.5D, double('infinity')) AS b, named_struct('x', float('nan'), 'y', array(named_struct('z', double('-infinity')))) AS c, map(1, double('nan')) AS m, 'NaN' AS s")
    r = tx.finite_row(df).first()
    assert (r["a"], r["b"], r["c"]["x"], r["c"]["y"][0]["z"], r["m"], r["s"]) == (None, [1.5, None], None, None, {"1": None}, "NaN")
    assert tx.finite_row(spark.sql("SELECT CAST(NULL AS STRUCT<x: DOUBLE>) AS c, CAST(NULL AS ARRAY<DOUBLE>) AS b")).first() == (None, None)


def test_shared_folder_is_never_one_machines(monkeypatch):
    from tessera import session

    class Unset:
        def isDefined(self):
            return False

        def isEmpty(self):
            return True

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("S", (), {"getCheckpointDir": lambda self: Unset()})()

    with pytest.raises(ValueError):
        session.shared_dir(Cluster)


def test_small_tables_are_spread(spark):
    from tessera.session import spread

    one = spark.range(10).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(spark.range(10, numPartitions=20)).rdd.getNumPartitions() == 20


def test_prose_filter(spark):
    prose = "The employer must keep the record for three years after the date of hire. It must be shown when asked. " * 4
    cases = {
        "banner": "An official website of the United States government", "cookies": "This site uses\ncookies to improve things",
        "citations": "[^ 51] See 8 CFR 214.2 [24] See also the Act (PDF) " * 8, "links": "Home About Contact Careers Press " * 12, "prose": prose, "heading": "Eligibility", "empty": " ", "null": None,
    }
    rows = quality.block_signals(spark.createDataFrame(list(cases.items()), "name string, t string"), "t").collect()
    why = {r["name"]: [x.split(":")[0] for x in r["reasons"]] for r in rows}
    assert why == {"banner": ["chrome"], "cookies": ["chrome"], "citations": ["citations", "fragmented"], "links": ["fragmented"], "prose": [], "heading": [], "empty": ["empty"], "null": ["empty"]}
    kept, dropped = quality.split_blocks(spark.createDataFrame(list(cases.items()), "name string, t string"), "t")
    assert kept.count() + dropped.count() == len(cases)
    assert quality.drop_summary(dropped.withColumn("g", F.lit(1)), "g").first()["summary"].startswith("chrome:")


def pack(counts, size, overlap):
    """Greedy packing with look-back, said plainly."""
    out, start = [], 0
    while start < len(counts):
        end, total = start, 0
        while end < len(counts) and (end == start or total + counts[end] <= size):
            total += counts[end]
            end += 1
        out.append((start, end))
        if end >= len(counts):
            break
        back, carried = end, 0
        while back - 1 > start and carried + counts[back - 1] <= overlap:
            carried += counts[back - 1]
            back -= 1
        start = back
    return out


def test_packing_against_the_plain_loop(spark):
    import random

    rng = random.Random(0)
    cases = [[rng.randrange(1, 50) for _ in range(rng.randrange(0, 30))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c array<int>")
    got = {r["i"]: [(x["lo"], x["hi"]) for x in r["r"]] for r in df.select("i", chunking.packed_ranges(F.col("c"), 60, 25).alias("r")).collect()}
    assert all(got[i] == pack(c, 60, 25) for i, c in enumerate(cases))


def test_chunks(spark):
    long = " ".join(f"w{i}" for i in range(1000))
    df = spark.createDataFrame([(1, long, "H"), (2, "Short one. " * 30, None), (3, None, "x"), (4, "tiny", "x")], "id int, t string, h string")
    got = chunking.section_chunks(df, "h", "t", size=400, overlap=80).orderBy("id", "chunk_index").collect()
    first = [r["chunk"] for r in got if r["id"] == 1]
    assert len(first) == 3 and all(c.startswith("[H] w") and len(c.split()) <= 401 for c in first)
    assert {r["id"] for r in got} == {1, 2}
    windows = chunking.window_chunks(df, "t").where("id = 1").orderBy("chunk_index").collect()
    assert [len(r["chunk"].split()) for r in windows] == [400, 400, 360, 40]
    assert chunking.first_per_source(df, "h", ["id"], 1).count() == 3


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>var x = 'no';</script></head><body><header><h1>Not this</h1></header><nav><li>" + "menu " * 20 + "</li></nav><h1>Real &amp; title</h1>"
        "<p>" + "Intro sentence of some length. " * 3 + "<p><b>Second</b> paragraph<br>that is never closed and long enough to stay."
        "<h2>Part</h2><ul><li>" + "An item that is long enough to be kept as a block. " + "<li>short</ul><footer><p>" + "foot " * 20 + "</p></footer>"
    )
    row = html.page_sections(spark.createDataFrame([(1, page), (2, None), (3, "<p>x")], "id int, h string"), "id", "h").orderBy("page_id").collect()
    assert row[0]["title"] == "Real & title" and [s["heading"] for s in row[0]["sections"]] == ["Real & title", "Part"]
    assert row[0]["sections"][0]["text"].count("\n") == 1 and "Second paragraph that" in row[0]["sections"][0]["text"]
    assert row[1]["title"] == "Untitled Source" and row[1]["sections"] == [] and row[2]["sections"] == []
    flat = html.page_text(spark.createDataFrame([(1, page), (2, "<aside><p>" + "beside " * 10 + "</aside>"), (3, None)], "id int, h string"), "id", "h").orderBy("page_id").collect()
    assert flat[0]["title"] == "Real & title" and flat[0]["raw_text"].count("\n") == 2 and flat[1]["title"] == "No Title" and flat[1]["raw_text"].startswith("beside") and flat[2]["raw_text"] == ""
    urls = ["http://10.0.0.1/x", "https://93.184.216.34", "ftp://a.b/c", "https://site.example/a", "http://[::1]/", "http://169.254.1.1", "nonsense", None, "http://0.0.0.0"]
    ok = {r["u"]: r["valid"] for r in html.url_check(spark.createDataFrame([(u,) for u in urls], "u string"), "u").collect()}
    assert [u for u in urls if ok[u]] == ["https://93.184.216.34", "https://site.example/a"]
    assert one(spark, "https://x.example/a/b.pdf/", html.url_title) == "b.pdf"


DOCS = [("a", "the cap for visa holders"), ("b", "H-1B cap and H-1B lottery"), ("c", "Form I-983 training plan"), ("d", "the capital ratio of banks"), ("e", None)]


def test_bm25(spark):
    docs = spark.createDataFrame(DOCS, "id string, t string")
    asked = spark.createDataFrame([(1, "H-1B cap"), (2, "Form I-983"), (3, "the capital ratio"), (4, "zzz")], "q int, t string")
    scores = retrieval.bm25_scores(asked, docs, "q", "t", "id", "t")
    first = {r["query_id"]: r["doc_id"] for r in retrieval.ranked(scores).where("rank = 1").collect()}
    assert first == {1: "b", 2: "c", 3: "d"}
    full = retrieval.with_zeros(scores, asked, docs, "q", "id")
    assert full.count() == 20 and full.where("query_id = 4 and score = 0").count() == 5
    tf, avg, df = 2, (5 + 5 + 4 + 5 + 0) / 5, 1
    hand = math.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 5 / avg))
    got = retrieval.bm25_scores(spark.createDataFrame([(1, "H-1B")], "q int, t string"), docs, "q", "t", "id", "t").first()["score"]
    assert got == pytest.approx(hand)
    lexical = retrieval.lexical_scores(asked, docs, "q", "t", "id", "t").where("query_id = 3").collect()
    assert {r["doc_id"]: round(r["score"], 3) for r in lexical} == {"d": round(2 / 3, 3)}


def test_word_scores_in_the_row_and_by_joins(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "H-1B"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(0, 40))) if i % 50 else None) for i in range(400)], "d long, t string").repartition(6)
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=5))) for i in range(9)] + [(99, None), (98, "zzz")], "q int, t string")
    for f in (retrieval.bm25_scores, retrieval.lexical_scores):
        rows = {(r[0], r[1]): r[2] for r in f(asked, docs, "q", "t", "d", "t").collect()}
        top = retrieval.ranked(f(asked, docs, "q", "t", "d", "t", k=3)).where("rank <= 3").select("query_id", "doc_id", "rank").collect()
        assert sorted(map(tuple, top)) == sorted(map(tuple, retrieval.ranked(f(asked, docs, "q", "t", "d", "t")).where("rank <= 3").select("query_id", "doc_id", "rank").collect()))
        monkeypatch.setattr(retrieval, "MOST_TERMS", 0)
        joined = {(r[0], r[1]): r[2] for r in f(asked, docs, "q", "t", "d", "t").collect()}
        monkeypatch.undo()
        assert rows.keys() == joined.keys() and all(abs(rows[k] - joined[k]) < 1e-9 for k in rows)
        assert f(asked, docs.limit(0), "q", "t", "d", "t").count() == 0 and f(asked.limit(0), docs, "q", "t", "d", "t").count() == 0
        named = docs.withColumn("d", F.concat(F.lit("id"), F.col("d").cast("string")))
        assert f(asked, named, "q", "t", "d", "t", k=2).where("doc_id LIKE 'id%'").count() > 10


def test_full_oracle_ranking(spark):
    docs = spark.createDataFrame([(i,) for i in (5, 1, 9, 7)], "doc_id long")
    rel = spark.createDataFrame([(1, 9), (1, 5)], "query_id int, doc_id long")
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieval.oracle_full(docs, rel, asked).collect()}
    assert [got[1, k] for k in (1, 2, 3, 4)] == [5, 9, 1, 7] and [got[2, k] for k in (1, 2, 3, 4)] == [1, 5, 7, 9] and len(got) == 8


def test_cosine(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [2.0, 0.0])]
    v = spark.createDataFrame(rows, "i long, v array<float>")
    got = retrieval.cosine_topk(v.where("i = 1"), v, "i", "v", 4).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["score"], 4)) for r in got] == [(6, 1.0), (3, 0.7071), (2, 0.0), (4, 0.0)]
    pairs = spark.createDataFrame([(1, 3), (1, 4)], "query_id long, doc_id long")
    assert {r["doc_id"]: round(r["score"], 4) for r in retrieval.cosine_of(pairs, v, "i", "v").collect()} == {3: 0.7071, 4: 0.0}


def ranking(spark, ids, run="r"):
    return spark.createDataFrame([(run, 1, d, k + 1) for k, d in enumerate(ids)], "run string, query_id int, doc_id string, rank int")


def test_fusion_and_rerank(spark):
    for k in (0, 1, 60):
        fused = retrieval.reciprocal_rank_fusion([ranking(spark, ["x", "target", "y"]), ranking(spark, ["z", "target", "w"])], k=k)
        top = [r["doc_id"] for r in fused.orderBy("rank").collect()]
        assert top[0] == "target" if k else set(top[:3]) == {"target", "x", "z"}
    with pytest.raises(ValueError):
        retrieval.reciprocal_rank_fusion([ranking(spark, ["x"])], [1.0, 2.0])
    second = spark.createDataFrame([(1, "c", 0.9), (1, "b", 0.5), (1, "d", 1.0)], "query_id int, doc_id string, score double")
    out = retrieval.rerank_pool(ranking(spark, ["a", "b", "c", "d"]), second, 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in out] == ["c", "b", "a", "d"]


def test_registered_fusions_use_whole_rankings(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 60)))) for i in range(300)]
    asked = [(100 * i, " ".join(rng.choices(words, k=6))) for i in range(1, 7)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "feedback_id long, question string").write.parquet(f"{tmp_path}/feedback_log.parquet")
    bm25, lexical = ({(r.query_id, r.doc_id): r for r in f(spark, str(tmp_path)).collect()} for f in (registered._bm25, registered._lexical))
    assert max(r["rank"] for r in bm25.values()) > 150
    for name, weights in (("rrf_fuse", (1.0, 1.0)), ("rrf_weighted", (2.0, 0.5))):
        want = set()
        for q, _ in asked:
            ranks = {i: [r[q, i]["rank"] if (q, i) in r else None for r in (bm25, lexical)] for i, _ in docs}
            score = {i: sum(w / (60 + r) for w, r in zip(weights, own) if r) for i, own in ranks.items() if any(own)}
            best = sorted(score, key=lambda i: (-round(score[i], 9), min(r for r in ranks[i] if r), str(i)))
            want |= {(q, i, round(score[i], 6), k + 1) for k, i in enumerate(best[:20])}
        assert {tuple(r) for r in registered.queries()[name](spark, str(tmp_path)).collect()} == want
    out = {(r.query_id, r.doc_id): (r.first_rank, r["rank"]) for r in registered.queries()["pool_rerank"](spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in out.items()} == {k: r["rank"] for k, r in bm25.items()}
    assert all(a == b if a > 15 else b <= 15 for a, b in out.values())


def test_diversity(spark):
    texts = {"a": "visa cap lottery rules", "b": "visa cap lottery rule", "c": "bank capital ratio", "d": "visa cap lottery rules"}
    rows = [(1, d, k + 1, s, texts[d]) for k, (d, s) in enumerate([("a", 1.0), ("d", 0.95), ("b", 0.9), ("c", 0.2)])]
    df = spark.createDataFrame(rows, "query_id int, doc_id string, rank int, score double, text string")
    order = lambda trade, k=3: [r["doc_id"] for r in diversity.mmr(df, k=k, trade=trade).orderBy("pos").collect()]
    assert order(0.5) == ["a", "b", "c"] and order(1.0) == ["a", "d", "b"] and order(0.95) == ["a", "d", "b"] and order(0.5, 0) == []
    assert len(order(0.5, 9)) == 4
    got = diversity.mmr(df, k=2, trade=0.5).orderBy("pos").collect()
    assert got[0]["max_redundancy"] == 0.0 and got[0]["mmr_score"] == 0.5
    same = diversity.mmr(df, k=2, trade=0.5, similarity=lambda a, b: F.lit(0.0))
    assert [r["doc_id"] for r in same.orderBy("pos").collect()] == ["a", "d"]


def test_retrieval_metrics(spark):
    rel = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, doc_id string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    runs = ranking(spark, ["a", "x", "b"]).unionByName(retrieval.oracle_ranking(spark.createDataFrame([("x",), ("y",)], "doc_id string"), rel).withColumn("run", F.lit("oracle")))
    per = evaluation.per_query_metrics(runs, rel, asked)
    row = per.where("run = 'r' and query_id = 1").first()
    assert row["mrr"] == 0.5 and row["ndcg_3"] == pytest.approx(1 / math.log2(3)) and row["hit_1"] == 0 and row["precision_5"] == 0.2 and row["recall_3"] == 1
    assert per.where("run = 'oracle' and query_id < 3").agg(F.min("mrr"), F.min("ndcg_5")).first() == (1.0, 1.0)
    means = {r["run"]: r for r in evaluation.against_previous(evaluation.mean_metrics(per)).collect()}
    assert means["r"]["queries"] == 3 and means["oracle"]["mrr"] == 0.6667 and means["r"]["mrr_delta"] == pytest.approx(0.1667 - 0.6667)
    assert "| Run |" in reports.rankers([m.asDict() for m in means.values()], (1, 3)) and "MRR" in reports.single_ranker(means["r"].asDict(), (1,))
    review = evaluation.ranking_review(ranking(spark, ["a", "x", "b"]), rel).collect()
    assert [(r["query_id"], r["gold_rank"], r["beaten_by"]) for r in review] == [(1, 2, ["a", "b"])]
    assert evaluation.dangling(rel, spark.createDataFrame([("x",)], "doc_id string")).count() == 1


def test_verdicts(spark):
    v = spark.createDataFrame([(1, 0, "entailed"), (1, 0, "Contradicted "), (2, 0, "baseless"), (2, 0, "entailed"), (3, 0, "odd")], "a int, c int, v string")
    assert {r["a"]: r["verdict"] for r in verification.over_windows(v, ["a", "c"], "v").collect()} == {1: "contradicted", 2: "entailed", 3: "baseless"}
    answers = spark.createDataFrame([(1,), (2,), (3,), (4,)], "a int")
    assert {r["a"]: r["verdict"] for r in verification.over_claims(answers, v, "a", "v").collect()} == {1: "contradicted", 2: "baseless", 3: "baseless", 4: "baseless"}
    raw = (
        '[{"claim_index": 0, "window_verdicts": [], "evidence": "e0"}, {"claim_index": "1", "window_verdicts": ["Entailed"], "evidence": "first"}, "odd", 7,'
        ' {"claim_index": 1, "window_verdicts": ["entailed", "contradicted"], "evidence": "a \\"q\\"", "source_title": "T"}, {"claim_index": "x", "window_verdicts": ["entailed"]},'
        ' {"claim_index": 9, "window_verdicts": ["entailed"]}, {"claim_index": 2, "window_verdicts": "entailed"}, {"claim_index": 3, "window_verdicts": ["Entailed "], "evidence": "kept", "source_title": "U"}]'
    )
    rows = [(1, raw), (2, f"```json\n{raw}\n```"), (3, '{"claim_index": 0}'), (4, "nonsense"), (5, None)]
    df = spark.createDataFrame(rows, "k int, j string").withColumn("claims", F.array(*map(F.lit, ["c0", "c1", "c2", "c3"])))
    got = {r["k"]: [(x["verdicts"], x["verdict"], x["evidence"], x["source_title"]) for x in r["v"]] for r in df.select("k", verification.local_verdicts(F.col("claims"), "j").alias("v")).collect()}
    nothing = (["baseless"], "baseless", "", "")
    assert got[1] == got[2] == [(["baseless"], "baseless", "e0", ""), (["entailed", "contradicted"], "contradicted", 'a "q"', "T"), nothing, (["entailed"], "entailed", "kept", "U")]
    assert got[3] == got[4] == got[5] == [nothing] * 4
    second = '[{"claim_index": 0, "verdict": "Entailed", "evidence": "found"}, {"claim_index": 1, "verdict": "odd", "evidence": "gone", "source_title": "T"}, {"claim_index": 3, "verdict": "contradicted", "evidence": "no"}]'
    one_row = df.where("k = 1").withColumn("first", verification.local_verdicts(F.col("claims"), "j")).withColumn("second", F.lit(second))
    r = one_row.select(verification.unresolved(F.col("first")).alias("u"), verification.final_verdicts(F.col("claims"), F.col("first"), "second").alias("f")).first()
    assert r["u"] == [0, 1, 2]
    assert [tuple(x) for x in r["f"]] == [("c0", "entailed", "found", ""), ("c1", "baseless", "", ""), ("c2", "baseless", "", ""), ("c3", "entailed", "kept", "U")]
    none = one_row.select(verification.final_verdicts(F.array().cast("array<string>"), F.col("first"), "second").alias("f")).first()["f"]
    assert none == []
    local = spark.createDataFrame([(1, "baseless", "e", "s"), (2, "entailed", "f", "s"), (3, "contradicted", "g", "s"), (4, "baseless", "h", "s")], "k int, verdict string, evidence string, source_title string")
    later = spark.createDataFrame([(1, "entailed", None, "t"), (2, "contradicted", "z", "t")], "k int, verdict string, evidence string, source_title string")
    out = {r["k"]: (r["verdict"], r["evidence"], r["source_title"]) for r in verification.with_global(local, later, ["k"]).collect()}
    assert out == {1: ("entailed", None, "t"), 2: ("entailed", "f", "s"), 3: ("contradicted", "g", "s"), 4: ("baseless", "", "")}
    with pytest.raises(ValueError):
        verification.verifier("other")


def test_classification(spark):
    rows = [("entailed", "entailed"), ("entailed", "baseless"), ("baseless", "entailed"), ("contradicted", "contradicted"), ("odd", "odd")]
    pairs = spark.createDataFrame(rows, "gold string, pred string")
    per = {r["label"]: r for r in verification.class_metrics(pairs).collect()}
    assert (per["entailed"]["precision"], per["entailed"]["recall"], per["entailed"]["f1"]) == (0.5, 0.5, 0.5) and per["baseless"]["f1"] == 0
    cells = verification.confusion(pairs).collect()
    assert len(cells) == 9 and sum(c["n"] for c in cells) == 4
    overall = verification.overall_metrics(pairs).first()
    assert overall["accuracy"] == 0.6 and overall["macro_f1"] == 0.5
    assert "Accuracy 0.600" in reports.classification([r.asDict() for r in per.values()], overall.asDict(), [c.asDict() for c in cells])
    assert verification.overall_metrics(pairs.limit(0)).count() == 1 and verification.too_few(pairs).count() == 4


def test_audit(spark):
    log = spark.createDataFrame([(i, q, lv) for i, (q, lv) in enumerate([("a", "Low"), (" a", " Low "), ("b", "Medium"), (None, "High"), ("  ", None)])], "id int, q string, lv string")
    s = audit.risk_stats(log, "lv").first()
    assert (s["total"], s["low"], s["grounded_pct"]) == (4, 2, 50.0)
    assert audit.risk_stats(log.limit(0), "lv").first()["grounded_pct"] is None
    assert [(r["question"], r["n"]) for r in audit.top_questions(log, "q", 2).collect()] == [("a", 2), ("b", 1)]
    times = spark.sql("SELECT id, timestamp_seconds(id * 1800) AS t, 'K ' || (id % 2) AS q FROM range(8)").unionByName(spark.sql("SELECT 99L AS id, CAST(NULL AS TIMESTAMP) AS t, 'k 0' AS q"))
    # an entry is still found at the very second it expires
    assert [r["hit"] for r in audit.cache_hits(times, "q", "t").where("key = 'k 0'").orderBy("at").collect()] == [False, True, False, True]
    assert [r["hit"] for r in audit.cache_hits(times, "q", "t", ttl=3599).where("key = 'k 0'").orderBy("at").collect()] == [False] * 4
    assert [r["hit"] for r in audit.cache_hits(times, "q", "t", ttl=3601).where("key = 'k 0'").orderBy("at").collect()] == [False, True, False, True]
    assert audit.cache_stats(audit.cache_hits(times, "q", "t", ttl=3601)).first()["hit_rate"] == 0.5
    page = audit.page_of(times, "id", "t", 2, 3).orderBy("pos").collect()
    assert [r["id"] for r in page] == [4, 3, 2] and page[0]["pages"] == 3
    trace = audit.lru_trace(spark.createDataFrame([(i, k) for i, k in enumerate("abacb")], "i int, k string"), "k", ["i"], size=2).orderBy("seq").collect()
    assert [(r["hit"], r["evicted"]) for r in trace] == [(False, None), (False, None), (True, None), (False, "b"), (False, "a")]


def test_cache_of_bounded_size_and_age(spark):
    """Against the plain loop over one ordered dictionary, cut into several segments."""
    from collections import OrderedDict

    rng = random.Random(12)
    log, at = [], 0
    for i in range(3000):
        at += rng.choice([0, 0, 1, 1, 2, 9])
        log.append((i, at, f"k{int(rng.paretovariate(0.6))}" if rng.random() < 0.9 else None))
    df = spark.createDataFrame(log, "i int, at long, k string").repartition(5)
    for size, ttl in ((1, None), (7, None), (7, 20.0), (40, 60.0), (5000, 3.0)):
        data, want = OrderedDict(), []
        for _, at, k in log:
            expires = data.get(k)
            hit = k in data and (ttl is None or expires >= at)
            if not hit:
                data[k] = at + (ttl or 0)
            data.move_to_end(k)
            gone = data.popitem(last=False)[0] if len(data) > size else None
            want.append((k, hit, gone))
        got = audit.lru_trace(df, "k", ["i"], size=size, ttl=ttl, time_col="at").orderBy("seq").collect()
        assert [(r["key"], r["hit"], r["evicted"]) for r in got] == want and [r["seq"] for r in got] == list(range(1, 3001))
    assert audit.lru_trace(df.limit(0), "k", ["i"], size=2).count() == 0


def test_cached_values_and_report(spark):
    log = spark.sql("SELECT id, timestamp_seconds(id * 10) AS t, IF(id = 3, NULL, ' A') AS q FROM range(6)")
    cache = spark.createDataFrame([("a", "old", 0.0), ("a", "new", 25.0), ("b", "x", 0.0)], "key string, value string, set_at double")
    value = lambda **o: [r["value"] for r in audit.cached_values(log, cache, "q", "t", **o).orderBy("id").collect()]
    assert value(ttl=15.0) == ["old", "old", None, None, "new", None] and value(ttl=None) == ["old", "old", "old", None, "new", "new"]
    assert value(ttl=15.0, cleared=F.lit(20.0)) == [None, None, None, None, "new", None]
    r = audit.log_report(log, "id", "t", "q", 2).first()
    assert (r["count"], r["returned"], [x["id"] for x in r["logs"]], [tuple(x) for x in r["top_questions"]]) == (6, 2, [5, 4], [("A", 5)])
    empty = audit.log_report(log.limit(0), "id", "t", "q").first()
    assert (empty["count"], empty["returned"], empty["logs"], empty["top_questions"]) == (0, 0, [], [])


def test_catalog(spark):
    cols = "source_title string, source_url string, chunk_text string"
    old = spark.createDataFrame([("t", "u1", "a"), ("t", "u1", "b"), ("t", "u2", "c"), ("t", None, "d")], cols)
    new = spark.createDataFrame([("n", "u1", "z"), ("n", "u3", "y"), ("n", None, "x")], cols)
    store, report = catalog.refresh_sources(old, new)
    assert sorted(r["chunk_text"] for r in store.collect()) == ["c", "d", "x", "y", "z"]
    assert {r["source_url"]: (r["inserted"], r["deleted"], r["refreshed"]) for r in report.collect()} == {"u1": (1, 2, True), "u3": (1, 0, False)}
    docs = spark.createDataFrame([(1, 1, "t", "u"), (1, 2, None, "v"), (1, 3, "w", "u"), (1, 4, "w", "")], "query_id int, rank int, source_title string, source_url string")
    assert [(r["source_url"], r["source_title"], r["pos"]) for r in retrieval.unique_sources(docs).orderBy("pos").collect()] == [("u", "t", 1), ("v", "Untitled Source", 2)]
    assert catalog.sample_rows(old, "chunk_text", 2).collect() == catalog.sample_rows(old, "chunk_text", 2).collect()


def test_learning(spark, tmp_path):
    rows = spark.range(400).selectExpr("id", "CAST(id % 2 AS INT) AS label", "CAST(id % 2 + rand(1) AS DOUBLE) AS a", "rand(2) AS b")
    uneven = spark.range(403).selectExpr("id", "IF(id % 7 = 0, 1, 0) AS label")
    parts = {r["label"]: (r["n"], r["h"]) for r in learning.split_by_class(uneven, "id", "label").groupBy("label").agg(F.count("*").alias("n"), F.count_if("held_out").alias("h")).collect()}
    assert parts == {1: (58, 15), 0: (345, 86)} and learning.split_by_class(uneven.limit(0), "id", "label").count() == 0
    split = learning.split_by_class(rows, "id", "label")
    model = learning.quality_model(split.where("NOT held_out"), "label", ("a", "b"))
    scored = learning.predict_quality(model, split.where("held_out"), ("a", "b"))
    assert learning.auc(scored, "label", "quality").first()[0] > 0.95
    m = learning.binary_metrics(scored, "label", "quality").first()
    assert m["accuracy"] > m["majority"] and learning.coefficients(model, ("a", "b"))[0][0] == "a"
    report = learning.training_report(rows, "id", "label", ("a", "b"), path=str(tmp_path / "model")).first()
    assert (report["n"], report["n_train"], report["n_test"]) == (400, 300, 100) and report["roc_auc"] > 0.95 and report["cv_auc_mean"] > 0.95 and 0 <= report["cv_auc_std"] < 0.1
    assert report["tp"] + report["fp"] + report["fn"] + report["tn"] == 100
    from pyspark.ml import PipelineModel

    saved = PipelineModel.load(str(tmp_path / "model"))
    assert learning.predict_quality(saved, rows, ("a", "b")).count() == 400
    trees = learning.quality_model(split.where("NOT held_out"), "label", ("a", "b"), trees=True)
    assert learning.auc(learning.predict_quality(trees, split.where("held_out"), ("a", "b")), "label", "quality").first()[0] > 0.95
    assert learning.coefficients(trees, ("a", "b"))[0][0] == "a"
    assert "Accuracy" in reports.quality(m.asDict(), learning.coefficients(model, ("a", "b")))
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, s double")
    assert learning.auc(ties, "label", "s").first()[0] == 0.875
    good = learning.answer_features(
        spark.createDataFrame([("I could not verify this", None, ["Entailed", "odd"])], "a string, s int, v array<string>"),
        score=F.col("s"), risk=F.lit(None).cast("int"), level=F.lit("low"), contexts=F.lit(None).cast("int"), verdicts=F.col("v"), sources=F.lit(3), answer="a",
    ).first()
    assert [good[f] for f in learning.FEATURES] == [2, 0, 3, 2, 1, 0, 0, 0.5, 3, 5, 1]


def test_pipelines(spark):
    body = "<h1>Fees</h1><p>" + "The office keeps the record of each fee for three years. It is shown on request. " * 3
    pages = spark.createDataFrame([(1, "u1", body), (2, "u2", "<p>short")], "id int, url string, html string")
    store = spark.createDataFrame([("k", "old", "u1", 0, "gone")], "chunk_id string, source_title string, source_url string, chunk_index int, chunk_text string")
    new, report = ingest(pages, "id", "url", "html", store)
    assert [(r["source_title"], r["chunk_text"][:7]) for r in new.collect()] == [("Fees", "[Fees] ")] and report.first()["refreshed"]
    docs = spark.createDataFrame([(i, "T", t) for i, (_, t) in enumerate(DOCS)], "id int, title string, t string")
    out = retrieve(spark.createDataFrame([(1, "H-1B cap"), (2, "zzz")], "q int, t string"), docs, "q", "t", "id", "title", "t").collect()
    assert len(out) == 1 and out[0]["prompt"].startswith("Source: T\nText: H-1B cap")


def test_sources(spark, tmp_path):
    (tmp_path / "f.csv").write_text('question,answer,feedback,corrected_answer,timestamp\nq,"two\nlines ""x""",Correct,,2020-01-01 00:00:00\n')
    row = tables.read_csv(spark, str(tmp_path / "f.csv"), tables.FEEDBACK).first()
    assert row["answer"] == 'two\nlines "x"' and row["corrected_answer"] is None
    (tmp_path / "q.jsonl").write_text('{"id": "1", "query": "x", "relevant_ids": ["a"]}\n\n{"id": "2"}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "q.jsonl"), tables.QRELS).count() == 2
    tables.append_feedback(spark.createDataFrame([row], tables.FEEDBACK), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).first()["corrected_answer"] == ""
    assert tables.first_available(spark, tables.FEEDBACK, str(tmp_path / "none"), str(tmp_path / "f.csv")).count() == 1
    assert tables.first_available(spark, tables.AUDIT, str(tmp_path / "none")).count() == 0
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    with pytest.raises(ValueError):
        tables.append_chunks(chunks, chunks.where("id = 1").select("id", F.array(F.lit(0.5)).alias("e")), "id", str(tmp_path / "v"))
    tables.append_chunks(chunks, chunks.select("id", F.array(F.lit(0.5)).alias("e")), "id", str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    tables.write_report(chunks, str(tmp_path / "r.json"), "# r", str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text() == "# r"
    assert tables.latest(chunks, "id", 1).first()["id"] == 2


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT id, timestamp_seconds(1000000800 + id * 1200) AS t, 'Q ' || (id % 2) AS q, IF(id % 3 = 0, ' Low', 'High') AS lv FROM range(12)")
    rows.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    logs.append_audit(read(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    q = logs.risk_counts(read(), "t", "lv").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 12 and spark.table("counts").count() == 8
    q = logs.cached_answers(read(), "q", "t").writeStream.format("memory").queryName("hits").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["key"], r["hit"]): r["n"] for r in spark.table("hits").groupBy("key", "hit").agg(F.count("*").alias("n")).collect()} == {("q 0", False): 3, ("q 0", True): 3, ("q 1", False): 3, ("q 1", True): 3}


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


def test_stream_cache_keeps_no_rows_in_the_driver(spark):
    before = {t.name for t in spark.catalog.listTables()}
    out = registered.queries()["stream_cache"](spark, "/root/testdata/sf0.001")
    assert {t.name for t in spark.catalog.listTables()} == before  # a memory sink leaves a table
    assert out.agg(F.sum("accesses")).first()[0] == registered._accesses(spark, "/root/testdata/sf0.001").count()


def test_cached_answers_over_batches(spark, tmp_path):
    times = {"a": [0, 3600, 3601, 9000], "b": [10, 20, 7300, 50000]}
    rows = spark.createDataFrame([(k, float(t)) for k in times for t in times[k]], "q string, s double").select("q", F.timestamp_seconds(F.col("s") + 1_000_000_000).alias("t"))
    for part in ("s <= 20", "s > 20 AND s < 8000", "s >= 8000"):  # a run each, over the same state
        rows.withColumn("s", F.unix_timestamp("t") - 1_000_000_000).where(part).select("q", "t").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        logs.append_audit(logs.cached_answers(stream, "q", "t"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r["key"], r["at"] - 1_000_000_000, r["hit"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [
        ("a", 0, False), ("a", 3600, True), ("a", 3601, False), ("a", 9000, False),
        ("b", 10, False), ("b", 20, True), ("b", 7300, False), ("b", 50000, False),
    ]
