"""The registered queries as DuckDB SQL over the same tables, for those that SQL can state."""

from __future__ import annotations

from ..functions.text import ABBREVIATIONS, DENIAL, IDENT_TOKEN, PLAIN_TOKEN, RETRIEVAL_STOP, SPACE, VERIFY_STOP
from ..operators.quality import CHROME, CITATION


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_q, items)) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(x: str) -> str:
    return f"coalesce(list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> ''), [])"


def norm(x: str) -> str:
    return strip(f"regexp_replace(lower({x}), '{SPACE}+', ' ', 'g')")


def ident(x: str) -> str:
    return f"coalesce(regexp_extract_all(lower({x}), '{IDENT_TOKEN}'), [])"


def plain(x: str) -> str:
    return f"list_distinct(coalesce(regexp_extract_all(lower({x}), '{PLAIN_TOKEN}'), []))"


def content(x: str, stop) -> str:
    return f"list_filter({plain(x)}, lambda w: NOT list_contains({_list(stop)}, w))"


def sents(x: str) -> str:
    """Sentences: dots of abbreviations are hidden before the cut."""
    hidden = f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}_])(U\\.S|{ABBREVIATIONS})\\.', '\\1\\2' || chr(57344), 'g')"
    cut = f"regexp_replace({hidden}, '([.!?])({SPACE}+)', '\\1' || chr(57345), 'g')"
    parts = f"list_transform(string_split({cut}, chr(57345)), lambda s: {strip('replace(s, chr(57344), chr(46))')})"
    return f"coalesce(list_filter({parts}, lambda s: s <> ''), [])"


def _scored() -> str:
    """BM25 scores ``bs`` of ``docs`` for ``asked``."""
    return f"""
    qi AS (SELECT query_id, unnest({ident('q_text')}) AS term FROM asked),
    di AS (SELECT doc_id, unnest({ident('text')}) AS term FROM docs),
    rel AS (SELECT DISTINCT query_id, doc_id FROM qi JOIN di USING (term) WHERE regexp_matches(term, '[0-9]')),
    dl AS (SELECT doc_id, len({ident('text')}) AS n FROM docs),
    st AS (SELECT count(*) AS nd, avg(n) AS an FROM dl),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM di GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
    qt AS (SELECT query_id, term, count(*) AS qtf FROM qi GROUP BY ALL),
    bs AS (
      SELECT query_id, doc_id, sum(qtf * ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / an))) AS score
      FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL
    )"""


def _common(which: str = "feedback_id % 100 = 0 AND ") -> str:
    return f"""
    asked AS (SELECT feedback_id AS query_id, question AS q_text FROM feedback_log WHERE {which}question IS NOT NULL),
    docs AS (SELECT doc_id, text FROM documents),
{_scored()},
    bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bs),
    ql AS (SELECT query_id, {content('q_text', RETRIEVAL_STOP)} AS t FROM asked),
    dt AS (SELECT doc_id, {content('text', RETRIEVAL_STOP)} AS t FROM docs),
    qu AS (SELECT query_id, len(t) AS nq, unnest(t) AS term FROM ql),
    du AS (SELECT doc_id, len(t) AS nd, unnest(t) AS term FROM dt),
    ls AS (SELECT query_id, doc_id, count(*)::DOUBLE / (nq + nd - count(*)) AS score FROM qu JOIN du USING (term) GROUP BY query_id, doc_id, nq, nd),
    lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ls)"""


def _fused(wa: float, wb: float) -> str:
    return f"""
    fs AS (
      SELECT query_id, doc_id, sum(w / (60 + rank)) AS score, min(rank) AS best FROM (
        SELECT query_id, doc_id, rank, {wa}::DOUBLE AS w FROM bm25 UNION ALL SELECT query_id, doc_id, rank, {wb}::DOUBLE FROM lexical
      ) GROUP BY ALL
    ),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, best, doc_id::VARCHAR) AS rank FROM fs)"""


_RERANKED = """
    rp AS (
      SELECT b.query_id, b.doc_id, b.rank AS first_rank, l.score AS second, CASE WHEN b.rank <= 15 THEN 0 ELSE 1 END AS inside
      FROM bm25 b LEFT JOIN lexical l USING (query_id, doc_id)
    ),
    reranked AS (
      SELECT query_id, doc_id, first_rank, row_number() OVER (
        PARTITION BY query_id ORDER BY inside, CASE WHEN inside = 0 THEN round(second, 9) END DESC NULLS LAST, first_rank) AS rank FROM rp
    )"""


def _runs(which: str = "feedback_id % 100 = 0 AND ") -> str:
    return f"""{_common(which)}, {_fused(1, 1)}, {_RERANKED},
    oracle AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM rel),
    runs AS (
      SELECT '1_lexical' AS run, query_id, doc_id, rank FROM lexical UNION ALL SELECT '2_bm25', query_id, doc_id, rank FROM bm25
      UNION ALL SELECT '3_fused', query_id, doc_id, rank FROM fused UNION ALL SELECT '4_reranked', query_id, doc_id, rank FROM reranked
      UNION ALL SELECT '5_oracle', query_id, doc_id, rank FROM oracle
    ),
    nr AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY ALL),
    hit AS (
      SELECT run, query_id, min(rank) AS first, {', '.join(f"count(*) FILTER (rank <= {k}) AS n{k}, sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) END) AS g{k}" for k in (1, 3, 5))}
      FROM runs JOIN rel USING (query_id, doc_id) GROUP BY ALL
    ),
    per AS (
      SELECT run, query_id, coalesce(1.0::DOUBLE / first, 0) AS mrr, {', '.join(
        f"(coalesce(n{k}, 0) > 0)::INT::DOUBLE AS hit_{k}, coalesce(n{k}::DOUBLE / n_rel, 0) AS recall_{k}, coalesce(n{k}, 0)::DOUBLE / {k} AS precision_{k}, "
        f"coalesce(g{k} / list_sum(list_transform(range(1, least(n_rel, {k}) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg_{k}" for k in (1, 3, 5))}
      FROM (SELECT run, query_id FROM (SELECT unnest(['1_lexical', '2_bm25', '3_fused', '4_reranked', '5_oracle']) AS run) CROSS JOIN (SELECT query_id FROM asked)) LEFT JOIN nr USING (query_id) LEFT JOIN hit USING (run, query_id)
    )"""


_METRICS = ["mrr", *(f"{m}_{k}" for k in (1, 3, 5) for m in ("hit", "recall", "precision", "ndcg"))]


def _mmr(trade: float, extra: str = "", pool: str = "bm25 JOIN docs USING (doc_id) WHERE rank <= 15", ends: str = "", alike: str = "(len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))") -> str:
    """Diversified order of ``pool``; ``extra`` CTEs come before it and ``ends`` after the result ``r``, in place of the plain one."""
    usual = "SELECT query_id, doc_id, pos::INT AS pos, round(v, 4) AS mmr_score, round(red, 4) AS max_redundancy FROM r WHERE pos > 0"
    return f"""WITH RECURSIVE {_common()},{extra}
    p AS (
      SELECT query_id, doc_id, rank - 1 AS i, {plain('text')} AS t, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE
        ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS rel
      FROM {pool} WINDOW w AS (PARTITION BY query_id)
    ),
    sim AS (
      SELECT a.query_id, a.i, list(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0.0::DOUBLE
        ELSE len(list_intersect(a.t, b.t))::DOUBLE / {alike} END ORDER BY b.i) AS s
      FROM p a JOIN p b USING (query_id) GROUP BY ALL
    ),
    c AS (SELECT p.query_id, p.doc_id, p.i, p.rel, sim.s FROM p JOIN sim USING (query_id, i)),
    r AS (
      SELECT DISTINCT query_id, 0 AS pos, []::BIGINT[] AS got, NULL::BIGINT AS doc_id, NULL::DOUBLE AS v, NULL::DOUBLE AS red FROM c
      UNION ALL
      SELECT query_id, pos + 1, list_append(got, i), doc_id, v, red FROM (
        SELECT r.query_id, r.pos, r.got, c.i, c.doc_id, coalesce(list_max(list_transform(r.got, lambda j: c.s[j + 1])), 0) AS red,
          round({trade}::DOUBLE * c.rel - (1 - {trade}::DOUBLE) * coalesce(list_max(list_transform(r.got, lambda j: c.s[j + 1])), 0), 9) AS v,
          row_number() OVER (PARTITION BY r.query_id ORDER BY round({trade}::DOUBLE * c.rel - (1 - {trade}::DOUBLE) * coalesce(list_max(list_transform(r.got, lambda j: c.s[j + 1])), 0), 9) DESC, c.i) AS rn
        FROM r JOIN c ON r.query_id = c.query_id AND NOT list_contains(r.got, c.i) WHERE r.pos < 6
      ) WHERE rn = 1
    )
    {ends or usual}"""


def _packed(size: int, overlap: int, columns: str, source: str = "rag_chunks", before: str = "") -> str:
    """Chunks by sentence packing: one recursive row per range of sentences."""
    return f"""WITH RECURSIVE {before}
    sn AS (SELECT {columns}, {sents('chunk_text')} AS ss FROM {source}),
    sl AS (
      SELECT {columns}, flatten(list_transform(ss, lambda s: CASE WHEN len({words('s')}) > {size}
        THEN list_transform(range(0, len({words('s')}), {size}), lambda i: array_to_string(({words('s')})[i + 1 : i + {size}], ' ')) ELSE [s] END)) AS ss FROM sn
    ),
    pr AS (SELECT *, len(ss) AS n, list_transform(range(0, len(ss) + 1), lambda k: coalesce(list_sum(list_transform(ss[1:k], lambda s: len({words('s')}))), 0)) AS p FROM sl WHERE len(ss) > 0),
    rg AS (
      SELECT chunk_id, 0 AS k, 0::BIGINT AS st, greatest(1, len(list_filter(p, lambda x: x <= {size})) - 1) AS e FROM pr
      UNION ALL
      SELECT chunk_id, k + 1, nx, greatest(nx + 1, len(list_filter(p, lambda x: x <= p[nx + 1] + {size})) - 1) FROM (
        SELECT rg.chunk_id, rg.k, pr.p, greatest(rg.st + 1, len(list_filter(pr.p, lambda x: x < pr.p[rg.e + 1] - {overlap}))) AS nx FROM rg JOIN pr USING (chunk_id) WHERE rg.e < pr.n
      )
    ),
    ck AS (SELECT {columns}, k, {strip("array_to_string(ss[st + 1 : e], ' ')")} AS chunk FROM rg JOIN pr USING (chunk_id)),
    packed AS (SELECT {columns}, (row_number() OVER (PARTITION BY chunk_id ORDER BY k) - 1)::INT AS chunk_index, chunk FROM ck WHERE length(chunk) > 50)"""


def _signals(source: str, p: str = "") -> str:
    """The prose filter's signals ``s`` of the texts of ``source``; ``p`` leads the names of the CTEs."""
    return f"""
    {p}w AS (SELECT *, len({words('chunk_text')}) AS words, regexp_replace(lower(chunk_text), '{SPACE}+', ' ', 'g') AS low FROM {source}),
    {p}d AS (
      SELECT *, CASE WHEN words > 0 THEN len(regexp_extract_all(chunk_text, {_q(CITATION)}))::DOUBLE / words ELSE 0 END AS citation_density,
        CASE WHEN words > 0 THEN len(regexp_extract_all(chunk_text, '[.!?](?:{SPACE}|$)')) * 100::DOUBLE / words ELSE 0 END AS sentence_density,
        list_filter({_list(CHROME)}, lambda p: contains(low, p)) AS chrome FROM {p}w
    ),
    {p}s AS (
      SELECT *, list_filter([CASE WHEN words = 0 THEN 'empty' END, CASE WHEN words > 0 AND len(chrome) > 0 THEN 'chrome:' || chrome[1] END,
        CASE WHEN words >= 40 AND citation_density > 0.08::DOUBLE THEN 'citations:' || printf('%.3f', citation_density) END,
        CASE WHEN words >= 40 AND sentence_density < 1.2::DOUBLE THEN 'fragmented:' || printf('%.2f', sentence_density) END], lambda x: x IS NOT NULL) AS reasons FROM {p}d
    )"""


_SIGNALS = _signals("rag_chunks")


def _ingest() -> str:
    """Pages of one heading: prose lines packed, led by the heading, filtered again, capped, and held against the store."""
    lines = f"""
    ln AS (
      SELECT chunk_id, source_url, source_title, i, {strip('x')} AS chunk_text
      FROM (SELECT chunk_id, source_url, source_title, unnest(string_split(chunk_text, chr(10))) AS x, generate_subscripts(string_split(chunk_text, chr(10)), 1) AS i FROM rag_chunks WHERE chunk_text IS NOT NULL)
    ),{_signals('ln', 'l')},
    pg AS (SELECT chunk_id, coalesce(source_url, '') AS source_url, {strip("coalesce(source_title, '')")} AS head, string_agg(chunk_text, chr(10) ORDER BY i) AS chunk_text FROM ls
      WHERE length(chunk_text) > 40 AND len(reasons) = 0 GROUP BY ALL),"""
    return f"""{_packed(400, 80, 'chunk_id, source_url, head', 'pg', lines)},
    led AS (SELECT chunk_id, source_url, CASE WHEN head <> '' THEN '[' || head || '] ' || chunk ELSE chunk END AS chunk_text, chunk_index FROM packed),{_signals('led', 'h')},
    ok AS (SELECT source_url, chunk_id FROM hs WHERE len(reasons) = 0 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_index) <= 300),
    n AS (SELECT source_url, count(*) AS inserted FROM ok GROUP BY ALL),
    o AS (SELECT source_url, count(*) AS d FROM rag_chunks GROUP BY ALL)
    SELECT n.source_url, inserted, coalesce(d, 0) AS deleted, coalesce(d, 0) > 0 AS refreshed FROM n LEFT JOIN o ON n.source_url = o.source_url"""


_BODY = strip("regexp_replace(" + strip("hallucination_analysis") + ", '^```(?:json)?|```$', '', 'g')")
_ANALYSIS = f"""
    b AS (SELECT id, risk_level, answer, hallucination_analysis AS raw, {_BODY} AS body FROM audit_logs),
    a AS (
      SELECT id, risk_level, answer, CASE WHEN raw IS NULL THEN NULL WHEN starts_with(body, '{{') AND ends_with(body, '}}')
          THEN try_cast(nullif(regexp_extract(body, '["'']hallucination_score["'']\\s*:\\s*(-?\\d+)', 1), '') AS INT) END AS score,
        CASE WHEN raw IS NULL THEN NULL WHEN starts_with(body, '{{') AND ends_with(body, '}}')
          THEN regexp_replace(regexp_replace(nullif(regexp_extract(body, '["'']reason["'']\\s*:\\s*(?:"((?:[^"\\\\]|\\\\.)*)"|''((?:[^''\\\\]|\\\\.)*)'')', 0), ''),
            '^["'']reason["'']\\s*:\\s*["'']|["'']$', '', 'g'), '\\\\(["''\\\\])', '\\1', 'g')
          ELSE {strip('raw')} END AS reason FROM b
    )"""

_JUDGED = f"""{_ANALYSIS},
    j AS (
      SELECT CASE lower({strip('risk_level')}) WHEN 'low' THEN 'entailed' WHEN 'medium' THEN 'baseless' WHEN 'high' THEN 'contradicted' ELSE 'none' END AS gold,
        CASE score WHEN 0 THEN 'entailed' WHEN 1 THEN 'baseless' WHEN 2 THEN 'contradicted' ELSE 'none' END AS pred FROM a
    ),
    lb AS (SELECT unnest(['entailed', 'baseless', 'contradicted']) AS label),
    cm AS (
      SELECT label, count(*) FILTER (gold = label AND pred = label)::DOUBLE AS tp, count(*) FILTER (pred = label) AS np, count(*) FILTER (gold = label) AS ng FROM lb, j GROUP BY label
    ),
    pr AS (SELECT label, coalesce(tp / nullif(np, 0), 0) AS p, coalesce(tp / nullif(ng, 0), 0) AS r, ng FROM cm),
    prf AS (SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, ng AS support FROM pr)"""

_WINDOWS = f"""
    cl AS (
      SELECT id, query, rewritten_query, list_slice(list_filter({sents('answer')}, lambda c: regexp_matches(c, '[^ ]')), 1, 6) AS cs FROM audit_logs
    ),
    ct AS (SELECT id, query, rewritten_query, unnest(cs) AS text, generate_subscripts(cs, 1) - 1 AS claim FROM cl),
    wn AS (SELECT id, claim, {content('text', VERIFY_STOP)} AS a, unnest([coalesce(query, ''), coalesce(rewritten_query, '')]) AS ctx FROM ct),
    sh AS (SELECT id, claim, CASE WHEN len(a) > 0 THEN len(list_intersect(a, {content('ctx', VERIFY_STOP)}))::DOUBLE / len(a) ELSE 0 END AS s FROM wn),
    vd AS (SELECT id, claim, CASE WHEN s >= 0.3::DOUBLE THEN 'entailed' WHEN s > 0 THEN 'baseless' ELSE 'contradicted' END AS v FROM sh),
    oj AS (
      SELECT id, claim::INT AS claim, CASE max(CASE v WHEN 'contradicted' THEN 2 WHEN 'entailed' THEN 1 ELSE 0 END) WHEN 2 THEN 'contradicted' WHEN 1 THEN 'entailed' ELSE 'baseless' END AS verdict
      FROM vd GROUP BY ALL
    )"""

# two passes of verdicts as the registered payloads state them: claims 2, 5, ... are left out of the first, the second speaks of even ones
_PASSES = f"""{_WINDOWS},
    cw AS (SELECT id, claim::INT AS claim, text, {content('text', VERIFY_STOP)} AS a, {content("coalesce(query, '')", VERIFY_STOP)} AS q, {content("coalesce(rewritten_query, '')", VERIFY_STOP)} AS r FROM ct),
    cs2 AS (SELECT id, claim, text, CASE WHEN len(a) > 0 THEN len(list_intersect(a, q))::DOUBLE / len(a) ELSE 0 END AS sq, CASE WHEN len(a) > 0 THEN len(list_intersect(a, r))::DOUBLE / len(a) ELSE 0 END AS sr FROM cw),
    cv AS (
      SELECT id, claim, text, CASE WHEN sq >= 0.3::DOUBLE THEN 'entailed' WHEN sq > 0 THEN 'baseless' ELSE 'contradicted' END AS vq,
        CASE WHEN sr >= 0.3::DOUBLE THEN 'entailed' WHEN sr > 0 THEN 'baseless' ELSE 'contradicted' END AS vr FROM cs2
    ),
    lo AS (
      SELECT id, claim, text, CASE WHEN claim % 3 = 2 THEN 'baseless' ELSE vq || ',' || vr END AS verdicts,
        CASE WHEN claim % 3 = 2 THEN 'baseless' WHEN 'contradicted' IN (vq, vr) THEN 'contradicted' WHEN 'entailed' IN (vq, vr) THEN 'entailed' ELSE 'baseless' END AS verdict,
        CASE WHEN claim % 3 = 2 THEN '' ELSE left(text, 20) END AS evidence, CASE WHEN claim % 3 = 2 THEN '' ELSE 'query' END AS source_title FROM cv
    )"""

_CASES = f"""
    t AS (SELECT feedback_id, CASE WHEN lower({strip('feedback')}) = 'correct' THEN 'entailed' ELSE 'baseless' END AS gold, {content('answer', VERIFY_STOP)} AS a,
      {content("coalesce(question, '') || ' ' || coalesce(corrected_answer, '')", VERIFY_STOP)} AS x FROM feedback_log)"""

_LABELLED = f"""
    lb AS (
      SELECT feedback_id, CASE WHEN lower({strip('feedback')}) = 'correct' THEN 1 ELSE 0 END AS label, {plain('answer')} AS a, {plain('question')} AS q FROM feedback_log WHERE question IS NOT NULL
    ),
    ov AS (
      SELECT feedback_id, label, CASE WHEN len(a) = 0 OR len(q) = 0 THEN 0 ELSE len(list_intersect(a, q))::DOUBLE / (len(a) + len(q) - len(list_intersect(a, q))) END AS overlap FROM lb
    )"""

_ACCESSES = f"""
    ac AS (SELECT id, {norm('query')} AS key, floor(epoch(created_at))::BIGINT AS ts, created_at FROM audit_logs WHERE created_at IS NOT NULL),
    sq AS (SELECT id, key, ts, row_number() OVER (ORDER BY ts, id) AS seq FROM ac WHERE key <> '')"""

_TTL = f"""
    ac AS (SELECT {norm('query')} AS key, floor(epoch(created_at)) AS ts FROM audit_logs WHERE created_at IS NOT NULL),
    cnt AS (SELECT key, ts, count(*) AS n FROM ac WHERE key <> '' GROUP BY ALL),
    miss AS (
      SELECT key, min(ts) AS ts FROM cnt GROUP BY key
      UNION ALL
      SELECT m.key, (SELECT min(c.ts) FROM cnt c WHERE c.key = m.key AND c.ts > m.ts + 3600) FROM miss m WHERE EXISTS (SELECT 1 FROM cnt c WHERE c.key = m.key AND c.ts > m.ts + 3600)
    )"""



def _cos(a: str, b: str) -> str:
    return f"round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))), 9)"


_SCREENED = f"""
    q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
    g AS (SELECT query_id, e, query_id + 1 AS doc_id FROM q UNION ALL SELECT query_id, e, query_id + 2 FROM q),
    b AS (SELECT query_id, min({_cos('g.e', 'v.embedding')}) AS bar FROM g JOIN embeddings v ON v.vec_id = g.doc_id GROUP BY ALL),
    s AS (SELECT query_id, v.vec_id AS doc_id, bar, {_cos('q.e', 'v.embedding')} AS score FROM q JOIN b USING (query_id), embeddings v WHERE v.vec_id <> query_id AND v.vec_id NOT IN (SELECT doc_id FROM g)),
    w AS (SELECT * FROM s WHERE score >= bar QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score - bar, 9) DESC, query_id) = 1)"""


def _solved() -> str:
    return f"""{_common()}, sz AS (SELECT query_id, len(t) AS n FROM ql),
    ob AS (SELECT query_id, doc_id, count(*)::DOUBLE AS k, string_agg(term, ' ' ORDER BY term) AS shared FROM qu JOIN du USING (term) GROUP BY query_id, doc_id),
    sv AS (SELECT l.query_id, l.doc_id, round(k / n, 3) AS overlap, shared FROM lexical l JOIN rel USING (query_id, doc_id) JOIN ob USING (query_id, doc_id) JOIN sz ON sz.query_id = l.query_id WHERE rank = 1)"""


def oracle_sql() -> dict[str, str]:
    c = _common()
    metrics = ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)
    means = ", ".join(f"round(avg({m}), 4) AS {m}" for m in _METRICS)
    kept_audit = "SELECT id, query, risk_level, created_at FROM audit_logs ORDER BY created_at DESC NULLS LAST, id DESC"
    return {
        "tokenize_ident": f"SELECT doc_id, len({ident('text')}) AS n_tokens, array_to_string({ident('text')}, ' ') AS tokens FROM documents",
        "tokenize_plain": f"SELECT doc_id, len({plain('text')}) AS n_tokens, array_to_string(list_sort({plain('text')}), ' ') AS tokens FROM documents",
        "tokens_content": f"SELECT doc_id, array_to_string(list_sort({content('text', VERIFY_STOP)}), ' ') AS verify_tokens, array_to_string(list_sort({content('text', RETRIEVAL_STOP)}), ' ') AS retrieval_tokens FROM documents",
        "token_overlap": f"""WITH t AS (SELECT id, {plain('query')} AS a, {plain('answer')} AS b FROM audit_logs)
            SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS overlap FROM t""",
        "sentences": f"WITH t AS (SELECT doc_id, {sents('text')} AS s FROM documents) SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS pos, unnest(s) AS sentence FROM t",
        "snippets": f"SELECT doc_id, left({strip(f"regexp_replace(text, '{SPACE}+', ' ', 'g')")}, 160) AS snippet FROM documents WHERE text IS NOT NULL",
        "cache_keys": f"SELECT id, {norm('query')} AS norm_query, 'minilm::' || {norm('query')} AS cache_key FROM audit_logs WHERE query IS NOT NULL",
        "denial_contexts": f"SELECT chunk_id, regexp_matches(chunk_text, {_q(DENIAL)}) AS denies FROM knowledge_sources WHERE chunk_text IS NOT NULL",
        "analysis_parse": f"WITH {_ANALYSIS} SELECT id, score, reason FROM a",
        "feedback_labels": f"SELECT feedback_id, CASE WHEN lower({strip('feedback')}) = 'correct' THEN 1 ELSE 0 END AS label FROM feedback_log",
        "block_signals": f"WITH {_SIGNALS} SELECT chunk_id, words, round(citation_density, 6) AS citation_density, round(sentence_density, 6) AS sentence_density, array_to_string(reasons, '; ') AS reasons FROM s",
        "block_split": f"WITH {_SIGNALS} SELECT 'kept' AS part, count(*) FILTER (len(reasons) = 0) AS n FROM s UNION ALL SELECT 'dropped', count(*) FILTER (len(reasons) > 0) FROM s",
        "drop_reasons": f"""WITH {_SIGNALS}, x AS (SELECT DISTINCT source_url, unnest(reasons) AS reason FROM s WHERE source_url IS NOT NULL)
            SELECT source_url, left(string_agg(reason, '; ' ORDER BY reason), 200) AS summary FROM x GROUP BY source_url""",
        "chunk_candidates": f"""WITH t AS (SELECT chunk_id, {strip('source_title')} AS st, left({strip('chunk_text')}, 200) AS p FROM knowledge_sources WHERE len({words('chunk_text')}) >= 25)
            SELECT min(chunk_id) AS chunk_id, coalesce(nullif(arg_min(coalesce(st, ''), chunk_id), ''), 'Unknown Source') AS source_title FROM t GROUP BY p""",
        "chunk_windows": f"""WITH t AS (SELECT chunk_id, {words('chunk_text')} AS w FROM rag_chunks), r AS (SELECT chunk_id, w, unnest(range(0, len(w), 320)) AS st FROM t)
            SELECT chunk_id, (st // 320)::INT AS chunk_index, array_to_string(w[st + 1 : st + 400], ' ') AS chunk FROM r""",
        "chunk_sentences": f"{_packed(400, 80, 'chunk_id')} SELECT chunk_id, chunk_index, chunk FROM packed",
        "chunk_sections": f"""{_packed(120, 30, 'chunk_id, source_title')},
            h AS (SELECT chunk_id, chunk_index, CASE WHEN {strip('source_title')} <> '' THEN '[' || {strip('source_title')} || '] ' || chunk ELSE chunk END AS chunk FROM packed)
            SELECT chunk_id, chunk_index, md5(chunk) AS chunk_hash, length(chunk)::INT AS chars FROM h""",
        "chunk_cap": "SELECT source_title, chunk_id FROM knowledge_sources WHERE source_title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_title ORDER BY chunk_id) <= 100",
        "source_list": "SELECT source_title, source_url, count(*) AS chunks FROM knowledge_sources GROUP BY ALL",
        "source_delete": """WITH u AS (SELECT source_url FROM query_rewrite_training UNION SELECT source_url FROM rag_chunks),
            s AS (SELECT source_url FROM rag_chunks UNION ALL SELECT source_url FROM knowledge_sources), k AS (SELECT s.source_url, (u.source_url IS NOT NULL) AS del FROM s LEFT JOIN u ON s.source_url = u.source_url)
            SELECT count(*) FILTER (NOT del) AS kept, count(*) FILTER (del) AS deleted, count(DISTINCT source_url) FILTER (del) AS urls FROM k""",
        "source_refresh": """WITH n AS (SELECT source_url, count(*) AS inserted FROM rag_chunks WHERE chunk_text IS NOT NULL AND source_url IS NOT NULL GROUP BY ALL),
            o AS (SELECT source_url, count(*) AS d FROM (SELECT source_url FROM rag_chunks UNION ALL SELECT source_url FROM knowledge_sources) GROUP BY ALL)
            SELECT n.source_url, inserted, coalesce(d, 0) AS deleted, coalesce(d, 0) > 0 AS refreshed FROM n LEFT JOIN o ON n.source_url = o.source_url""",
        "trick_context": """WITH t AS (SELECT source_title, chunk_id, chunk_text FROM knowledge_sources WHERE source_title <> '' AND chunk_text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_title ORDER BY chunk_id) <= 4)
            SELECT source_title, left(string_agg(chunk_text, chr(10) || chr(10) ORDER BY chunk_id), 6000) AS context FROM t GROUP BY source_title""",
        "rewrite_pairs": """SELECT raw_user_query, rewritten_query, domain, source_title, source_url FROM query_rewrite_training
            WHERE raw_user_query IS NOT NULL AND rewritten_query IS NOT NULL AND domain IS NOT NULL AND source_title IS NOT NULL AND source_url IS NOT NULL
            ORDER BY raw_user_query, rewritten_query, source_url LIMIT 50""",
        "url_check": """SELECT chunk_id, nullif(regexp_extract(source_url, '^[a-z]+://([^/:?#]+)', 1), '') AS host,
            coalesce(regexp_matches(source_url, '^https?://[^/:?#]+'), false) AS valid FROM knowledge_sources""",
        "ingest_pages": _ingest(),
        "analysis_or_text": """WITH t AS (SELECT id, hallucination_analysis AS x, coalesce(json_valid(hallucination_analysis) AND starts_with(ltrim(hallucination_analysis), '{'), false) AS ok FROM audit_logs)
            SELECT id, CASE WHEN ok THEN x::JSON ->> '$.hallucination_score' END AS score,
              CASE WHEN x IS NULL THEN 'No hallucination analysis returned.' WHEN ok THEN x::JSON ->> '$.reason' ELSE x END AS reason FROM t""",
        "prompt_windows": """WITH f AS (SELECT source_title, chunk_text, row_number() OVER (PARTITION BY source_title ORDER BY chunk_id) AS k FROM rag_chunks WHERE source_title IS NOT NULL AND chunk_text IS NOT NULL QUALIFY k <= 3)
            SELECT source_title, md5(string_agg('WINDOW ' || (k - 1) || ': (Source: ' || source_title || ')' || chr(10) || chunk_text, chr(10) || chr(10) ORDER BY k)) AS windows,
              md5(string_agg('(Source: ' || source_title || ')' || chr(10) || chunk_text, chr(10) || chr(10) ORDER BY k)) AS whole FROM f GROUP BY ALL""",
        "stream_append": "SELECT id, risk_level FROM audit_logs",
        "stream_risk_counts": f"""SELECT (floor(epoch(created_at) / 3600) * 3600)::BIGINT AS hour, coalesce({strip('risk_level')}, '') AS level, count(*) AS n
            FROM audit_logs WHERE created_at IS NOT NULL GROUP BY ALL""",
        "stream_cache": f"WITH RECURSIVE {_TTL}, mm AS (SELECT key, count(*) AS misses FROM miss GROUP BY ALL) SELECT key, misses, sum(n)::BIGINT AS accesses FROM cnt JOIN mm USING (key) GROUP BY ALL",
        "html_titles": f"SELECT chunk_id AS page_id, coalesce({strip('source_title')}, '') AS title FROM rag_chunks WHERE chunk_text IS NOT NULL",
        "cosine_topk": f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {_cos('q.embedding', 'v.embedding')} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
            SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 15""",
        "bm25_index": f"WITH {c} SELECT term, df, round(ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, st",
        "bm25_topk": f"WITH {c} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 10",
        "bm25_all_docs": f"""WITH {c} SELECT query_id, doc_id, round(coalesce(score, 0), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0), 9) DESC, doc_id) AS rank
            FROM (SELECT query_id, doc_id FROM asked, docs) LEFT JOIN bs USING (query_id, doc_id)""",
        "lexical_rank": f"WITH {c} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lexical WHERE rank <= 10",
        "rrf_fuse": f"WITH {c}, {_fused(1, 1)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM fused WHERE rank <= 20",
        "rrf_weighted": f"WITH {c}, {_fused(2, 0.5)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM fused WHERE rank <= 20",
        "pool_rerank": f"WITH {c}, {_RERANKED} SELECT query_id, doc_id, first_rank, rank FROM reranked",
        "mmr_50": _mmr(0.5),
        "mmr_hook": _mmr(0.6, alike="least(len(a.t), len(b.t))"),
        "report_rankers": f"""WITH {_runs()}, m0 AS (SELECT run, {means} FROM per GROUP BY run), m AS (SELECT *, round(mrr - lag(mrr) OVER (ORDER BY run), 4) AS delta FROM m0)
            SELECT '| Run | MRR | Change | Hit @1 | Recall @1 | nDCG @1 | Hit @3 | Recall @3 | nDCG @3 |' || chr(10) || '|---|---|---|---|---|---|---|---|---|' || chr(10) ||
              string_agg('| ' || run || ' | ' || printf('%.3f', mrr) || ' | ' || coalesce(printf('%.3f', delta), '—') || ' | ' || {" || ' | ' || ".join(f"printf('%.3f', {m}_{k})" for k in (1, 3) for m in ('hit', 'recall', 'ndcg'))} || ' |', chr(10) ORDER BY run) AS report FROM m""",
        "report_classes": f"""WITH {_JUDGED}, t AS (SELECT count(*) AS n, count(*) FILTER (gold = pred) AS ok FROM j),
            ov AS (SELECT round(ok::DOUBLE / n, 4) AS a, round(avg(f1), 4) AS m, round(sum(f1 * support) / n, 4) AS w, n FROM prf, t GROUP BY n, ok),
            od AS (SELECT unnest(['entailed', 'baseless', 'contradicted']) AS label, unnest([1, 2, 3]) AS o),
            cl AS (SELECT string_agg('| ' || label || ' | ' || printf('%.3f', precision) || ' | ' || printf('%.3f', recall) || ' | ' || printf('%.3f', f1) || ' | ' || support || ' |', chr(10) ORDER BY o) AS x FROM prf JOIN od USING (label)),
            ce AS (SELECT g.label, g.o, string_agg(k::VARCHAR, ' | ' ORDER BY p.o) AS x FROM od g CROSS JOIN od p
              JOIN (SELECT a.label AS gl, b.label AS pl, count(j.gold) AS k FROM od a CROSS JOIN od b LEFT JOIN j ON j.gold = a.label AND j.pred = b.label GROUP BY ALL) c ON gl = g.label AND pl = p.label GROUP BY ALL)
            SELECT 'Accuracy ' || printf('%.3f', a) || ', macro F1 ' || printf('%.3f', m) || ', weighted F1 ' || printf('%.3f', w) || ', ' || n || ' cases.' || chr(10) || chr(10) ||
              '| Label | Precision | Recall | F1 | Support |' || chr(10) || '|---|---|---|---|---|' || chr(10) || cl.x || chr(10) || chr(10) ||
              '| Gold \\ predicted | entailed | baseless | contradicted |' || chr(10) || '|---|---|---|---|' || chr(10) || (SELECT string_agg('| ' || label || ' | ' || x || ' |', chr(10) ORDER BY o) FROM ce) AS report FROM ov, cl""",
        "mmr_80": _mmr(0.8),
        "mmr_100": f"WITH {c} SELECT query_id, doc_id, rank::INT AS pos, NULL::DOUBLE AS mmr_score, NULL::DOUBLE AS max_redundancy FROM bm25 WHERE rank <= 6",
        "unique_sources": f"""WITH {c}, r AS (SELECT query_id, d.source AS source_url, min(rank) AS f, arg_min(coalesce(d.source_title, 'Untitled Source'), rank) AS source_title
              FROM bm25 JOIN documents d USING (doc_id) WHERE rank <= 20 AND d.source <> '' GROUP BY query_id, d.source)
            SELECT query_id, source_url, source_title, row_number() OVER (PARTITION BY query_id ORDER BY f)::INT AS pos FROM r QUALIFY pos <= 5""",
        "retrieve_prompts": _mmr(
            0.8,
            f"{_RERANKED}, pl AS (SELECT r.query_id, r.doc_id, r.rank, coalesce(l.score, 0) AS score FROM reranked r LEFT JOIN lexical l USING (query_id, doc_id) WHERE r.first_rank <= 15),",
            "pl JOIN docs USING (doc_id)",
            """SELECT query_id, length(string_agg(b, chr(10) || chr(10) ORDER BY pos))::INT AS chars, md5(string_agg(b, chr(10) || chr(10) ORDER BY pos)) AS prompt_hash
            FROM (SELECT query_id, pos, 'Source: ' || coalesce(source_title, 'Unknown Source') || chr(10) || 'Text: ' || d.text AS b FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE pos > 0) GROUP BY query_id""",
        ),
        "retrieval_per_query": f"WITH {_runs('')} SELECT run, query_id, {metrics} FROM per",
        "ranker_compare": f"WITH {_runs('')}, m AS (SELECT run, count(*) AS queries, {means} FROM per GROUP BY run) SELECT *, round(mrr - lag(mrr) OVER (ORDER BY run), 4) AS mrr_delta FROM m",
        "distractor_screen": f"WITH {_SCREENED} SELECT doc_id, query_id, round(score, 6) AS score, round(bar, 6) AS bar, round(score - bar, 6) AS margin FROM w",
        "transparency": f"""WITH {_solved()} SELECT query_id, doc_id, overlap, shared, row_number() OVER (ORDER BY overlap DESC, query_id)::INT AS pos FROM sv""",
        "share_solved": f"""WITH {_solved()}, n AS (SELECT (SELECT count(*) FROM sv) AS solved, (SELECT count(*) FROM asked) AS queries)
            SELECT solved, queries, round(coalesce(solved::DOUBLE / nullif(queries, 0), 0), 6) AS share FROM n""",
        "run_detail": f"""WITH {c}, g AS (SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS relevant FROM rel GROUP BY ALL),
            h AS (SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS top FROM bm25 WHERE rank <= 5 GROUP BY ALL),
            k AS (SELECT DISTINCT query_id FROM bm25 JOIN rel USING (query_id, doc_id) WHERE rank <= 5)
            SELECT a.query_id, coalesce(relevant, '') AS relevant, coalesce(top, '') AS top, k.query_id IS NOT NULL AS hit
            FROM asked a LEFT JOIN g USING (query_id) LEFT JOIN h ON h.query_id = a.query_id LEFT JOIN k ON k.query_id = a.query_id""",
        "oracle_full": f"""WITH {c}, r AS (SELECT a.query_id, d.doc_id, row_number() OVER (PARTITION BY a.query_id ORDER BY rel.doc_id IS NULL, d.doc_id) AS rank
              FROM asked a CROSS JOIN docs d LEFT JOIN rel ON rel.query_id = a.query_id AND rel.doc_id = d.doc_id)
            SELECT query_id, count(*) AS ranked, sum(rank * (doc_id % 97))::BIGINT AS checksum FROM r GROUP BY ALL""",
        "diversity_sweep": f"""WITH {c}, sw AS ({" UNION ALL ".join(f"SELECT '{t:.1f}' AS run, query_id, doc_id, pos AS rank FROM ({_mmr(t)})" for t in (1.0, 0.9, 0.8, 0.7, 0.5))}),
            nr AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY ALL),
            hit AS (SELECT run, query_id, min(rank) AS first, count(*) FILTER (rank <= 5) AS n5, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) END) AS g5 FROM sw JOIN rel USING (query_id, doc_id) GROUP BY ALL),
            per AS (SELECT run, query_id, coalesce(1.0::DOUBLE / first, 0) AS mrr, (coalesce(n5, 0) > 0)::INT::DOUBLE AS hit_5,
              coalesce(g5 / list_sum(list_transform(range(1, least(n_rel, 5) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg_5
              FROM (SELECT unnest(['1.0', '0.9', '0.8', '0.7', '0.5']) AS run) CROSS JOIN (SELECT query_id FROM asked) LEFT JOIN nr USING (query_id) LEFT JOIN hit USING (run, query_id))
            SELECT run, count(*) AS queries, round(avg(mrr), 4) AS mrr, round(avg(hit_5), 4) AS hit_5, round(avg(ndcg_5), 4) AS ndcg_5 FROM per GROUP BY run""",
        "rrf_dense": f"""WITH docs AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
            asked AS (SELECT doc_id AS query_id, text AS q_text FROM docs WHERE doc_id % 100 = 0 AND text IS NOT NULL),
            {_scored()},
            b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bs WHERE query_id <> doc_id),
            ds AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {_cos('q.embedding', 'v.embedding')} AS score FROM embeddings q, embeddings v
              WHERE q.vec_id IN (SELECT query_id FROM asked) AND v.vec_id IN (SELECT doc_id FROM docs) AND q.vec_id <> v.vec_id),
            e AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds),
            fs AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(rank) AS best FROM (SELECT * FROM e UNION ALL SELECT * FROM b) GROUP BY ALL),
            f AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, best, doc_id::VARCHAR) AS rank FROM fs)
            SELECT query_id, doc_id, round(score, 6) AS score, rank FROM f WHERE rank <= 20""",
        "distractor_rejects": f"""WITH {_SCREENED} SELECT doc_id, query_id, round(score - bar, 6) AS margin, greatest((SELECT count(*) FROM w) - 15, 0) AS remaining FROM w ORDER BY round(score - bar, 9) DESC, doc_id LIMIT 15""",
        "gold_corpus": "SELECT chunk_id FROM rag_chunks WHERE NOT starts_with(chunk_id, 'd')",
        "valid_chunks": f"SELECT chunk_id::VARCHAR AS chunk_id FROM knowledge_sources WHERE length({strip('chunk_text')}) > 50",
        "local_verdicts": f"WITH {_PASSES} SELECT id, claim, verdicts, verdict, evidence, source_title FROM lo",
        "final_verdicts": f"""WITH {_PASSES}, un AS (SELECT id, string_agg(claim::VARCHAR, ',' ORDER BY claim) FILTER (verdict <> 'entailed') AS unresolved FROM lo GROUP BY ALL),
            fv AS (SELECT *, claim % 2 = 0 AND verdict <> 'entailed' AS used, CASE WHEN claim % 2 = 0 AND verdict <> 'entailed' THEN CASE WHEN length(text) % 2 = 0 THEN 'entailed' ELSE 'contradicted' END ELSE verdict END AS v FROM lo)
            SELECT id, claim, coalesce(unresolved, '') AS unresolved, v AS verdict, CASE WHEN v = 'baseless' THEN '' WHEN used THEN right(text, 10) ELSE evidence END AS evidence,
              CASE WHEN v = 'baseless' OR used THEN '' ELSE source_title END AS source_title FROM fv JOIN un USING (id)""",
        "judged_cases": f"""WITH {_CASES}, p AS (SELECT feedback_id, gold, CASE WHEN len(a) > 0 AND len(list_intersect(a, x))::DOUBLE / len(a) >= 0.6::DOUBLE THEN 'entailed' ELSE 'baseless' END AS pred FROM t)
            SELECT feedback_id, gold, pred, gold = pred AS correct FROM p""",
        "oracle_cases": f"WITH {_CASES} SELECT feedback_id, gold, gold AS pred, true AS correct FROM t",
        "rare_labels": f"SELECT coalesce(lower({strip('feedback')}), '') AS gold, count(*) AS n FROM feedback_log GROUP BY ALL HAVING count(*) < 500",
        "log_report": f"""WITH l AS (SELECT id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id DESC) AS k FROM audit_logs QUALIFY k <= 20),
            v AS (SELECT {strip('query')} AS question FROM audit_logs), t AS (SELECT question, count(*) AS n FROM v WHERE question <> '' GROUP BY ALL ORDER BY n DESC, question LIMIT 8)
            SELECT (SELECT count(*) FROM audit_logs) AS count, (SELECT count(*) FROM l)::INT AS returned, (SELECT string_agg(id::VARCHAR, ',' ORDER BY k) FROM l) AS logs,
              (SELECT string_agg(question || '=' || n, '|' ORDER BY n DESC, question) FROM t) AS top_questions""",
        "lru_hits": f"""WITH {_ACCESSES}, p AS (SELECT seq, key, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev, coalesce(lead(seq) OVER (PARTITION BY key ORDER BY seq), 1099511627776) AS nxt FROM sq),
            far AS (SELECT a.seq, count(*) AS apart FROM p a JOIN p b ON b.seq > a.prev AND b.seq < a.seq AND b.nxt > a.seq WHERE a.seq - a.prev > 256 GROUP BY a.seq)
            SELECT p.seq, md5(key) AS key, prev IS NOT NULL AND coalesce(apart, 0) < 256 AS hit FROM p LEFT JOIN far ON far.seq = p.seq""",
        "cached_answers": f"""WITH {_ACCESSES}, m AS (SELECT floor((min(ts) + max(ts)) / 2.0)::BIGINT // 86400 * 86400 + 43200 AS cleared FROM sq),
            f AS (SELECT {norm('query')} AS key, min(floor(epoch(created_at))::BIGINT) AS set_at, arg_min(md5(answer), (floor(epoch(created_at))::BIGINT, id)) AS value
              FROM audit_logs WHERE created_at IS NOT NULL AND answer IS NOT NULL GROUP BY ALL)
            SELECT sq.id, CASE WHEN set_at >= cleared AND set_at <= ts AND ts <= set_at + 86400 THEN value END AS value FROM sq CROSS JOIN m LEFT JOIN f USING (key)""",
        "quality_split": f"WITH {_LABELLED} SELECT label, count(*) AS n, floor(count(*) * 0.25 + 0.5)::BIGINT AS held_out FROM lb GROUP BY ALL",
        "few_shot": "SELECT raw_user_query, rewritten_query FROM query_rewrite_training ORDER BY md5('42' || raw_user_query) NULLS LAST, raw_user_query, rewritten_query LIMIT 5",
        "html_blocks": f"""WITH l AS (SELECT chunk_id AS page_id, {strip('x')} AS t FROM (SELECT chunk_id, unnest(string_split(chunk_text, chr(10))) AS x FROM rag_chunks WHERE chunk_text IS NOT NULL))
            SELECT page_id, count(*) AS paragraphs, sum(length(t))::BIGINT AS chars FROM l WHERE t <> '' GROUP BY ALL""",
        "dangling": "SELECT s.chunk_id AS query_id, s.chunk_index::BIGINT AS doc_id FROM rag_chunks s WHERE s.chunk_index NOT IN (SELECT doc_id FROM documents)",
        "page_titles": f"""SELECT chunk_id AS page_id, coalesce(nullif({strip('source_title')}, ''), '') AS title, coalesce(length(x), 0)::INT AS chars FROM (
            SELECT chunk_id, source_title, (SELECT string_agg({strip('u.l')}, chr(10) ORDER BY u.i) FROM (SELECT unnest(string_split(chunk_text, chr(10))) AS l, generate_subscripts(string_split(chunk_text, chr(10)), 1) AS i) u WHERE length({strip('u.l')}) > 40) AS x
            FROM rag_chunks WHERE chunk_text IS NOT NULL)""",
        "url_titles": """SELECT chunk_id, CASE WHEN seg <> '' THEN seg ELSE 'PDF Document' END AS title FROM (
            SELECT chunk_id, regexp_extract(regexp_replace(source_url, '/+$', ''), '([^/]*)$', 1) AS seg FROM rag_chunks)""",
        "feedback_sink": "SELECT feedback_id, coalesce(corrected_answer, '') AS corrected_answer FROM feedback_log",
        "chunk_sink": "SELECT count(*) AS chunks, count(DISTINCT chunk_id) AS keys FROM rag_chunks",
        "fallback_source": "SELECT raw_user_query, domain FROM query_rewrite_training",
        "finite_rows": "WITH t AS (SELECT id, CASE WHEN id % 3 = 2 THEN id::DOUBLE END AS x FROM audit_logs) SELECT id, x, x AS first, 1.5::DOUBLE AS second, x AS deep FROM t",
        "csv_source": "SELECT raw_user_query, rewritten_query, domain FROM query_rewrite_training",
        "jsonl_source": "SELECT feedback_id::VARCHAR AS id, question AS query FROM feedback_log WHERE question IS NOT NULL",
        "ranking_review": f"""WITH {c}, m AS (SELECT l.query_id, l.doc_id, l.rank, (r.doc_id IS NOT NULL) AS is_rel FROM lexical l LEFT JOIN rel r USING (query_id, doc_id) WHERE l.query_id IN (SELECT query_id FROM rel)),
            x AS (SELECT m.*, CASE WHEN rank <= 3 AND NOT is_rel THEN coalesce(source_title, '') || ': ' || left({strip(f"regexp_replace(text, '{SPACE}+', ' ', 'g')")}, 160) END AS shown FROM m JOIN documents USING (doc_id))
            SELECT query_id, min(rank) FILTER (is_rel) AS gold_rank, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 3 AND NOT is_rel), '') AS beaten_by,
              coalesce(string_agg(shown, ' | ' ORDER BY rank), '') AS beaten FROM x GROUP BY query_id HAVING coalesce(min(rank) FILTER (is_rel), 0) <> 1""",
        "lexical_verifier": f"""WITH t AS (SELECT feedback_id, {content('answer', VERIFY_STOP)} AS a, {content("coalesce(question, '') || ' ' || coalesce(corrected_answer, '')", VERIFY_STOP)} AS x FROM feedback_log),
            s AS (SELECT feedback_id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, x))::DOUBLE / len(a) ELSE 0 END AS s FROM t)
            SELECT feedback_id, round(s, 3) AS overlap, CASE WHEN s >= 0.6::DOUBLE THEN 'entailed' ELSE 'baseless' END AS verdict FROM s""",
        "or_join": f"WITH {_WINDOWS} SELECT id, claim, verdict FROM oj",
        "aggregate_verdict": f"""WITH {_WINDOWS}, w AS (SELECT id, max(CASE verdict WHEN 'contradicted' THEN 2 WHEN 'entailed' THEN 0 ELSE 1 END) AS code FROM oj GROUP BY ALL)
            SELECT l.id, CASE coalesce(code, 1) WHEN 2 THEN 'contradicted' WHEN 1 THEN 'baseless' ELSE 'entailed' END AS verdict FROM audit_logs l LEFT JOIN w ON w.id = l.id""",
        "confusion_matrix": f"WITH {_JUDGED} SELECT g.label AS gold, p.label AS pred, count(j.gold) AS n FROM lb g CROSS JOIN lb p LEFT JOIN j ON j.gold = g.label AND j.pred = p.label GROUP BY ALL",
        "class_metrics": f"WITH {_JUDGED} SELECT label, precision, recall, f1, support FROM prf",
        "overall_metrics": f"""WITH {_JUDGED}, t AS (SELECT count(*) AS n, count(*) FILTER (gold = pred) AS ok FROM j)
            SELECT round(ok::DOUBLE / n, 4) AS accuracy, round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / n, 4) AS weighted_f1, n FROM prf, t GROUP BY n, ok""",
        "answer_features": f"""WITH {_ANALYSIS}, cs AS (SELECT id, {sents('answer')} AS s FROM audit_logs),
            v AS (SELECT id, list_transform(s, lambda c: CASE WHEN regexp_matches(c, {_q(DENIAL)}) THEN 'contradicted' WHEN length(c) % 2 = 0 THEN 'entailed' ELSE 'other' END) AS v FROM cs),
            k AS (SELECT id, len(v)::DOUBLE AS n, len(list_filter(v, lambda x: x = 'entailed'))::DOUBLE AS e, len(list_filter(v, lambda x: x = 'contradicted'))::DOUBLE AS x FROM v)
            SELECT a.id, coalesce(score, 2)::DOUBLE AS hallucination_score, CASE lower(trim(risk_level)) WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END::DOUBLE AS risk_score, n AS retrieved_context_count, n AS n_claims,
              e AS n_entailed, 0::DOUBLE AS n_baseless, x AS n_contradicted, CASE WHEN n > 0 THEN round(e / n, 6) ELSE 0 END::DOUBLE AS frac_entailed, n AS n_sources,
              len({words("coalesce(answer, '')")})::DOUBLE AS answer_len_words, contains(lower(coalesce(answer, '')), 'could not verify')::INT::DOUBLE AS unverified_flag FROM a JOIN k ON k.id = a.id""",
        "quality_auc": f"""WITH {_LABELLED}, g AS (SELECT overlap, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM ov GROUP BY ALL),
            w AS (SELECT p, n, p * (coalesce(sum(n) OVER (ORDER BY overlap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2::DOUBLE) AS w FROM g)
            SELECT round(sum(w) / (sum(p) * sum(n))::DOUBLE, 6) AS auc FROM w""",
        "quality_rule": f"""WITH {_LABELLED}, m AS (SELECT count(*) FILTER (label = 1 AND overlap >= 0.3::DOUBLE)::DOUBLE AS tp, count(*) FILTER (label = 0 AND overlap >= 0.3::DOUBLE)::DOUBLE AS fp,
              count(*) FILTER (label = 1 AND overlap < 0.3::DOUBLE)::DOUBLE AS fn, count(*) FILTER (label = 0 AND overlap < 0.3::DOUBLE)::DOUBLE AS tn, count(*)::DOUBLE AS n FROM ov),
            r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM m)
            SELECT tp, fp, fn, tn, n, round((tp + tn) / n, 6) AS accuracy, round(greatest(tp + fn, n - tp - fn) / n, 6) AS majority, round(p, 6) AS precision, round(r, 6) AS recall,
              round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM r""",
        "audit_stats": f"""WITH v AS (SELECT {strip('risk_level')} AS v FROM audit_logs) SELECT count(v) AS total, count(*) FILTER (v = 'Low') AS low, count(*) FILTER (v = 'Medium') AS medium,
            count(*) FILTER (v = 'High') AS high, round(count(*) FILTER (v = 'Low') * 100::DOUBLE / nullif(count(v), 0), 1) AS grounded_pct FROM v""",
        "audit_stats_latest": f"""WITH v AS (SELECT {strip('risk_level')} AS v FROM (SELECT risk_level FROM audit_logs ORDER BY id DESC LIMIT 500)) SELECT count(v) AS total, count(*) FILTER (v = 'Low') AS low,
            count(*) FILTER (v = 'Medium') AS medium, count(*) FILTER (v = 'High') AS high, round(count(*) FILTER (v = 'Low') * 100::DOUBLE / nullif(count(v), 0), 1) AS grounded_pct FROM v""",
        "top_questions": f"WITH v AS (SELECT {strip('query')} AS question FROM audit_logs) SELECT question, count(*) AS n FROM v WHERE question <> '' GROUP BY ALL ORDER BY n DESC, question LIMIT 8",
        "recent_logs": f"SELECT id, coalesce(query, '') AS query, coalesce(risk_level, '') AS risk_level FROM ({kept_audit} LIMIT 20)",
        "audit_page": """SELECT id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id DESC)::INT AS pos, (SELECT ceil(count(*) / 5.0)::BIGINT FROM audit_logs) AS pages FROM audit_logs
            QUALIFY pos BETWEEN 11 AND 15""",
        "cache_hits": f"""WITH RECURSIVE {_TTL}, mm AS (SELECT key, count(*) AS misses FROM miss GROUP BY ALL) SELECT key, misses, sum(n)::BIGINT AS accesses FROM cnt JOIN mm USING (key) GROUP BY ALL""",
        "cache_stats": f"""WITH RECURSIVE {_TTL}, t AS (SELECT (SELECT count(*) FROM miss) AS m, (SELECT sum(n)::BIGINT FROM cnt) AS a)
            SELECT a - m AS hits, m AS misses, round((a - m)::DOUBLE / a, 4) AS hit_rate FROM t""",
        "risk_by_hour": f"SELECT epoch(date_trunc('hour', created_at))::BIGINT AS hour, coalesce({strip('risk_level')}, '') AS level, count(*) AS n FROM audit_logs WHERE created_at IS NOT NULL GROUP BY ALL",
    }
