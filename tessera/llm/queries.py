"""The pN_ queries over the test tables, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .byte_bpe import texts_of, token_ids
from .format_duplicates import collapsed, duplicate_rows
from .heavy_hitters import frequent_values
from .language_id import document_languages, fitted, named_language, segment_languages
from .main_content import furniture_lines, main_body
from .mixing import deviation, mix
from .near_duplicates import near_duplicate_groups, near_duplicate_pairs
from .pair_defects import pair_defects, sampled_judge
from .pieces import oversized_pieces
from .repeated_lines import line_table, near_repeated_lines, repeated_lines, without_lines

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, d, "knowledge_sources"), "chunk_id", "chunk_text", shingle=3, threshold=0.6)


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(table(spark, d, "knowledge_sources"), "chunk_id", "chunk_text", shingle=3, threshold=0.6)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    audit = duplicate_rows(table(spark, d, "audit_logs"), "id", "query").withColumn("table_name", F.lit("audit_logs"))
    feedback = duplicate_rows(table(spark, d, "feedback_log"), "feedback_id", "question").withColumn("table_name", F.lit("feedback_log"))
    return audit.unionByName(feedback).select("table_name", "row_id", "norm_text")


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    audit = collapsed(table(spark, d, "audit_logs"), "id", "query").withColumn("table_name", F.lit("audit_logs"))
    feedback = collapsed(table(spark, d, "feedback_log"), "feedback_id", "question").withColumn("table_name", F.lit("feedback_log"))
    return audit.unionByName(feedback).select("table_name", "first_id", "copies")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent_values(table(spark, d, "audit_logs"), "query", share=0.005).select(F.col("value").alias("query"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequent_values(table(spark, d, "audit_logs"), "query", share=0.005).select(F.col("value").alias("query"), F.col("n").alias("asked"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(table(spark, d, "knowledge_sources"), "chunk_id", "source_title", "chunk_text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("chunk_id", "line_no")


def p4_lines(spark: SparkSession, d: str) -> DataFrame:
    return line_table(table(spark, d, "knowledge_sources"), _lines(spark, d), "chunk_id", "source_title", "chunk_text")


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_lines(table(spark, d, "knowledge_sources"), _lines(spark, d), "chunk_id", "chunk_text")


def _near_lines(spark: SparkSession, d: str) -> DataFrame:
    return near_repeated_lines(table(spark, d, "knowledge_sources"), "chunk_id", "source_title", "chunk_text")


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster of near-equal lines of a source by one of its lines, with its document frequency."""
    return line_table(table(spark, d, "knowledge_sources"), _near_lines(spark, d), "chunk_id", "source_title", "chunk_text")


def p4_clean_near(spark: SparkSession, d: str) -> DataFrame:
    return without_lines(table(spark, d, "knowledge_sources"), _near_lines(spark, d), "chunk_id", "chunk_text")


def _defects(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "feedback_log")
    judge = sampled_judge(log, _models(spark, d), "feedback_id", "question", "answer", "feedback")
    return pair_defects(log, judge, "feedback_id", "question", "answer", "corrected_answer")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d)


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).groupBy("answer_field", "defect").agg(F.count("*").alias("pairs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = oversized_pieces(table(spark, d, "rag_chunks"), "chunk_id", "chunk_text", with_text=False)
    return pieces.where("piece_no = 1").select("chunk_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return oversized_pieces(table(spark, d, "rag_chunks"), "chunk_id", "chunk_text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return furniture_lines(table(spark, d, "rag_chunks"), "chunk_id", "chunk_text")


def p7_body(spark: SparkSession, d: str) -> DataFrame:
    return main_body(table(spark, d, "rag_chunks"), "chunk_id", "chunk_text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"), "doc_id", "text")


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    return texts_of(p8_ids(spark, d), "doc_id", "ids")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "source", "text")[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "source", "text")[1]


def p9_deviation(spark: SparkSession, d: str) -> DataFrame:
    return deviation(mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "source", "text")[0])


def _models(spark: SparkSession, d: str):
    return fitted(table(spark, d, "documents"), table(spark, d, "language_names"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = named_language(table(spark, d, "documents").select("doc_id", "text", "lang"), table(spark, d, "language_names"), "lang")
    found = document_languages(docs, _models(spark, d), "doc_id", "text", skip_col="named")
    return found.select("doc_id", F.col("lang").alias("found_lang"))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    return document_languages(table(spark, d, "documents"), _models(spark, d), "doc_id", "text")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return segment_languages(table(spark, d, "documents"), _models(spark, d), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


SPACE = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]"


WORD = r"[\p{L}\p{N}]+"


def _squeeze(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


# every record with what is left of it once only letters and digits count
_RECORDS = f"""
    t AS (SELECT 'audit_logs' AS table_name, id AS row_id, query AS t FROM audit_logs UNION ALL SELECT 'feedback_log', feedback_id, question FROM feedback_log),
    i AS (SELECT *, list_filter(regexp_split_to_array(t, '[;|\\r\\n]'), lambda x: {_squeeze('x')} <> '') AS items FROM t WHERE {_squeeze('t')} <> ''),
    n AS (
      SELECT table_name, row_id, CASE
        WHEN len(items) >= 2 AND len(list_filter(items, lambda x: NOT regexp_matches(x, '^{SPACE}*{WORD}{SPACE}*[:=].*[\\p{{L}}\\p{{N}}]'))) = 0
        THEN array_to_string(list_sort(list_transform(items, lambda x: {_squeeze('x')})), '|') ELSE {_squeeze('t')} END AS norm_text FROM i
    )"""

# every line of every chunk of a named source, and those its source repeats
_LINES = f"""
    l AS (
      SELECT chunk_id, source_title, unnest(string_split(chunk_text, chr(10))) AS raw, generate_subscripts(string_split(chunk_text, chr(10)), 1) - 1 AS line_no
      FROM knowledge_sources WHERE regexp_replace(source_title, '{SPACE}+', '', 'g') <> ''
    ),
    n AS (SELECT *, lower(trim(regexp_replace(raw, '{SPACE}+', ' ', 'g'))) AS line FROM l),
    k AS (SELECT source_title, count(*) AS k FROM knowledge_sources GROUP BY 1),
    f AS (
      SELECT source_title, line, count(DISTINCT chunk_id) AS docs_with_line FROM n JOIN k USING (source_title) WHERE line <> ''
      GROUP BY source_title, line, k HAVING count(DISTINCT chunk_id) >= 5 AND count(DISTINCT chunk_id) * 10 >= k
    )"""


def _pieces(limit: int, overlap: int) -> str:
    """Cutting by the rule itself: one recursive row per piece, over the lists of boundaries of each text."""
    stops, closers = "[.!?。！？؟…]", "[\"''\\)\\]}»”’」』]"
    last = lambda k, more: f"list_max(list_filter({k}, lambda x: x <= r.st + {limit} AND x > {more}))"
    half = f"greatest(r.done, r.st + {limit // 2 - 1})"
    return f"""WITH RECURSIVE
    t AS (SELECT chunk_id, regexp_replace(chunk_text, '^{SPACE}+|{SPACE}+$', '', 'g') AS x FROM rag_chunks WHERE chunk_text IS NOT NULL),
    w AS (SELECT chunk_id, list_filter(regexp_split_to_array(x, '{SPACE}+'), lambda v: v <> '') AS ws, regexp_extract_all(x, '{SPACE}+') AS gs FROM t),
    b AS (
      SELECT *, len(ws) AS n, list_transform(gs, lambda g: length(g) - length(replace(replace(replace(g, chr(13) || chr(10), chr(10)), chr(10), ''), chr(13), ''))
        - (length(g) - length(replace(g, chr(13) || chr(10), chr(10))))) AS br FROM w WHERE len(ws) > {limit}
    ),
    k AS (
      SELECT chunk_id, ws, gs, n, list_filter(range(1, n), lambda i: br[i] >= 2) AS k1, list_filter(range(1, n), lambda i: br[i] >= 1) AS k2,
        list_filter(range(1, n), lambda i: br[i] >= 1 OR regexp_matches(ws[i], '{stops}{closers}?$')) AS k3 FROM b
    ),
    r AS (
      SELECT chunk_id, 0 AS no, 0::BIGINT AS st, 0::BIGINT AS done FROM k
      UNION ALL
      SELECT chunk_id, no + 1, CASE WHEN nx < e THEN nx ELSE bk END, e FROM (
        SELECT *, list_min(list_filter(k3, lambda x: x >= bk)) AS nx FROM (
          SELECT *, greatest(e - {overlap}, st + 1) AS bk FROM (
            SELECT r.chunk_id, r.no, r.st, k.k3, coalesce({last('k.k1', half)}, {last('k.k2', half)}, {last('k.k3', half)}, {last('k.k3', 'r.done')}, r.st + {limit}) AS e
            FROM r JOIN k USING (chunk_id) WHERE r.st + {limit} < k.n
          )
        )
      )
    ),
    p AS (SELECT chunk_id, no, st, done, coalesce(lead(done) OVER (PARTITION BY chunk_id ORDER BY no), n) AS e, ws, gs FROM r JOIN k USING (chunk_id))
    SELECT chunk_id, no::INT AS piece_no, st::INT AS first_word, (e - st)::INT AS words, greatest(done - st, 0)::INT AS overlap,
      array_to_string(flatten(list_transform(range(st + 1, e + 1), lambda i: [ws[i], CASE WHEN i < e THEN gs[i] ELSE '' END])), '') AS piece FROM p"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
            WITH w AS (SELECT chunk_id, regexp_extract_all(lower(chunk_text), '{WORD}') AS w FROM knowledge_sources WHERE chunk_text IS NOT NULL),
            t AS (SELECT DISTINCT chunk_id, hash(w[i], w[i + 1], w[i + 2]) AS h FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
            n AS (SELECT chunk_id, count(*) AS n FROM t GROUP BY 1),
            c AS (SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, count(*) AS k FROM t a JOIN t b ON a.h = b.h AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
            SELECT chunk_id_a, chunk_id_b FROM c JOIN n a ON a.chunk_id = chunk_id_a JOIN n b ON b.chunk_id = chunk_id_b WHERE k >= 0.6 * (a.n + b.n - k)
        """,
        "p2_found": f"WITH {_RECORDS} SELECT table_name, row_id, norm_text FROM n QUALIFY count(*) OVER (PARTITION BY table_name, norm_text) > 1",
        "p2_collapsed": f"WITH {_RECORDS} SELECT table_name, min(row_id) AS first_id, count(*) AS copies FROM n GROUP BY table_name, norm_text",
        "p3_found": f"""
            WITH v AS (SELECT regexp_replace(query, '^{SPACE}+|{SPACE}+$', '', 'g') AS q FROM audit_logs)
            SELECT q AS query FROM v WHERE q <> '' GROUP BY q HAVING count(*) >= 0.005 * (SELECT count(*) FROM audit_logs)
        """,
        "p3_counts": f"""
            WITH v AS (SELECT regexp_replace(query, '^{SPACE}+|{SPACE}+$', '', 'g') AS q FROM audit_logs)
            SELECT q AS query, count(*) AS asked FROM v WHERE q <> '' GROUP BY q
            HAVING count(*) >= 0.005 * (SELECT count(*) FROM audit_logs)
        """,
        "p4_found": f"WITH {_LINES} SELECT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM n JOIN f USING (source_title, line)",
        "p4_lines": f"WITH {_LINES} SELECT source_title, line, docs_with_line FROM f",
        "p4_clean": f"""
            WITH {_LINES}, d AS (SELECT chunk_id, line_no FROM n JOIN f USING (source_title, line)),
            a AS (SELECT chunk_id, unnest(string_split(chunk_text, chr(10))) AS raw, generate_subscripts(string_split(chunk_text, chr(10)), 1) - 1 AS line_no FROM knowledge_sources WHERE chunk_text IS NOT NULL),
            c AS (SELECT chunk_id, string_agg(raw, chr(10) ORDER BY line_no) AS t FROM a ANTI JOIN d USING (chunk_id, line_no) GROUP BY chunk_id)
            SELECT s.chunk_id, CASE WHEN s.chunk_text IS NOT NULL THEN coalesce(t, '') END AS chunk_text FROM knowledge_sources s LEFT JOIN c USING (chunk_id)
        """,
        "p6_pieces": _pieces(400, 80),
        "p8_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p6_found": f"""
            SELECT chunk_id FROM rag_chunks
            WHERE len(list_filter(regexp_split_to_array(chunk_text, '{SPACE}+'), lambda w: w <> '')) > 400
        """,
    }
