"""Prose filter: signals of a text block and the reasons to reject it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, col, strip, words

# fixed values: site furniture, as substrings of the lower-cased text with single spaces
CHROME = (
    "official website of the united states government",
    "a .gov website belongs to an official government organization",
    ".gov website belongs to an official government",
    "secure .gov websites use https",
    "means you've safely connected",
    "means you have safely connected",
    "locked padlock",
    "lock a locked padlock",
    "skip to main content",
    "this site uses cookies",
    "we use cookies",
    "accept all cookies",
    "javascript is disabled",
    "enable javascript",
    "browser is out of date",
    "sign up for email updates",
    "subscribe to our newsletter",
    "share this page",
    "was this page helpful",
    "return to top",
)
# fixed values: citation marks
CITATION = r"\[\^?\s*\d+\s*\]|\b\d+\s+CFR\s+[\d.]+|\b\d+\s+FR\s+\d+|\bSee\s+(?:also\s+)?(?:the\s+)?[A-Z0-9]|\(PDF\)|\bUSCIS-PM\b"
# fixed values: limits of the signals
MAX_CITATIONS, MIN_SENTENCES, MIN_WORDS = 0.08, 1.2, 40
SENTENCE_END = rf"[.!?](?:{SPACE}|$)"


def chrome_hits(c: Column | str) -> Column:
    """The phrases a text holds, in their fixed order; the text is folded once, by a one-element transform."""
    folded = F.regexp_replace(F.lower(col(c)), f"{SPACE}+", " ")
    phrases = F.array(*map(F.lit, CHROME))
    return F.flatten(F.transform(F.array(folded), lambda t: F.filter(phrases, lambda p: F.contains(t, p))))


def block_signals(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``words, chrome, citation_density, sentence_density, reasons``; densities are not rounded.

    A null, empty or blank text has the one reason 'empty'. Density reasons need ``MIN_WORDS`` words.
    """
    n = F.size(words(text_col))
    hits = F.size(F.regexp_extract_all(text_col, F.lit(f"({CITATION})"), F.lit(1)))
    ends = F.size(F.regexp_extract_all(text_col, F.lit(f"({SENTENCE_END})"), F.lit(1)))
    out = df.withColumn("words", n).withColumn("chrome", F.when(n > 0, chrome_hits(text_col)).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("citation_density", F.when(n > 0, hits / n).otherwise(0.0)).withColumn("sentence_density", F.when(n > 0, ends * 100.0 / n).otherwise(0.0))
    long = F.col("words") >= MIN_WORDS
    reasons = F.array_compact(
        F.array(
            F.when(F.col("words") == 0, F.lit("empty")),
            F.when(F.size("chrome") > 0, F.concat(F.lit("chrome:"), F.get("chrome", F.lit(0)))),
            F.when(long & (F.col("citation_density") > MAX_CITATIONS), F.concat(F.lit("citations:"), F.format_string("%.3f", F.bround("citation_density", 3)))),
            F.when(long & (F.col("sentence_density") < MIN_SENTENCES), F.concat(F.lit("fragmented:"), F.format_string("%.2f", F.bround("sentence_density", 2)))),
        )
    )
    return out.withColumn("reasons", reasons)


def split_blocks(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows kept, and rows dropped with their reasons."""
    flagged = block_signals(df, text_col)
    return flagged.where(F.size("reasons") == 0).drop("reasons"), flagged.where(F.size("reasons") > 0)


def drop_summary(dropped: DataFrame, by: str, chars: int = 200) -> DataFrame:
    """Per ``by``: the sorted distinct reasons of its dropped rows, joined and cut."""
    reason = dropped.select(by, F.explode("reasons").alias("reason")).distinct()
    return reason.groupBy(by).agg(F.left(F.array_join(F.array_sort(F.collect_list("reason")), "; "), F.lit(chars)).alias("summary"))


def candidates(df: DataFrame, pos_col: str, title_col: str, text_col: str, *, min_words: int = 25, prefix: int = 200) -> DataFrame:
    """Rows of ``min_words`` words, the first by ``pos_col`` of each distinct ``prefix`` of the stripped text.

    A missing or blank title becomes 'Unknown Source'; the text comes out stripped. The first row is found by
    aggregation in one reading, so a prefix on a third of the rows costs one row per task.
    """
    text = strip(text_col)
    rows = df.where(F.size(words(text_col)) >= min_words).withColumn(text_col, text)
    head = F.left(F.col(text_col), F.lit(prefix))
    first = rows.groupBy(F.xxhash64(head).alias("__k"), head.alias("__p")).agg(F.min_by(F.struct(*df.columns), F.col(pos_col)).alias("__r"))
    title = strip(F.col(f"__r.{title_col}"))
    kept = {c: F.when(title != "", title).otherwise("Unknown Source") if c == title_col else F.col(f"__r.{c}") for c in df.columns}
    return first.select(*(v.alias(c) for c, v in kept.items()))
