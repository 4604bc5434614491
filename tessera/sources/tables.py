"""Schemas, readers with declared schemas, and sinks of the persisted relations."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# schemas as DDL
KNOWLEDGE = "source_title string, source_url string, chunk_index int, chunk_text string, embedding array<float>"
CHUNKS = "chunk_id string, source_title string, source_url string, chunk_index int, chunk_text string"
AUDIT = "id bigint, query string, rewritten_query string, answer string, hallucination_analysis string, risk_level string, risk_reason string, created_at timestamp"
FEEDBACK = "question string, answer string, feedback string, corrected_answer string, timestamp timestamp"
RAW_SOURCES = "source_url string, source_title string, scraped_at timestamp, raw_text string"
REWRITES = "raw_user_query string, rewritten_query string, domain string, source_title string, source_url string"
QRELS = "id string, query string, relevant_ids array<string>"
CORPUS = "id string, source_title string, text string, distractor boolean"
CASES = "id string, domain string, gold string, answer string, contexts array<struct<source_title:string,text:string>>, relabel_note string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and quoted line breaks; the schema is declared, so nothing is read to infer it."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def read_jsonl(spark: SparkSession, path: str, schema: str, *, limit: int | None = None) -> DataFrame:
    """One JSON object per line; blank lines are skipped. ``limit`` keeps the first rows in the order of files and lines."""
    rows = spark.read.schema(schema).json(path)
    if limit is None:
        return rows
    # the place of a line grows with its file, its split and the lines before it
    at = F.struct(F.input_file_name(), F.monotonically_increasing_id())
    return rows.withColumn("__at", at).orderBy("__at").limit(limit).drop("__at")


def first_available(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """The first path that exists and holds a row (parquet, else CSV by suffix), else an empty frame of the schema."""
    fs = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        at = fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            continue
        df = read_csv(spark, path, schema) if path.endswith(".csv") else spark.read.schema(schema).parquet(path)
        if not df.isEmpty():
            return df
    return spark.createDataFrame([], schema)


def latest(df: DataFrame, id_col: str, limit: int = 500) -> DataFrame:
    """The newest rows by id: a distributed top-k, no global sort."""
    return df.orderBy(F.col(id_col).desc()).limit(limit)


def append_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def append_chunks(chunks: DataFrame, vectors: DataFrame, key: str, path: str) -> None:
    """Appends chunks with their vectors; a chunk without a vector, or the reverse, fails before anything is written."""
    both = chunks.withColumn("__c", F.lit(1)).join(vectors.withColumn("__v", F.lit(1)), key, "full")
    odd = both.where(F.col("__c").isNull() | F.col("__v").isNull()).limit(1).count()
    if odd:
        raise ValueError("chunks and vectors don't pair up")
    append_parquet(both.drop("__c", "__v"), path)


def append_feedback(df: DataFrame, path: str) -> None:
    """Appends feedback rows; a null correction becomes ''."""
    append_parquet(df.withColumn("corrected_answer", F.coalesce("corrected_answer", F.lit(""))), path)


def write_report(rows: DataFrame, json_path: str, markdown: str, md_path: str) -> None:
    """A small result as JSON and a Markdown text beside it; for results of a handful of rows."""
    for path, text in ((json_path, json.dumps([r.asDict(True) for r in rows.collect()], indent=2, default=str)), (md_path, markdown)):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
