"""Readers: parquet tables, JSON lines session logs, and the memory view of a documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the memory table, as expressions over ``documents`` that Spark and the oracle both understand.
MEMORY_COLUMNS = [
    "doc_id AS memory_id", "text AS content",
    "CASE doc_id % 8 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' WHEN 2 THEN 'event' WHEN 3 THEN 'correction' WHEN 4 THEN 'episode' WHEN 5 THEN 'consolidated' WHEN 6 THEN 'archived' ELSE 'expired' END AS scope",
    "doc_id % 50 AS user_id", "CASE doc_id % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'private' ELSE 'channel' END AS visibility", "doc_id % 7 AS channel_id",
    "CAST(doc_id % 200 AS DOUBLE) AS age_days", "CAST(doc_id % 200 AS DOUBLE) / 2 AS access_age_days", "doc_id % 13 AS recall_count",
    "0.5 + (doc_id % 5) / 10.0E0 AS confidence", "1.0E0 + doc_id % 7 AS bayes_alpha", "1.0E0 + doc_id % 4 AS bayes_beta", "1.0E0 * (doc_id % 10) AS importance",
    "CASE doc_id % 5 WHEN 0 THEN 'important' WHEN 1 THEN 'painful' WHEN 2 THEN 'warm' ELSE 'neutral' END AS emotion", "(doc_id % 11) / 10.0E0 AS emotion_intensity", "doc_id % 17 = 0 AS superseded",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(*MEMORY_COLUMNS)


def session_log(spark: SparkSession, path: str, min_chars: int = 10, max_chars: int = 300, min_turns: int = 2) -> DataFrame:
    """JSON lines of type ``message``: (session, position, role, content); content may be a string or an array of text parts.

    A session is a file, read whole, and position is the line's number in it from 0, so the order of turns stays. Lines that are no
    JSON object, short messages and sessions of fewer than ``min_turns`` of them are left out.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("session"), F.posexplode(F.split("value", "\n")).alias("position", "line"))
    raw = files.select("session", "position", F.from_json("line", "type string, message struct<role:string,content:string>").alias("x")).select("session", "position", "x.type", "x.message")
    parts = F.from_json("message.content", "array<struct<text:string>>")
    content = F.coalesce(F.array_join(F.transform(F.when(F.col("message.content").startswith("["), parts), lambda x: x["text"]), " "), F.col("message.content"))
    rows = raw.where("type = 'message'").select("session", "position", "message.role", F.substring(F.trim(content), 1, max_chars).alias("content")).where(F.length("content") >= min_chars)
    enough = rows.groupBy("session").agg(F.count("*").alias("n")).where(F.col("n") >= min_turns).select("session")
    return rows.join(enough, "session", "left_semi")


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_msg string, assistant_msg string, ts long").json(path)
