"""Versioned facts (subject, predicate, object): supersession, timelines, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_fact() -> WindowSpec:
    return Window.partitionBy("subject", "predicate").orderBy("ts", "fact_id")


def timeline(facts: DataFrame) -> DataFrame:
    """Versions of exclusive facts: an equal following object is no new version; valid_until is the next version's time or null."""
    changed = facts.withColumn("_before", F.lag("object").over(by_fact())).where("_before is null or _before <> object").drop("_before")
    return changed.select("fact_id", "subject", "predicate", "object", F.col("ts").alias("valid_from"), F.lead("ts").over(by_fact()).alias("valid_until"), F.row_number().over(by_fact()).alias("version"))


def conflicts(facts: DataFrame) -> DataFrame:
    """Per subject and predicate with more than one object: their number and the newest."""
    return facts.groupBy("subject", "predicate").agg(F.count_distinct("object").alias("n_objects"), F.max_by("object", F.struct("ts", "fact_id")).alias("newest")).where("n_objects > 1")


def newest(facts: DataFrame, most: int = 2) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("subject", "predicate").orderBy(F.desc("ts"), F.desc("fact_id")))
    return facts.withColumn("rank", rank).where(F.col("rank") <= most).select("fact_id", "subject", "predicate", "object", "rank")
