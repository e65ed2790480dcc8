"""Writers: append, partial update as a new snapshot, SCD-2 supersession, archive, trims. All return DataFrames or write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def updated(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A snapshot in which non-null columns of ``changes`` replace those of ``base``."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return base.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def inserted_if_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(rows.dropDuplicates(keys).join(base.select(*keys).distinct(), keys, "left_anti").select(base.columns))


def archived(memories: DataFrame, condition: str, chars: int = 50) -> DataFrame:
    """Rows that meet the condition keep their text as raw_content and a short one as content."""
    gone = F.coalesce(F.expr(condition), F.lit(False))
    return memories.withColumn("raw_content", F.when(gone, F.col("content"))).withColumn("scope", F.when(gone, "archived").otherwise(F.col("scope"))).withColumn("content", F.when(gone, F.substring("content", 1, chars)).otherwise(F.col("content")))


def trimmed(rows: DataFrame, by: list[str], order: list, keep: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def append(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
