"""A table of upserts by batch: each batch is one folder of parquet files, which a replay of the batch overwrites with the same rows.

A batch sees only the rows of earlier batches, so it gives the same result however often it runs, and nothing needs a lock or a log.
The folder must lie where the driver and all executors reach it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class UpsertTable:
    """Rows of ``schema`` with a unique ``key``; the newest batch's row of a key counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def _exists(self) -> bool:
        hpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(hpath) and any(s.getPath().getName().startswith("batch=") for s in fs.listStatus(hpath))

    def all_rows(self, before: int | None = None) -> DataFrame:
        """Every version with its ``batch``; those of ``before`` and later batches aren't read."""
        if not self._exists():
            return self.spark.createDataFrame([], f"{self.schema}, batch long")
        rows = self.spark.read.schema(f"{self.schema}, batch long").option("basePath", self.path).parquet(self.path)
        return rows if before is None else rows.where(F.col("batch") < before)

    def current(self, before: int | None = None) -> DataFrame:
        rows = self.all_rows(before)
        names = [c for c in rows.columns if c != "batch"]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*names), "batch").alias("row")).select("row.*")

    def put(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
