"""Files that change, as a stream: findings are brought up to date by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "path string, lang string, text string, version long"


def changed_files(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """A stream of file rows that writers put as Parquet into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", most_files).parquet(folder)


def keep_current(stream: DataFrame, scan: Callable[[DataFrame], DataFrame], table: str, checkpoint: str) -> StreamingQuery:
    """Scans the newest version of each changed file of a batch and replaces the
    batch's folder of findings, so a batch that is run again leaves the same rows.
    `current()` reads the newest state."""

    def put(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by(F.struct("lang", "text", "version"), "version").alias("f")).select("path", "f.*")
        newest = newest.persist()
        found = scan(newest.select("path", "lang", "text"))
        tagged = newest.select("path", "version").join(found, "path", "left")
        tagged.write.mode("overwrite").parquet(f"{table}/batch={number}")
        newest.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, key: str = "kind") -> DataFrame:
    """Findings of the newest version of every file; clean files have none."""
    rows = spark.read.parquet(table)
    newest = rows.groupBy("path").agg(F.max(F.struct("version", "batch")).alias("n")).select("path", "n.*")
    return rows.join(newest, ["path", "version", "batch"]).filter(F.col(key).isNotNull()).drop("batch")
