"""Incremental refresh of extractions from a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.extract import extractions
from quarry.sources import snapshots


def refresh_stream(spark: SparkSession, incoming: str, target: str, checkpoint: str):
    """Parquet files (path, language, text) that arrive in ``incoming`` replace their rows in ``target``, a table in slots.

    Of several versions of a path in a batch the one in the newest file counts, by
    modification time, then by file name.  Batch n reads and rewrites the slots of its
    paths alone and becomes version n of the table, so a batch that runs twice gives
    the same result; it fails where the version before is missing.
    """
    stream = spark.readStream.schema("path string, language string, text string").parquet(incoming)
    stream = stream.select("path", "language", "text", F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("age"))

    def merge(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by(F.struct("language", "text"), "age").alias("row")).select("path", "row.*")
        fresh = extractions(newest)
        if number == 0:
            snapshots.write(fresh, target, "path", version=0)
            return
        snapshots.forget(spark, target, number)
        if number - 1 not in snapshots.versions(spark, target):
            raise FileNotFoundError(f"batch {number} needs version {number - 1} of {target}, which is missing")
        snapshots.upsert(spark, target, fresh, version=number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
