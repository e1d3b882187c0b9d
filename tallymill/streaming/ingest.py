"""Micro-batch ingest: store, statistics state and drift in one foreachBatch.

Each batch's rows and state are written under its batch id, replacing what an
earlier attempt left there, so a restart neither loses nor doubles anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators import stats

NUMERIC_STATE = (
    "column string, count long, sum double, min double, max double, mean double, m2 double, zero_count long, missing long, nonvalid long, batch_id long"
)
LEVEL_STATE = "column string, level string, count long, batch_id long"


def ingest(stream: DataFrame, folder: str, numeric: list[str], categorical: list[str], after: Callable[[SparkSession, str], None] | None = None, **options):
    """Start the query over what is there now; ``after(spark, folder)`` runs after each batch."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}")
            if numeric:
                stats.numeric_state(batch, numeric).coalesce(1).write.mode("overwrite").parquet(f"{folder}/numeric/batch_id={batch_id}")
            if categorical:
                stats.level_counts(batch, categorical).write.mode("overwrite").parquet(f"{folder}/levels/batch_id={batch_id}")
        finally:
            batch.unpersist()
        if after is not None:
            after(spark, folder)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(options or {"availableNow": True})).start()


def numeric_state(spark: SparkSession, folder: str) -> DataFrame:
    return stats.merge_numeric(spark.read.schema(NUMERIC_STATE).parquet(f"{folder}/numeric").drop("batch_id"))


def level_state(spark: SparkSession, folder: str) -> DataFrame:
    return stats.merge_levels(spark.read.schema(LEVEL_STATE).parquet(f"{folder}/levels").drop("batch_id"))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by event-time window and key, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), key, "count")
