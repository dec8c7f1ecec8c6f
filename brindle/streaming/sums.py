"""Grouped sums and carried summaries over streams of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def grouped_sums(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, feature_id, total) of a stream of counts, labels being static; run it in update or complete mode."""
    return counts.join(labels, "cell_id").groupBy("label", "feature_id").agg(F.sum("value").alias("total"))


def windowed_sums(events: DataFrame, every: str, late: str, by: str = "event_type", value: str = "value") -> DataFrame:
    """Sums of tumbling windows by event time; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def carry(counts: DataFrame, labels: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's sums under ``path`` as generations of their own; a batch that is run again replaces its own."""

    def add(batch: DataFrame, number: int) -> None:
        sums = batch.join(labels, "cell_id").groupBy("label", "feature_id").agg(F.sum("value").alias("total"))
        sums.write.mode("overwrite").parquet(f"{path}/generation={number}")

    return counts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(carried: DataFrame) -> DataFrame:
    """All generations together."""
    return carried.groupBy("label", "feature_id").agg(F.sum("total").alias("total"))
