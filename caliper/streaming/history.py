"""Incremental run-history summaries (an extension: the batch operators have the same results)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_history(events: DataFrame, ts: str, kind: str, value: str, width: str, late: str) -> DataFrame:
    """(start, kind, n, mean, most) in tumbling windows of event time; events later than `late` are left out."""
    w = F.window(ts, width)
    by = events.withWatermark(ts, late).groupBy(w.alias("w"), kind)
    return by.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most")).select(F.col("w.start").alias("start"), kind, "n", "mean", "most")


def sessions(events: DataFrame, ts: str, user: str, gap: str, late: str) -> DataFrame:
    """(start, user, n): runs of a user's events with no pause as long as gap."""
    by = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user)
    return by.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), user, "n")


def latest_into(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs the stream over what is there; after each batch the complete summary is a folder of its own under path."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
