"""Structured Streaming forms of the batch operators (extensions of ours): dedup on append, and walks by inactivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.functions.columns import url_key


def timed(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """With the event time as an instant, which watermarks need."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def unseen_urls(stream: DataFrame, url: str = "url", ts: str = "ts", delay: str = "7 days") -> DataFrame:
    """Rows whose url key wasn't seen within the watermark; state is bounded by the delay."""
    keyed = timed(stream, ts).withColumn("url_key", url_key(F.col(url))).where("url_key <> ''")
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["url_key"])


def walks_by_inactivity(stream: DataFrame, gap: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """(user_id, begin, end, n, path): a walk ends after a gap without events; late rows beyond the delay are left out."""
    grouped = timed(stream).withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    events = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return grouped.agg(F.count(F.lit(1)).alias("n"), events.alias("e")).select(
        "user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", F.array_join(F.transform("e", lambda x: x["event_type"]), ">").alias("path")
    )


def activity_counts(stream: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(begin, event_type, n) by tumbling windows."""
    w = F.window("ts", width).alias("w")
    return timed(stream).withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("begin"), "event_type", "n")


def merge_batches(stream: DataFrame, path: str, url: str = "url"):
    """A sink that appends each micro-batch's unseen rows to a Parquet table; a batch that is run again changes nothing."""
    from tracework.sources.sinks import append_lookup

    return stream.writeStream.foreachBatch(lambda rows, _: append_lookup(rows, path, url))
