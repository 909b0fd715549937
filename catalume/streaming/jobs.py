"""Structured Streaming forms of the log, catalog and queue operators; batch results are their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.logs import job_class, rule
from ..operators.snapshot import apply_snapshot


def stream_daily_counts(logs: DataFrame, lateness: str = "1 hour", slide: str | None = None, length: str = "1 day") -> DataFrame:
    """I8: identification counts per day (or sliding window) of a stream of parsed lines."""
    each = logs.withWatermark("ts", lateness).withColumn("rule", rule())
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return each.groupBy(window).agg(*[F.count_if(F.coalesce(F.col("rule") == r, F.lit(False))).alias(n) for r, n in (("lookup", "lookups"), ("recognized", "recognized"), ("notfound", "notfound"), ("process", "process"))]).select(F.col("window.start").alias("start"), "lookups", "recognized", "notfound", "process")


def stream_durations(logs: DataFrame, gap: str = "60 seconds", lateness: str = "1 hour") -> DataFrame:
    """One row per finished run: lines at most ``gap`` apart of one job and day."""
    each = logs.withWatermark("ts", lateness).withColumn("class", job_class(F.col("context"))).where("class is not null")
    run = each.groupBy(F.session_window("ts", gap), F.to_date("ts").alias("day"), "context", "class").agg(F.count("*").alias("lines"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return run.select("day", "context", "class", "lines", ((F.unix_micros("last") - F.unix_micros("first")) / 1e6).alias("seconds"))


def stream_distinct_jobs(logs: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each job context once."""
    return logs.withWatermark("ts", lateness).withColumn("class", job_class(F.col("context"))).where("class is not null").dropDuplicatesWithinWatermark(["context"]).select("ts", "class", "context")


def stream_drain(samples: DataFrame, length: str = "6 hours", slide: str = "30 minutes", lateness: str = "1 hour", flat_per_day: float = 1.0) -> DataFrame:
    """Slope of the queue depth per sliding window, with done and plateau flags; ``samples(ts, total)``."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = samples.withWatermark("ts", lateness).groupBy(F.window("ts", length, slide)).agg(F.regr_slope(F.col("total").cast("double"), t).alias("slope"), F.min("total").alias("least"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9).alias("span_hours"))
    return w.select(F.col("window.end").alias("at"), "slope", (F.col("least") == 0).alias("done"), (F.abs(F.col("slope") * 86400) < flat_per_day).alias("plateau"), "span_hours")


def stream_catalog(listings: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, DataFrame, int], None], checkpoint: str):
    """Every micro-batch of listings becomes the next catalog version.

    ``load()`` gives the version before, ``store(table, log, batch_id)`` writes the next one
    under the batch's id, so a batch that runs again replaces its own output only. Of rows
    of one key within a batch the latest mtime wins.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("dir", "filename").agg(F.max_by(F.struct("size", "hash"), "mtime").alias("v")).select("dir", "filename", "v.size", "v.hash")
        store(*apply_snapshot(load(), latest), batch_id)

    return listings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
