"""Streaming forms of the monitoring views: counts per event-time window, final once the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import fixed


def _windowed(log: DataFrame, size: str, delay: str) -> DataFrame:
    return log.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", delay).withColumn(
        "_w", F.window("event_time", size))


def routing_mix_stream(log: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Answered questions per window and path. The share of the window needs all its paths, so it is taken when the
    finished windows are read (:func:`with_share`)."""
    return _windowed(log.filter("status = 'ok'"), size, delay).groupBy("_w", "path").agg(F.count(F.lit(1)).alias("questions")).select(
        F.col("_w.start").alias("window_start"), "path", "questions")


def with_share(mix: DataFrame) -> DataFrame:
    total = mix.groupBy("window_start").agg(F.sum("questions").alias("_all"))
    return mix.join(total, "window_start").withColumn("pct", F.round(100 * F.col("questions") / F.col("_all"), 1)).drop("_all")


def grounding_stream(log: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    g = _windowed(log, size, delay).groupBy("_w", F.coalesce("path", F.lit(fixed.STOPPED_PATH_LABEL)).alias("path"))
    empty = F.col("matched_chunks") == 0
    return g.agg(F.count(F.lit(1)).alias("questions"), F.count_if(empty).alias("no_records_matched"),
                 F.round(100 * F.avg(F.when(empty, 1.0).otherwise(0.0)), 1).alias("pct_no_records"),
                 *[F.count_if(F.col("status") == s).alias(s) for s in ("failed", "blocked", "denied")]).select(
        F.col("_w.start").alias("window_start"), "path", "questions", "no_records_matched", "pct_no_records", "failed", "blocked", "denied")


def latency_stream(log: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    total = F.col("route_s") + F.col("retrieve_s") + F.col("generate_s")
    return _windowed(log.filter("status = 'ok'"), size, delay).groupBy("_w", "path", "model").agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.avg(total), 1).alias("avg_total_s"),
        F.round(F.percentile_approx(total, 0.95), 1).alias("p95_total_s"), F.round(F.avg("generate_s"), 1).alias("avg_generate_s")).select(
        F.col("_w.start").alias("window_start"), "path", "model", "questions", "avg_total_s", "p95_total_s", "avg_generate_s")
