"""Monitoring views over the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline import fixed


def routing_mix_daily(log: DataFrame) -> DataFrame:
    """Answered questions per day and path with their share of the day. The window runs over the counts."""
    day = F.to_date("event_time")
    g = log.filter("status = 'ok'").groupBy(day.alias("day"), "path").agg(F.count(F.lit(1)).alias("questions"))
    share = F.round(100 * F.col("questions") / F.sum("questions").over(W.partitionBy("day")), 1)
    return g.withColumn("pct_of_day", share)


def grounding_daily(log: DataFrame, answered_only: bool = False) -> DataFrame:
    """Per day and path: questions without a matching record, failed, blocked and denied. Stopped requests matched
    nothing either and count as such unless ``answered_only``."""
    src = log.filter("status = 'ok'") if answered_only else log
    empty = F.when(F.col("matched_chunks") == 0, 1.0).otherwise(0.0)
    return src.groupBy(F.to_date("event_time").alias("day"), F.coalesce("path", F.lit(fixed.STOPPED_PATH_LABEL)).alias("path")).agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(F.col("matched_chunks") == 0).alias("no_records_matched"),
        F.round(100 * F.avg(empty), 1).alias("pct_no_records"),
        *[F.count_if(F.col("status") == s).alias(a) for s, a in
          [("failed", "failed"), ("blocked", "blocked_by_guardrail"), ("denied", "access_denied")]])


def latency_hourly(log: DataFrame) -> DataFrame:
    """Per hour, path and model: questions, mean and 95th percentile of the total time, mean of the generation time."""
    total = F.col("route_s") + F.col("retrieve_s") + F.col("generate_s")
    return log.filter("status = 'ok'").groupBy(F.date_trunc("hour", "event_time").alias("hour"), "path", "model").agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.avg(total), 1).alias("avg_total_s"),
        F.round(F.percentile_approx(total, 0.95), 1).alias("p95_total_s"), F.round(F.avg("generate_s"), 1).alias("avg_generate_s"))


def monitoring_views(log: DataFrame) -> dict:
    """Name → query, for :func:`wardline.sources.tables.register_views`."""
    return {"routing_mix_daily": lambda: routing_mix_daily(log), "grounding_daily": lambda: grounding_daily(log),
            "latency_hourly": lambda: latency_hourly(log)}
