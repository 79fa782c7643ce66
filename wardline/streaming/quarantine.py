"""Expectations on streams: rows that fail are kept aside, and every row is accounted for.

A batch of a stream is written by one job, kept and dropped rows side by side as partitions of one table (``outcome=.../run=.../
batch_id=...``). A batch that is run again after a failure replaces exactly its own partitions, so neither side can have rows of a
batch that the other lacks. ``run`` is the id that a query keeps in its checkpoint; a new checkpoint never touches an old one's rows.

Counts come with the rows, from ``observe``, in the same pass: per batch as a row of the table ``_quality`` beside the data, written after
it and rewritten with it, and for whoever watches a running query as events (:class:`QualityListener`)."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from wardline.operators import quality

KEPT, DROPPED = "kept", "dropped"
COUNTS = "outcome string, rule string, rows long, run string, batch_id long"


class QualityListener(StreamingQueryListener):
    """What streams have observed, by (name of the observation, id of the query, batch). A batch that runs again is counted once. The
    sums live on the driver, one row per observation and batch; ``totals`` adds them up."""

    def __init__(self) -> None:
        self._seen: dict[tuple[str, str, int], dict[str, int]] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            for name, row in p.observedMetrics.items():
                self._seen[name, str(p.id), p.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self, name: str) -> dict[str, int]:
        out: dict[str, int] = {}
        with self._lock:
            for (n, _, _), row in self._seen.items():
                if n == name:
                    for k, v in row.items():
                        out[k] = out.get(k, 0) + (v or 0)
        return out


def checked(stream: DataFrame, rules: dict[str, Column], name: str, keys: list[str] | None = None,
            watermark: tuple[str, str] | None = None) -> DataFrame:
    """``stream`` with ``failed_rules`` (empty for rows that pass), rows with a known key left out of those that pass. Dropped rows
    are never thinned out. Observed as ``name``: rows, one count per rule, and as ``<name>_passed`` the rows that passed before keys
    were looked at. ``watermark`` (column, delay) bounds how long keys are remembered; choose a column that doesn't run behind, such as
    the time of arrival, or rows behind the watermark would be lost."""
    tagged = quality.tag(stream, rules)
    good = tagged.filter(F.size("failed_rules") == 0).observe(f"{name}_passed", F.count(F.lit(1)).alias("rows"))
    if keys:
        good = quality.dedupe(good, keys, watermark=watermark)
    out = good.unionByName(tagged.filter(F.size("failed_rules") > 0)) if rules else good
    return out.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.array_contains("failed_rules", r)).alias(f"failed_{r}") for r in rules])


def write_checked(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start the query that writes ``rows`` (of :func:`checked`) to the table at ``path``, with their counts."""
    spark = rows.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        outcome = F.when(F.size("failed_rules") == 0, KEPT).otherwise(DROPPED)
        seen = Observation()
        named = F.explode(F.when(F.size("failed_rules") > 0, F.col("failed_rules")).otherwise(F.array(F.lit(""))))
        out = batch.withColumns({"outcome": outcome, "run": F.lit(run), "batch_id": F.lit(batch_id).cast("long")})
        out = out.observe(seen, F.count_if(F.col("outcome") == KEPT).alias(KEPT), F.count_if(F.col("outcome") == DROPPED).alias(DROPPED))
        folder = f"run={run}/batch_id={batch_id}"
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("outcome", "run", "batch_id").parquet(path)
        # by rule from what was written: a row that fails two rules counts for both
        again = read_outcome(batch.sparkSession, path, batch.schema, DROPPED).filter((F.col("run") == run) & (F.col("batch_id") == batch_id))
        by_rule = again.select(named.alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows")) if seen.get[DROPPED] else None
        total = batch.sparkSession.createDataFrame([(o, "", seen.get[o]) for o in (KEPT, DROPPED)], "outcome string, rule string, rows long")
        if by_rule is not None:
            total = total.unionByName(by_rule.select(F.lit(DROPPED).alias("outcome"), "rule", "rows"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{path}/_quality/{folder}")

    w = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_outcome(spark: SparkSession, path: str, schema: T.StructType, outcome: str) -> DataFrame:
    """The kept or the dropped rows of a table, with ``run`` and ``batch_id``; only their own partitions are read. None yet: no rows."""
    full = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType())])
    folder = f"{path}/outcome={outcome}"
    return spark.read.schema(full).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], full)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Per batch: outcome, rule (empty: all rows of the outcome), rows, run, batch_id."""
    folder = f"{path}/_quality"
    # a name with an underscore is hidden from those who read the table, and has to be named to be read itself
    return spark.read.schema(COUNTS).option("basePath", folder).parquet(f"{folder}/run=*") if _exists(spark, folder) else spark.createDataFrame([], COUNTS)
