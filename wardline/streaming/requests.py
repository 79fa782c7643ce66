"""A stream of questions: limit, answer, log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import fixed
from wardline.operators import audit, chain
from wardline.plans.answer import Sources, answer_batch, finish_batch
from wardline.session import cut
from wardline.streaming.limits import rate_limit_stream


#: the compliance log is this many chains, by a hash of the user
CHAINS = 32


def _put(df: DataFrame, path: str, run: str, batch_id: int) -> str:
    """Add one micro-batch under a folder of its own. The run is the id that the query keeps in its checkpoint: a batch that is run again
    after a failure writes its own folder again, and a query with a new checkpoint writes beside the old one, never over it."""
    folder = f"{path}/run={run}/batch_id={batch_id}"
    df.write.mode("overwrite").parquet(folder)
    return folder


def _heads(spark, path: str, run: str, batch_id: int) -> DataFrame | None:
    """The end of every chain in the whole log before this batch; each batch leaves at most CHAINS rows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    all_ = spark.read.schema("chain int, seq long, row_hash string, run string, batch_id long").parquet(path)
    before = all_.filter((F.col("run") != run) | (F.col("batch_id") < batch_id))
    return before.groupBy("chain").agg(F.max_by(F.struct("seq", "row_hash"), "seq").alias("e")).select("chain", "e.*")


def handle_batch(batch: DataFrame, batch_id: int, sources: Callable[[], Sources], out: str,
                 replies: Callable[[DataFrame], DataFrame] | None = None, log_text: bool = False, model_version: str | None = None) -> None:
    """Answer one micro-batch and add it to the results, the safe log and the compliance chains. ``replies`` turns rows
    that wait for a model into (question_id, reply). Requests behind the watermark are refused in the results and kept whole in the table
    ``late``, so that whoever asked can be told and they can be sent again."""
    spark, src = batch.sparkSession, sources()
    run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
    batch = cut(batch)                  # else every step below would run the admission of the stream again
    asked = batch.filter("admitted")
    done = answer_batch(asked, src)
    if replies is not None:
        waiting = done.filter((F.col("status") == "ok") & F.col("model").isin(src.private_model, src.external_model))
        done = finish_batch(done, replies(waiting), src)
    limited = batch.filter("not admitted").select("question_id", "user_email", F.lit("limited").alias("status"), F.when(F.col("late"), fixed.LATE_MSG).otherwise(fixed.RATE_LIMITED_MSG).alias("error"))
    results = _put(done.unionByName(limited, allowMissingColumns=True), f"{out}/results", run, batch_id)
    _put(batch.filter("late").drop("admitted", "late"), f"{out}/late", run, batch_id)
    r = spark.read.parquet(results).filter("status <> 'limited'").join(asked.select("question_id", "event_time"), "question_id")
    _put(audit.to_chat_log(r), f"{out}/chat_log", run, batch_id)
    rec = audit.to_compliance(r.withColumn("event_id", F.sha2(F.col("question_id").cast("string"), 256)), src.private_model, model_version, log_text)
    rec = rec.withColumn("chain", F.pmod(F.xxhash64(F.coalesce("user_email", F.lit(""))), F.lit(CHAINS)).cast("int"))
    linked = chain.chain(rec, ["event_time", "event_id"], ["chain"], last=_heads(spark, f"{out}/chain_head", run, batch_id))
    log = spark.read.parquet(_put(linked, f"{out}/compliance_log", run, batch_id))
    _put(chain.chain_heads(log, ["chain"]).coalesce(1), f"{out}/chain_head", run, batch_id)


def serve_requests(questions: DataFrame, sources: Callable[[], Sources], out: str, checkpoint: str, limit: int = fixed.USER_LIMIT,
                   window_seconds: int = fixed.USER_WINDOW_SECONDS, **kw):
    """Start the query over a stream of (question_id, user_email, question, event_time). ``sources`` is called per
    micro-batch, so new patients and tags are seen without a restart."""
    limited = rate_limit_stream(questions, "user_email", "event_time", "question_id", limit, window_seconds)
    return (limited.writeStream.foreachBatch(lambda df, n: handle_batch(df, n, sources, out, **kw))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
