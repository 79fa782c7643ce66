"""Audit rows and access reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import fixed

CHAT_LOG = T.StructType([
    T.StructField("event_time", T.TimestampType()), T.StructField("user_email", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("path", T.StringType()), T.StructField("intent", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("matched_chunks", T.IntegerType()),
    T.StructField("chunk_ids", T.StringType()), T.StructField("route_s", T.DoubleType()),
    T.StructField("retrieve_s", T.DoubleType()), T.StructField("generate_s", T.DoubleType()), T.StructField("error", T.StringType())])
COMPLIANCE_LOG = T.StructType(
    [T.StructField("seq", T.LongType())] + [T.StructField(c, T.StringType()) for c in fixed.CHAIN_FIELDS]
    + [T.StructField("prev_hash", T.StringType()), T.StructField("row_hash", T.StringType())])


def _has(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def to_chat_log(results: DataFrame, time_col: str = "event_time") -> DataFrame:
    """Request results as rows of the safe log: no question, no answer. Numbers that do not parse become null, and a
    request that was stopped has no chunks and null timings."""
    src = _has(results, "sources", "array<string>")
    n = F.coalesce(_has(results, "matched_chunks", "int"), F.size(F.coalesce(src, F.array().cast("array<string>"))))
    err = F.nullif(F.substring(_has(results, "error"), 1, fixed.LOG_ERROR_CHARS), F.lit(""))
    return results.select(
        F.col(time_col).cast("timestamp").alias("event_time"), "user_email", "status", _has(results, "path").alias("path"),
        _has(results, "intent").alias("intent"), _has(results, "model").alias("model"), n.cast("int").alias("matched_chunks"),
        F.coalesce(F.array_join(src, ","), F.lit("")).alias("chunk_ids"),
        *[_has(results, c).cast("string").try_cast("double").alias(c) for c in ("route_s", "retrieve_s", "generate_s")],
        err.alias("error"))


def to_compliance(results: DataFrame, private_model: str, model_version: str | None = None, log_text: bool = False,
                  time_col: str = "event_time") -> DataFrame:
    """Request results as the twelve hashed fields of the compliance log, all strings. The model version is kept for the
    private model only; a stop adds its reason to the flags; texts stay out unless enabled."""
    src = F.nullif(F.array_join(_has(results, "sources", "array<string>"), ","), F.lit(""))
    err = _has(results, "error")
    stop = F.when(F.coalesce(err, F.lit("")).cast("string").isin("") | ~F.col("status").isin("blocked", "denied"), None).otherwise(
        F.concat(F.lit("stopped: "), F.substring(err, 1, fixed.STOP_FLAG_CHARS)))
    flags = F.array_join(F.array_compact(F.concat(F.coalesce(_has(results, "flags", "array<string>"), F.array().cast("array<string>")), F.array(stop))), ",")
    model = _has(results, "model")
    version = _has(results, "model_version") if model_version is None else F.lit(model_version)
    text = lambda c: _has(results, c) if log_text else F.lit(None)
    t = F.date_format(F.col(time_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    cols = {
        "event_id": F.col("event_id") if "event_id" in results.columns else F.replace(F.uuid(), F.lit("-"), F.lit("")),
        "event_time": t, "user_email": F.col("user_email"), "status": F.col("status"), "path": _has(results, "path"),
        "intent": _has(results, "intent"), "model": model, "model_version": F.when(model == private_model, version),
        "chunk_ids": src, "flags": F.nullif(flags, F.lit("")), "question": text("question"), "answer": text("answer")}
    return results.select(*[cols[c].cast("string").alias(c) for c in fixed.CHAIN_FIELDS])


def flatten_access_audit(audit: DataFrame) -> DataFrame:
    """The nested columns of an access audit as plain ones."""
    return audit.select("event_time", F.col("user_identity.email").alias("user_email"),
                        F.col("request_params.full_name_arg").alias("table_name"), "action_name", "service_name")


ACCESS_ACTIONS = ["getTable", "generateTemporaryTableCredential"]


def protected_reads(reads: DataFrame, prefix: str, service: str = "catalog", actions: list[str] | None = None) -> DataFrame:
    return reads.filter((F.col("service_name") == service) & F.col("action_name").isin(actions or ACCESS_ACTIONS)
                        & F.col("table_name").startswith(prefix))


def access_review(reads: DataFrame, staff: DataFrame, prefix: str, null_aware: bool = False, **kw) -> DataFrame:
    """Reads of protected tables by people without an assignment. With ``null_aware`` it is exactly SQL's ``NOT IN``: one
    null among the assignments hides everything and a null reader is never reported. The default reports both."""
    hit = protected_reads(reads, prefix, **kw).select("event_time", "user_email", "table_name", "action_name")
    people = staff.select("staff_email").distinct()
    out = hit.join(people, F.col("user_email") == F.col("staff_email"), "left_anti")
    if null_aware:
        nulls = staff.agg(F.count_if(F.col("staff_email").isNull())).scalar()
        some = staff.agg(F.count(F.lit(1))).scalar()
        out = out.filter((some == 0) | ((nulls == 0) & F.col("user_email").isNotNull()))
    return out


def touches(reads: DataFrame, prefix: str, n: int | None = None, *ties: str) -> DataFrame:
    """Who touched protected tables, newest first."""
    out = reads.filter(F.col("table_name").startswith(prefix)).select("event_time", "user_email", "table_name", "action_name", *ties)
    out = out.orderBy(F.desc("event_time"), *ties)
    return out if n is None else out.limit(n)


def invariant_counts(log: DataFrame, external_model: str) -> DataFrame:
    """Must be 0: requests on the PHI path that the external model answered."""
    bad = (F.col("path") == "phi") & (F.col("model") == external_model)
    return log.agg(F.count_if(bad).alias("phi_answered_externally"))


def recent(df: DataFrame, order: str, n: int, *ties: str) -> DataFrame:
    """The most recent ``n`` rows (each task keeps its own ``n``)."""
    return df.orderBy(F.desc(order), *[F.desc(t) for t in ties]).limit(n)
