"""Which prompt and model version answered a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline import fixed


def prompt_versions(spark, rows) -> DataFrame:
    """(version, path, prompt_text, change_note, valid_from) of every prompt that was ever live."""
    return spark.createDataFrame(rows, "version string, path string, prompt_text string, change_note string, valid_from timestamp")


def current_prompts() -> list[tuple[str, str]]:
    return [("phi", fixed.PHI_SYSTEM_PROMPT), ("general", fixed.GENERAL_SYSTEM_PROMPT)]


def lineage_asof(requests: DataFrame, versions: DataFrame, endpoint: str = "endpoint", ts: str = "event_time",
                 valid_from: str = "valid_from", version: str = "version") -> DataFrame:
    """Adds the version of the request's endpoint that was live at its time (null before the first one).

    A few endpoints share all requests, so the endpoint alone would put each into one task. Hours split them: per endpoint
    and hour there is the version carried in from before, found on the small set of hours that occur. Versions and requests
    of an hour then go through one sort by time, in which each request takes the last version before it, so the work grows
    with the rows and not with the pairs of requests and versions of an hour."""
    names, kind = requests.columns, versions.schema[valid_from].dataType
    v = versions.select(F.col(endpoint).alias("_e"), F.col(valid_from).alias("_t"), F.struct(F.col(version).alias("_v"), F.col(valid_from).alias("_f")).alias("_live"))
    v = v.filter("_e is not null and _t is not null").withColumn("_h", F.date_trunc("hour", "_t"))
    r = requests.select(F.col(endpoint).alias("_e"), F.col(ts).cast(kind).alias("_t"), F.struct(*[F.col(c) for c in names]).alias("_r"))
    r = r.withColumn("_h", F.date_trunc("hour", "_t"))
    hours = r.select("_e", "_h").distinct()
    last = v.groupBy("_e", "_h").agg(F.max_by("_live", "_t").alias("_last"))
    w = W.partitionBy("_e").orderBy("_h").rowsBetween(W.unboundedPreceding, -1)
    carried = (hours.join(last, ["_e", "_h"], "full").withColumn("_live", F.last("_last", ignorenulls=True).over(w))
               .filter("_live is not null and _h is not null").select("_e", "_h", F.col("_live._f").alias("_t"), "_live"))
    # at one instant the version comes before the requests
    both = carried.unionByName(v).withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r.withColumn("_live", F.lit(None).cast(v.schema["_live"].dataType)))
    run = W.partitionBy("_e", "_h").orderBy("_t", F.col("_r").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    return (both.withColumn("_live", F.last("_live", ignorenulls=True).over(run)).filter("_r is not null")
            .select(*[F.col(f"_r.`{c}`") for c in names], F.col("_live._v").alias(version), F.col("_live._f").alias(valid_from)))


def decision_rows(routed: DataFrame, prompt_version: str, private_model: str, external_model: str) -> DataFrame:
    """One row per routing decision, without the question text."""
    return routed.select(
        "question_id", F.when(F.col("phi"), "phi_private").otherwise("general_external").alias("decision"),
        F.when(F.col("phi"), private_model).otherwise(external_model).alias("endpoint"),
        F.array_join("tables", ",").alias("matched_tables"), F.lit(prompt_version).alias("prompt_version"), "reason")


def endpoint_history(changes: DataFrame, endpoint: str = "endpoint") -> DataFrame:
    """``changes`` (endpoint, valid_from, what became live, and valid_to where an endpoint was retired without a successor) as a history:
    each state ends at ``valid_to``, or where the next one starts if that is earlier or no end was given."""
    following = F.lead("valid_from").over(W.partitionBy(endpoint).orderBy("valid_from"))
    return changes.withColumn("ends", F.least(F.col("valid_to"), following))


def history_problems(changes: DataFrame, endpoint: str = "endpoint") -> DataFrame:
    """endpoint, problem, starts, ends: ``overlap`` where a state was to last beyond the start of the next, ``gap`` where none was live
    between two, ``inverted`` where a state ends before it starts. One row per problem; neighbours only, by one window per endpoint."""
    w = W.partitionBy(endpoint).orderBy("valid_from")
    d = changes.withColumn("_next", F.lead("valid_from").over(w))
    row = lambda name, ok, a, b: F.when(ok, F.struct(F.lit(name).alias("problem"), a.alias("starts"), b.alias("ends")))
    start, end, following = F.col("valid_from"), F.col("valid_to"), F.col("_next")
    found = F.array(row("inverted", end < start, end, start), row("overlap", (end >= start) & (end > following), following, end), row("gap", F.greatest(start, end) < following, F.greatest(start, end), following))
    found = F.when(end.isNull(), F.array().cast("array<struct<problem:string,starts:timestamp,ends:timestamp>>")).otherwise(F.array_compact(found))
    return d.select(endpoint, F.explode(found).alias("x")).select(endpoint, "x.*")


def request_lineage(requests: DataFrame, prompts: DataFrame, changes: DataFrame, ts: str = "event_time") -> DataFrame:
    """``requests`` (with ``path`` and ``endpoint``) with what answered them: ``prompt_version``, ``model``, ``model_version``,
    ``provider``, and ``in_gap`` where no state of the endpoint was live, with nothing in its columns then.
    ``prompts``: path, version, valid_from. ``changes``: endpoint, model, version, provider, valid_from, valid_to."""
    p = prompts.select("path", F.col("version").alias("prompt_version"), F.col("valid_from").alias("_prompt_from"))
    r = lineage_asof(requests, p, "path", ts, "_prompt_from", "prompt_version").drop("_prompt_from")
    # a state that ends as it starts, as the first of two of one instant does, is never live, and neither is the one before it by then
    h = endpoint_history(changes).filter("ends is null or ends > valid_from")
    h = h.select("endpoint", "valid_from", F.struct("model", F.col("version").alias("model_version"), "provider", "ends").alias("_state"))
    r = lineage_asof(r, h, "endpoint", ts, "valid_from", "_state").drop("valid_from")
    live = F.col("_state").isNotNull() & (F.col("_state.ends").isNull() | (F.col(ts) < F.col("_state.ends")))
    return r.select(*[c for c in r.columns if c != "_state"], *[F.when(live, F.col(f"_state.{c}")).alias(c) for c in ("model", "model_version", "provider")], (~live).alias("in_gap"))
