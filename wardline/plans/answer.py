"""Answer a table of questions: screen, route, check access, count or retrieve, and decide what a model is asked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed
from wardline.functions import text as X
from wardline.operators import grounding, policy, retrieve, route
from wardline.operators.tags import Registry
from wardline.session import cut, stored

COLUMNS = ["question_id", "user_email", "question", "status", "path", "intent", "reason", "model", "answer", "sources",
           "matched_chunks", "flags", "error", "context", "system", "prompt", "records", "markdown"]


@dataclass
class Sources:
    """What questions are answered from. ``phi_chunks`` needs ``chunk_id, unit, content``, ``general_chunks`` needs
    ``chunk_id, content``; ``groups`` and ``staff`` decide which units a reader sees."""

    phi_chunks: DataFrame
    general_chunks: DataFrame
    registry: Registry
    groups: DataFrame
    staff: DataFrame
    private_model: str = "private-model"
    external_model: str = "external-model"
    intent_tables: dict | None = None


def _shape(df: DataFrame, **cols: Column) -> DataFrame:
    """All result columns, nulls where a branch has nothing to say."""
    types = {"sources": "array<string>", "flags": "array<string>", "records": "array<string>", "markdown": "array<string>", "matched_chunks": "long"}
    have = set(df.columns)
    pick = lambda c: cols[c] if c in cols else F.col(c) if c in have else F.lit(None)
    return df.select(*[pick(c).cast(types.get(c, "string")).alias(c) if c != "question_id" else F.col(c) for c in COLUMNS])


def answer_batch(questions: DataFrame, src: Sources, k: int = fixed.TOP_K, fuzzy: bool = True) -> DataFrame:
    """One row per question (``question_id, user_email, question``), stopped ones included with their status and reason.

    Rows whose ``model`` is one of the two models carry the prompt and wait for a reply (:func:`finish_batch`); all
    others are answered. A question is screened before anything is joined to it, and each later step only sees the
    questions that are still open, so the dear joins run on the fewest rows."""
    screened = route.screen(questions.select("question_id", "user_email", "question"))
    blocked = _shape(screened.filter("blocked_reason is not null"), status=F.lit("blocked"), error=F.col("blocked_reason"), matched_chunks=F.lit(0))
    open_ = screened.filter("blocked_reason is null").drop("blocked_reason")
    names = cut(src.registry.names)
    reg = Registry(src.registry.phi, src.registry.known, names)
    routed = cut(route.redirect_leaks(cut(route.route(open_, reg, src.intent_tables)), names, fuzzy=fuzzy))
    routed = routed.withColumn("path", F.when(F.col("phi"), "phi").otherwise("general"))
    denied = _shape(routed.filter("phi and user_email is null").drop("path", "intent", "reason", "flags"), status=F.lit("denied"),
                    error=F.lit(fixed.DENIED_NO_IDENTITY), matched_chunks=F.lit(0))
    going = routed.filter("not phi or user_email is not null")

    scopes = policy.reader_scopes(going.filter("phi"), src.groups, src.staff)
    none = F.array().cast("array<string>")
    going = going.join(scopes, "user_email", "left").withColumn(
        "sees_all", ~F.col("phi") | F.coalesce("sees_all", F.lit(False))).withColumn("units", F.coalesce("units", none))
    counting = F.col("phi") & X.is_count_question(F.col("question"))

    to_count = going.filter(counting)
    c = retrieve.count_entities(to_count, src.phi_chunks)
    counted = _shape(to_count.join(c, "question_id"), status=F.lit("ok"), model=F.lit(fixed.MODEL_COUNT),
                     answer=retrieve.count_answer(F.col("entities"), F.col("unit_scope")), matched_chunks=F.col("matched_rows"))

    chunks = src.phi_chunks.select("chunk_id", "unit", "content", F.lit("phi").alias("side")).unionByName(
        src.general_chunks.select("chunk_id", F.lit(None).cast("string").alias("unit"), "content", F.lit("general").alias("side")))
    to_find = going.filter(~counting).withColumn("side", F.col("path"))
    matches = retrieve.retrieve(to_find, chunks, k)
    rec = stored(grounding.records_of(matches, chunks))
    prompts = grounding.build_prompts(to_find, rec).drop("phi")
    found = to_find.join(rec, "question_id", "left").join(prompts, "question_id", "left")
    n = F.coalesce(F.size("sources"), F.lit(0))
    listed = F.concat(F.lit("**"), n.cast("string"), F.lit(" matching records**\n\n"), F.array_join("markdown", "\n\n"))
    missing = (n == 0)
    many = F.col("phi") & (n > 1)
    model = (F.when(missing, fixed.MODEL_NO_RECORDS).when(many, fixed.MODEL_LISTED)
             .when(F.col("phi"), src.private_model).otherwise(src.external_model))
    found = found.withColumn("model", model).withColumn("matched_chunks", n).withColumn(
        "answer", F.when(missing, F.lit(fixed.NO_RECORDS_ANSWER)).when(many, listed))
    found = stored(found)
    waits = F.col("answer").isNull()
    settled = _shape(found.filter(~waits | F.col("phi")), status=F.lit("ok"),
                     **{x: F.when(waits, F.col(x)) for x in ("context", "system", "prompt")})
    # general records must hold no identifier; those that do are refused, never sent
    out = grounding.block_leaks(found.filter(waits & ~F.col("phi")), names, fuzzy=fuzzy)
    sent = _shape(out.filter("status = 'ok'"))
    refused = _shape(out.filter("status <> 'ok'").drop("path", "intent", "reason", "model", "sources", "flags", "context", "system", "prompt", "records", "markdown"),
                     error=F.col("message"), matched_chunks=F.lit(0))
    all_ = blocked
    for part in (denied, counted, settled, sent, refused):
        all_ = all_.unionByName(part)
    return all_


def finish_batch(answered: DataFrame, replies: DataFrame, src: Sources, fuzzy: bool = True) -> DataFrame:
    """Model replies (``question_id, reply``) brought back: a general reply with identifiers is withheld, and a reply that
    states a fact its records do not hold is replaced by the records. Rows that wait for no reply pass through."""
    waits = F.col("model").isin(src.private_model, src.external_model) & (F.col("status") == "ok")
    rest = answered.filter(~F.coalesce(waits, F.lit(False)))
    w = answered.filter(waits).join(replies.select("question_id", "reply"), "question_id", "left")
    lost = w.filter("reply is null")
    got = w.filter("reply is not null")
    leaky = route.with_identifiers(got.filter("path = 'general'"), src.registry.names, "question_id", "reply", "_kinds", fuzzy)
    bad = F.size("_kinds") > 0
    withheld = _shape(leaky.filter(bad).drop("path", "intent", "reason", "model", "sources", "flags", "context", "system", "prompt", "records", "markdown"),
                      status=F.lit("blocked"), error=F.format_string(fixed.REPLY_LEAK_MSG, F.array_join("_kinds", ", ")), matched_chunks=F.lit(0))
    clean = got.filter("path = 'phi'").unionByName(leaky.filter(~bad).drop("_kinds"))
    missing = X.unsupported_facts(F.col("reply"), F.array_join("records", " "))
    clean = clean.withColumn("_missing", missing)
    failed = F.size("_missing") > 0
    shown = F.when(failed, F.concat(F.lit(fixed.UNVERIFIED_PREFIX), F.array_join("markdown", "\n\n"))).otherwise(F.col("reply"))
    flags = F.when(failed, F.concat(F.col("flags"), F.array(F.lit(fixed.FLAG_UNGROUNDED)))).otherwise(F.col("flags"))
    checked = _shape(clean, answer=shown, flags=flags)
    none = _shape(lost.drop("path", "intent", "reason", "model", "sources", "flags"), status=F.lit("failed"),
                  error=F.lit("RuntimeError: model call gave no reply"), matched_chunks=F.lit(0))
    return rest.unionByName(withheld).unionByName(checked).unionByName(none)
