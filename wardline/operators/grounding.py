"""Checks on model replies: grounding in the records, leaks, and what to show instead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import fixed
from wardline.functions import parse as P
from wardline.functions import text as X
from wardline.operators.route import with_identifiers
from wardline.session import cut, small_lookup

MATCHED = 500_000       # ids of matched records up to this number travel to every task


def records_of(matches: DataFrame, chunks: DataFrame, id_col: str = "question_id") -> DataFrame:
    """The matched records of each question in rank order: the raw texts and their Markdown. At most the k records of
    retrieval are gathered per question. Of all records only the matched ones travel, and each is rendered once."""
    matches = cut(matches)
    found = chunks.select("chunk_id", "content").join(small_lookup(matches.select("chunk_id").distinct(), MATCHED), "chunk_id", "left_semi")
    m = matches.join(P.format_record(found, "content", "_md"), "chunk_id")
    g = m.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content", "_md"))).alias("_r"))
    return g.select(id_col, F.transform("_r", lambda x: x["chunk_id"]).alias("sources"),
                    F.transform("_r", lambda x: x["content"]).alias("records"),
                    F.transform("_r", lambda x: x["_md"]).alias("markdown"))


def check_grounded(answers: DataFrame, records: DataFrame, id_col: str = "question_id", answer: str = "answer") -> DataFrame:
    """Adds ``unsupported`` (facts of the answer that its records do not hold) and ``shown``: the answer, or the records
    themselves when there are any unsupported facts. ``records`` is what :func:`records_of` gives; without a column
    ``markdown`` the texts are shown as they are, and travel only once."""
    shown = "markdown" if "markdown" in records.columns else "records"
    a = answers.join(records, id_col, "left")
    joined = F.coalesce(F.array_join("records", " "), F.lit(""))
    a = a.withColumn("unsupported", X.unsupported_facts(F.col(answer), joined))
    fallback = F.concat(F.lit(fixed.UNVERIFIED_PREFIX), F.coalesce(F.array_join(shown, "\n\n"), F.lit("")))
    return a.withColumn("shown", F.when(F.size("unsupported") > 0, fallback).otherwise(F.col(answer))).select(
        *answers.columns, "unsupported", "shown")


def block_leaks(prompts: DataFrame, names: DataFrame | None, id_col: str = "question_id", context: str = "context",
                answer: str | None = None, fuzzy: bool = True) -> DataFrame:
    """Adds ``status`` and ``message`` for the general path: records with identifiers must not leave (``failed``), a reply
    with identifiers is withheld (``blocked``), everything else is ``ok``."""
    c = with_identifiers(prompts, names, id_col, context, "_ctx", fuzzy)
    reply = F.lit(None).cast("array<string>")
    if answer:
        c, reply = with_identifiers(c, names, id_col, answer, "_out", fuzzy), F.col("_out")
    from wardline.session import text_list

    bad_ctx, bad_out = F.size("_ctx") > 0, F.coalesce(F.size(reply) > 0, F.lit(False))
    status = F.when(bad_ctx, "failed").when(bad_out, "blocked").otherwise("ok")
    msg = (F.when(bad_ctx, F.format_string(fixed.CONTEXT_LEAK_MSG, text_list(F.col("_ctx"))))
           .when(bad_out, F.format_string(fixed.REPLY_LEAK_MSG, F.array_join(reply, ", "))))
    return c.select(*prompts.columns, status.alias("status"), msg.alias("message"))


def build_prompts(questions: DataFrame, records: DataFrame, id_col: str = "question_id", col: str = "question",
                  phi: str = "phi") -> DataFrame:
    """One prompt per question that has records: system text of its path, records as delimited list lines, question."""
    q = questions.join(records, id_col)
    ctx = F.array_join(F.transform("records", lambda x: F.concat(F.lit("- "), x)), "\n")
    system = F.when(F.col(phi), F.lit(fixed.PHI_SYSTEM_PROMPT)).otherwise(F.lit(fixed.GENERAL_SYSTEM_PROMPT))
    user = F.concat(F.lit("<records>\n"), ctx, F.lit("\n</records>\n\nQuestion: "), F.col(col))
    return q.select(id_col, phi, ctx.alias("context"), system.alias("system"), user.alias("prompt"))
