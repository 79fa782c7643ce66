"""Exact duplicates by two-pass Bloom filtering.

Pass one hashes every text and builds a filter of the bits that two or more rows set. Pass two probes it: a row it rejects has a text of
its own and passes straight through; only the others, which may repeat, are shuffled and grouped by SHA-256.

Defined results: a null text counts as empty. Of equal texts the row with the largest doc_id stays (a null id is smaller than any). Rows
that repeat both id and text are one document to ``decisions`` (all get the same answer), and ``unique`` keeps one of them. Extra columns
pass through ``unique`` unchanged; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import attach, keep


def _sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    d = keep(docs.select(F.col(id_col).alias("doc_id"), _sha(F.col(text_col)).alias("text_sha256"))).withColumn("_h", F.xxhash64("text_sha256"))
    n = d.count()
    seen = bloom.probe(d, keep(bloom.repeated(d, "_h", n)), "_h", n, "_maybe").drop("_h")
    maybe = seen.where("_maybe").drop("_maybe")
    groups = keep(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    grouped = attach(maybe, groups, "text_sha256", "group_size", F.col("doc_id"))
    alone = seen.where("NOT _maybe").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return grouped.unionByName(alone).select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows with a text of their own are not shuffled."""
    cols = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), _sha(F.col(text_col)).alias("_sha")).withColumn("_h", F.xxhash64("_sha"))
    n = docs.count()
    seen = bloom.probe(d, keep(bloom.repeated(d.select("_h"), "_h", n)), "_h", n, "_maybe")
    order = [id_col] + [f.name for f in docs.schema.fields if f.name not in (id_col, text_col) and f.dataType.typeName() not in ("map", "variant")]
    best = F.max_by("_row", F.struct(*[F.col("_row")[c] for c in order]))
    grouped = seen.where("_maybe").groupBy("_sha").agg(best.alias("_row")).select("_row.*")
    return seen.where("NOT _maybe").select("_row.*").unionByName(grouped)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
