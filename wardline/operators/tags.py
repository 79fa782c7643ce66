"""Sensitivity: column classification, table labels, tag tables and the registry the router reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import fixed


@dataclass
class Registry:
    """``phi``: tables tagged phi or pii at table or column level; ``known``: all tables; ``names``: distinct
    lower-case patient names. Each is a one-column DataFrame."""

    phi: DataFrame
    known: DataFrame
    names: DataFrame


def sensitive_tables(table_tags: DataFrame, column_tags: DataFrame) -> DataFrame:
    hit = (F.col("tag_name") == "classification") & F.col("tag_value").isin("phi", "pii")
    return (table_tags.filter(hit).select("table_name").union(column_tags.filter(hit).select("table_name")).distinct())


def known_names(people: DataFrame, col: str = "patient_name") -> DataFrame:
    """Distinct lower-case names. Read them from an unmasked table, or the mask text is all there is."""
    return people.select(F.lower(col).alias("name")).filter("name is not null and name <> ''").distinct()


def build_registry(table_tags: DataFrame, column_tags: DataFrame, tables: DataFrame, people: DataFrame) -> Registry:
    return Registry(sensitive_tables(table_tags, column_tags), tables.select("table_name").distinct(), known_names(people))


def classify_columns(df: DataFrame, table: str, schema: str) -> DataFrame:
    """A label (phi, pii or null) and a ``strong`` flag per column, from name rules and all values.

    Rules in order: metadata columns and the never-sensitive list are skipped; a value looks like an MRN; a name hint;
    value detectors. Every value is tested, in one aggregate over the table whose state is four flags a column."""
    names = [c for c in df.columns if not c.startswith("_") and c.lower() not in fixed.NEVER_SENSITIVE]
    skipped = [c for c in df.columns if c not in names]
    detectors = [d for d in fixed.DETECTORS if not (schema == fixed.OPERATIONAL_SCHEMA and d[0] == fixed.OPERATIONAL_IGNORES)]

    def any_of(c, keep):
        cond = F.lit(False)
        for _, rx, label, strong in detectors:
            if keep(label, strong):
                cond = cond | F.col(f"`{c}`").cast("string").rlike("(?dU)" + rx)
        return F.coalesce(F.bool_or(cond), F.lit(False))

    flags = [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.bool_or(F.col(f"`{c}`").cast("string").rlike(fixed.MRN_VALUE_PATTERN)), F.lit(False)).alias("mrn"),
                      any_of(c, lambda l, s: l == "phi").alias("d_phi"), any_of(c, lambda l, s: True).alias("d_any"), any_of(c, lambda l, s: s).alias("d_strong")) for c in names]
    empty = "array<struct<column_name:string,mrn:boolean,d_phi:boolean,d_any:boolean,d_strong:boolean>>"
    found = df.agg((F.array(*flags) if flags else F.array().cast(empty)).alias("_f")).select(F.explode("_f").alias("_f")).select("_f.*")
    listed = df.sparkSession.createDataFrame(
        [(i, c, c in skipped, any(h in c.lower() for h in fixed.PHI_NAME_HINTS),
          any(h in c.lower() for h in fixed.PII_NAME_HINTS)) for i, c in enumerate(df.columns)],
        "position int, column_name string, skipped boolean, n_phi boolean, n_pii boolean")
    out = listed.join(found, "column_name", "left")
    mrn = F.coalesce("mrn", F.lit(False))
    named = F.col("n_phi") | F.col("n_pii")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    label = (F.when(F.col("skipped"), F.lit(None).cast("string")).when(mrn, "phi").when(F.col("n_phi"), "phi")
             .when(F.col("n_pii"), "pii").when(yes("d_phi"), "phi").when(yes("d_any"), "pii"))
    strong = F.when(F.col("skipped"), False).when(mrn, True).when(named, False).otherwise(yes("d_strong"))
    return out.select(F.lit(table).alias("table_name"), F.lit(schema).alias("schema_name"), "column_name", "position",
                      label.alias("label"), strong.alias("strong"))


def label_tables(columns: DataFrame) -> DataFrame:
    """One row per classified table: the strictest label of its columns (an operational table stays general unless a
    column is an unambiguous identifier), and for phi tables which row policy applies."""
    g = columns.groupBy("table_name", "schema_name").agg(
        F.bool_or("strong").alias("any_strong"), F.count_if(F.col("label") == "phi").alias("n_phi"),
        F.count_if(F.col("label") == "pii").alias("n_pii"), F.bool_or(F.col("column_name") == "unit").alias("has_unit"))
    label = (F.when((F.col("schema_name") == fixed.OPERATIONAL_SCHEMA) & ~F.col("any_strong"), "general")
             .when(F.col("n_phi") > 0, "phi").when(F.col("n_pii") > 0, "pii").otherwise("general"))
    scope = F.when(label == "phi", F.when(F.col("has_unit"), "unit").otherwise("clinical"))
    return g.select("table_name", "schema_name", label.alias("label"), scope.alias("row_scope"))


def table_tag_rows(labels: DataFrame) -> DataFrame:
    rows = F.array_compact(F.array(
        F.struct(F.lit("classification").alias("tag_name"), F.col("label").alias("tag_value")),
        F.when(F.col("row_scope").isNotNull(), F.struct(F.lit("row_scope").alias("tag_name"), F.col("row_scope").alias("tag_value")))))
    return labels.select("table_name", F.explode(rows).alias("_t")).select("table_name", "_t.*")


def column_tag_rows(columns: DataFrame, labels: DataFrame) -> DataFrame:
    own = columns.filter("label is not null").select(
        "table_name", "column_name", F.lit("classification").alias("tag_name"), F.col("label").alias("tag_value"))
    unit = (columns.filter("column_name = 'unit'").join(labels.filter("row_scope = 'unit'").select("table_name"), "table_name", "left_semi")
            .select("table_name", "column_name", F.lit("unit_key").alias("tag_name"), F.lit("true").alias("tag_value")))
    return own.unionByName(unit)


def apply_tags(tags: DataFrame, new: DataFrame, processed: DataFrame, clear_scopes: bool = False) -> DataFrame:
    """The tag table after a run that converges: classifications of processed tables are cleared and set anew, tables
    that were not processed keep theirs. Other tags of a processed table stay unless set again (or, with
    ``clear_scopes``, go as well). Works for table tags and for column tags."""
    ids = [c for c in tags.columns if c != "tag_value"]
    kept = tags.join(processed.select("table_name").distinct().withColumn("_p", F.lit(True)), "table_name", "left")
    gone = F.col("_p").isNotNull() & ((F.col("tag_name") == "classification") | F.lit(clear_scopes))
    kept = kept.filter(~gone).select(*tags.columns).join(new.select(*ids).distinct(), ids, "left_anti")
    return kept.select(*tags.columns).unionByName(new.select(*tags.columns))


def list_tags(column_tags: DataFrame) -> DataFrame:
    """Column classifications in order of table and column."""
    return column_tags.filter("tag_name = 'classification'").orderBy("table_name", "column_name")
