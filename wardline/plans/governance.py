"""Jobs that follow a load: tags and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardline.operators import chunks, gold, tags
from wardline.sources import tables as S


def governance_refresh(tables: dict[str, tuple[str, DataFrame]], table_tags: DataFrame, column_tags: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Classify the given tables (name → schema, data) and bring the tag tables up to date. Gives the new table tags, the
    new column tags and the names of tables skipped because they read empty; those keep their tags."""
    labelled, skipped = None, []
    for name, (schema, df) in tables.items():
        if not S.non_empty(df):
            skipped.append(name)
            continue
        one = tags.classify_columns(df, name, schema)
        labelled = one if labelled is None else labelled.unionByName(one)
    if labelled is None:
        return table_tags, column_tags, skipped
    labels = tags.label_tables(labelled)
    done = labels.select("table_name")
    return (tags.apply_tags(table_tags, tags.table_tag_rows(labels), done),
            tags.apply_tags(column_tags, tags.column_tag_rows(labelled, labels), done), skipped)


def refresh_chunks(encounters: DataFrame, labs: DataFrame, facilities: DataFrame, policies: DataFrame, beds: DataFrame,
                   phi_path: str, general_path: str, indexed: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Replace both chunk tables and say what each index (if there is one) must do to follow."""
    spark = encounters.sparkSession
    S.overwrite(chunks.chunk_parents(gold.join_child_to_parent(encounters, labs, gather=chunks.LAB_FIELDS)), phi_path)
    S.overwrite(chunks.chunk_general(facilities, policies, beds), general_path)
    now = {"phi": spark.read.parquet(phi_path), "general": spark.read.parquet(general_path)}
    return {name: chunks.sync_index(now[name], index) for name, index in (indexed or {}).items()}
