"""Gold tables: parent with children, latest snapshot per key, reference-range flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed
from wardline.session import small_lookup


def join_child_to_parent(parent: DataFrame, child: DataFrame, key: str = "mrn", parent_id: str = "encounter_id",
                         child_parent_id: str = "lab_encounter_id", gather: list[str] | None = None) -> DataFrame:
    """Left join of parents to children that share ``key`` and name this parent or no parent: one row per
    parent and child, a parent without children once.

    A single join with an OR residual would compare every child of a key with every parent of that key. Here the two
    cases are two inner equality joins (children that name a parent meet only that parent), which adaptive execution
    may split on either side when one key is hot, and the childless parents are found against the distinct keys of the
    children, which are pre-aggregated and so carry no skew.

    With ``gather`` (columns of the child) a parent stays one row and brings those columns of its children as the array
    ``children``, empty without any. Children are gathered before they meet their parents, so neither side is repeated."""
    kid = child.withColumnRenamed(key, "_child_key")
    named = kid.filter(F.col(child_parent_id).isNotNull())
    loose = kid.filter(F.col(child_parent_id).isNull())
    same_key = F.col(key) == F.col("_child_key")
    if gather:
        rows = F.collect_list(F.struct(*gather))
        named = named.groupBy("_child_key", F.col(child_parent_id).alias("_p")).agg(rows.alias("_named"))
        loose = loose.groupBy("_child_key").agg(rows.alias("_loose"))
        both = parent.join(named, same_key & (F.col(parent_id) == F.col("_p")), "left").drop("_child_key", "_p").join(loose, same_key, "left")
        none = F.array().cast(both.schema["_loose"].dataType)
        return both.select(*parent.columns, F.concat(F.coalesce("_named", none), F.coalesce("_loose", none)).alias("children"))
    by_id = parent.join(named, same_key & (F.col(parent_id) == F.col(child_parent_id)), "inner")
    by_key = parent.join(loose, same_key, "inner")
    named_ids = named.select(F.col("_child_key").alias("_k"), F.col(child_parent_id).alias("_p")).distinct()
    loose_keys = loose.select(F.col("_child_key").alias("_k")).distinct()
    childless = (parent.join(named_ids, (F.col(key) == F.col("_k")) & (F.col(parent_id) == F.col("_p")), "left_anti")
                 .join(loose_keys, F.col(key) == F.col("_k"), "left_anti"))
    return (by_id.unionByName(by_key).unionByName(childless, allowMissingColumns=True)).drop("_child_key")


def latest_by(df: DataFrame, keys: list[str], order: Column | str, cols: list[str]) -> DataFrame:
    """The whole latest row per key, so that columns of different snapshots never mix. Give a struct as ``order`` to
    decide ties; a null order is ignored. The aggregate is partial before the shuffle."""
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_s"))
            .select(*keys, *[F.col(f"_s.{c}").alias(c) for c in cols]))


def reference_ranges(spark, ranges=None) -> DataFrame:
    return spark.createDataFrame(ranges or fixed.REFERENCE_RANGES, "test_code string, low double, high double")


def flag_results(df: DataFrame, ranges: DataFrame, code: str = "test_code", value: str = "result_value",
                 out: str = "computed_flag") -> DataFrame:
    """``L`` below, ``H`` above, ``N`` inside the reference range of the test; null without a range or a number."""
    r = small_lookup(ranges.select(F.col("test_code").alias("_code"), "low", "high"))
    v = F.col(value).try_cast("double")
    flag = F.when(v < F.col("low"), "L").when(v > F.col("high"), "H").when(
        v.isNotNull() & F.col("low").isNotNull() & F.col("high").isNotNull(), "N")
    return df.join(r, F.col(code) == F.col("_code"), "left").select(*df.columns, flag.alias(out))
