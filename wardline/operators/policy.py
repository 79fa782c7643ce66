"""Who may see what: entitlements, row filters, masks and their dispatch by tag.

Memberships, assignments and tags are looked up when a frame is read, as subqueries of its plan, not when it is built: a reader who left a
group sees nothing the next time a kept frame is run, and building one runs no job. The tests that subqueries answer refer to the unit column
alone, so on a table that is partitioned by it they prune partitions at run time. In doubt a table is closed, never open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed


def is_member(groups: DataFrame, user: str, *names: str) -> Column:
    """Whether one person belongs to any of the groups, as a subquery."""
    return groups.filter((F.col("user_email") == user) & F.col("grp").isin(*names)).select(F.lit(1)).exists()


def _unit_test(user: str, unit: Column, groups: DataFrame, staff: DataFrame) -> Column:
    units = staff.filter(F.col("staff_email") == user).agg(F.collect_set("assigned_unit")).scalar()     # those of one person
    mine = is_member(groups, user, fixed.STAFF_GROUP) & F.coalesce(F.array_contains(units, unit), F.lit(False))
    return is_member(groups, user, fixed.SERVICE_GROUP) | mine


def _role_test(user: str, groups: DataFrame) -> Column:
    return is_member(groups, user, fixed.SERVICE_GROUP, fixed.STAFF_GROUP)


def filter_by_unit(df: DataFrame, user: str, unit_col: str, groups: DataFrame, staff: DataFrame) -> DataFrame:
    """Row filter, unit scope. Service principals see all rows; clinical staff the rows of their units; everyone else none. Rows without a
    unit are for service principals only."""
    return df.filter(_unit_test(user, F.col(unit_col), groups, staff))


def filter_by_role(df: DataFrame, user: str, groups: DataFrame) -> DataFrame:
    """Role gate: members of either clinical group see all rows, others none."""
    return df.filter(_role_test(user, groups))


def mask(df: DataFrame, cols: list[str], user: str, groups: DataFrame) -> DataFrame:
    """Columns as they are (as text) for clinical staff, the mask text (for nulls too) for everyone else."""
    seen = is_member(groups, user, fixed.STAFF_GROUP)
    return df.withColumns({c: F.when(seen, F.col(c).cast("string")).otherwise(F.lit(fixed.MASK_TEXT)) for c in cols})


def secure_view(df: DataFrame, table: str, user: str, table_tags: DataFrame, column_tags: DataFrame, groups: DataFrame,
                staff: DataFrame, masked: list[str] = (), unit_cols: list[str] | None = None) -> DataFrame:
    """The table as one reader may see it: the row policy its tags select, then its column masks.

    A table that isn't tagged ``phi`` is open. One that is has exactly one policy: unit scope by the column tagged ``unit_key``, or the
    role gate, which also holds where no scope is tagged (yet). Unit scope without a key column, or with one that isn't among
    ``unit_cols`` (default: all text columns), leaves the rows to service principals. Name the one column that can be the key to have
    partitions pruned by it."""
    tag = lambda name, value: table_tags.filter((F.col("table_name") == table) & (F.col("tag_name") == name) & (F.col("tag_value") == value)).select(F.lit(1)).exists()
    key = column_tags.filter((F.col("table_name") == table) & (F.col("tag_name") == "unit_key")).agg(F.min("column_name")).scalar()
    columns = unit_cols if unit_cols is not None else [c for c, t in df.dtypes if t == "string"]
    unit = F.coalesce(*[F.when(key == c, F.col(c)) for c in columns]) if columns else F.lit(None).cast("string")
    scoped = F.when(tag("row_scope", "unit"), _unit_test(user, unit, groups, staff)).otherwise(_role_test(user, groups))
    df = df.filter(~tag("classification", "phi") | scoped)
    return mask(df, list(masked), user, groups) if masked else df


def reader_scopes(readers: DataFrame, groups: DataFrame, staff: DataFrame) -> DataFrame:
    """The set form of the row filter: per reader ``sees_all`` and the array of ``units`` they may read (empty for
    people outside both groups). One row per reader; units of one person are few."""
    r = readers.select("user_email").filter("user_email is not null").distinct()
    g = groups.filter(F.col("grp").isin(fixed.SERVICE_GROUP, fixed.STAFF_GROUP)).groupBy("user_email").agg(
        F.bool_or(F.col("grp") == fixed.SERVICE_GROUP).alias("sees_all"), F.bool_or(F.col("grp") == fixed.STAFF_GROUP).alias("is_staff"))
    s = staff.groupBy(F.col("staff_email").alias("user_email")).agg(F.array_sort(F.collect_set("assigned_unit")).alias("_u"))
    none = F.array().cast("array<string>")
    all_ = F.coalesce(F.col("sees_all"), F.lit(False))
    return (r.join(g, "user_email", "left").join(s, "user_email", "left")
            .select("user_email", all_.alias("sees_all"),
                    F.when(~all_ & F.col("is_staff") & F.col("_u").isNotNull(), F.col("_u")).otherwise(none).alias("units")))


def visible_counts(df: DataFrame, unit_col: str, scopes: DataFrame) -> DataFrame:
    """How many rows of a governed table each reader may see. Rows are counted per unit before they meet readers."""
    per_unit = df.groupBy(F.col(unit_col).alias("_unit")).agg(F.count(F.lit(1)).alias("_n"))
    total = per_unit.agg(F.sum("_n").alias("n"))
    mine = (scopes.select("user_email", F.explode("units").alias("_unit")).join(per_unit, "_unit")
            .groupBy("user_email").agg(F.sum("_n").alias("_mine")))
    rows = F.when(F.col("sees_all"), F.coalesce(total.scalar(), F.lit(0))).otherwise(F.coalesce("_mine", F.lit(0)))
    return scopes.join(mine, "user_email", "left").select("user_email", rows.alias("visible_rows"))
