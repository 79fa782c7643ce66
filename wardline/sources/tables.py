"""Table writers and table maintenance over plain Parquet folders."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def overwrite(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Replace the whole contents of a table."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_rows(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Plain append; running it twice adds the rows twice."""
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


class AppendOnlyTable:
    """A table that only grows. There is no overwrite, update or delete here; changes made behind its back are found
    by verifying the hash chain of its rows."""

    def __init__(self, path: str, schema: T.StructType, partition_by: Iterable[str] = ()):
        self.path, self.schema, self.partition_by = path, schema, tuple(partition_by)

    def append(self, df: DataFrame) -> None:
        missing = [f.name for f in self.schema if f.name not in df.columns]
        extra = [c for c in df.columns if c not in self.schema.names]
        if missing or extra:
            raise ValueError(f"append-only table: missing columns {missing}, unknown columns {extra}")
        append_rows(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]), self.path,
                    self.partition_by)

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows so far; a table nobody has written to yet is empty."""
        try:
            return spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], self.schema)


def load_reference(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str, path: str) -> DataFrame:
    """Create or replace a small table of literal rows with a fixed schema."""
    df = spark.createDataFrame(list(rows), schema)
    overwrite(df.coalesce(1), path)
    return spark.read.schema(df.schema).parquet(path)


def merge_insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` whose key is not in ``target``: what a merge with only an insert branch would add. Existing
    rows are never touched, and a null key equals nothing, so it is always inserted. As in a merge, duplicates
    within the source are all inserted."""
    return source.join(target.select(*keys).distinct(), keys, "left_anti")


def merge_insert_missing_into(spark: SparkSession, path: str, source: DataFrame, keys: list[str]) -> None:
    append_rows(merge_insert_missing(spark.read.schema(source.schema).parquet(path), source, keys), path)


def ensure_column(df: DataFrame, name: str, dtype: str | T.DataType, after: str | None = None) -> DataFrame:
    """Add a missing column, null filled, after the named one (or last). A column already there is left alone."""
    if name in df.columns:
        return df
    new = F.lit(None).cast(dtype).alias(name)
    at = len(df.columns) if after is None else df.columns.index(after) + 1
    cols = [F.col(c) for c in df.columns]
    return df.select(*cols[:at], new, *cols[at:])


def copy_table(df: DataFrame, path: str, columns: Iterable[str] | None = None) -> None:
    """Snapshot of a governed table, read unfiltered, as the source of an index."""
    overwrite(df.select(*columns) if columns else df, path)


def non_empty(df: DataFrame) -> bool:
    """An empty read may also mean that a row filter hid everything, so callers skip it and never conclude that
    there is nothing sensitive."""
    return not df.isEmpty()


def missing_inputs(spark: SparkSession, inputs: Mapping[str, str]) -> list[str]:
    """Names of the required tables that cannot be read, in order."""
    out = []
    for name, path in inputs.items():
        try:
            spark.read.parquet(path).schema
        except AnalysisException:
            out.append(name)
    return out


def require(spark: SparkSession, inputs: Mapping[str, str]) -> dict[str, DataFrame]:
    missing = missing_inputs(spark, inputs)
    if missing:
        raise LookupError(f"missing required table(s): {', '.join(missing)}")
    return {name: spark.read.parquet(path) for name, path in inputs.items()}


def register_views(views: Mapping[str, Callable[[], DataFrame]]) -> None:
    """Named views: stored queries that are evaluated again at each read."""
    for name, query in views.items():
        query().createOrReplaceTempView(name)


def profile_load(df: DataFrame, dims: list[str], ts: str, entity: str) -> DataFrame:
    """Load summary in one pass: total rows, first and last ``ts`` and distinct entities on the row whose ``dim`` is
    ``all``, and row counts per value of each dimension. Distinct entities come from a second grouped count, not from
    an expanded distinct aggregate, so a dimension with few values does not decide the parallelism."""
    grouped = df.groupingSets([[]] + [[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"))
    full = (1 << len(dims)) - 1
    dim, value = F.lit("all"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        bit = full ^ (1 << (len(dims) - 1 - i))
        dim = F.when(F.col("_gid") == bit, F.lit(d)).otherwise(dim)
        value = F.when(F.col("_gid") == bit, F.col(d).cast("string")).otherwise(value)
    entities = df.select(entity).distinct().agg(F.count(entity).alias("entities"))
    total = F.col("_gid") == full
    return grouped.select(
        dim.alias("dim"), value.alias("value"), "rows", F.when(total, F.col("first_ts")).alias("first_ts"),
        F.when(total, F.col("last_ts")).alias("last_ts"), F.when(total, entities.scalar()).alias("entities"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
