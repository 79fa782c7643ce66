"""Row expectations and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tag(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``failed_rules``, the names of the expectations that a row fails. A condition that is null counts as failed."""
    failed = [F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]
    return df.withColumn("failed_rules", F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>"))


def expect_or_drop(df: DataFrame, rules: dict[str, Column], name: str | None = None) -> tuple[DataFrame, DataFrame, Observation | None]:
    """Rows that pass every expectation, the rows that do not (with the names of the failed ones), and an
    observation that fills with counts when the first frame is next written: ``rows`` and ``failed_<rule>``. On a stream the
    counts come with each batch, as the observation ``name`` of the query's progress. A condition that is null counts as failed."""
    tagged = tag(df, rules)
    dropped = tagged.filter(F.size("failed_rules") > 0)
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.array_contains("failed_rules", n)).alias(f"failed_{n}") for n in rules]]
    obs = None
    if not df.isStreaming:
        obs = Observation()
        tagged = tagged.observe(obs, *counts)
    elif name:
        tagged = tagged.observe(name, *counts)
    return tagged.filter(F.size("failed_rules") == 0).drop("failed_rules"), dropped, obs


def dedupe(df: DataFrame, keys: list[str], order: list[Column] | None = None, watermark: tuple[str, str] | None = None) -> DataFrame:
    """One row per key. In batch ``order`` picks which (the first); the choice is made with a partial top-1 before the
    shuffle, so a key with many copies is thinned out map-side. A stream keeps the first to arrive; with
    ``watermark=(column, delay)`` its state is dropped once the delay has passed."""
    if df.isStreaming:
        if watermark:
            return df.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
        return df.dropDuplicates(keys)
    if order is None:
        return df.dropDuplicates(keys)
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")
