"""Sliding-window admission per key."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline import fixed


def admit_counts(state: deque, ts: int, n: int, limit: int, window: int) -> int:
    """How many of ``n`` requests at instant ``ts`` are admitted; ``state`` holds (instant, admitted) of the last window."""
    while state and ts - state[0][0] >= window:
        state.popleft()
    m = min(n, limit - sum(c for _, c in state))
    if m > 0:
        state.append((ts, m))
    return max(m, 0)


def rate_limit(df: DataFrame, key: str, ts: str, order: str, limit: int = fixed.USER_LIMIT,
               window_seconds: int = fixed.USER_WINDOW_SECONDS) -> DataFrame:
    """Adds ``admitted``: true if fewer than ``limit`` requests of the key were *admitted* in the last window. Refused
    requests do not count, so this is a fold in time order, not a windowed count. ``order`` breaks ties of ``ts``. A request
    without a time is refused; requests without a key share one limit, apart from the key ''.

    Most traffic never reaches the fold. Requests are counted per key and window-long bucket; a bucket that together with
    its predecessor holds no more than ``limit`` requests is calm and wholly admitted. Only runs of crowded buckets are
    folded, each run on its own with its calm predecessor as the starting state, so even a key with a third of all rows
    spreads over its runs. The fold sees one row per instant (requests at one instant are counted first), streams through
    a sorted partition and remembers at most ``limit`` instants."""
    micros = window_seconds * 1_000_000
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("_k", F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit(""))).withColumn("_t", t).withColumn("_b", F.floor(F.col("_t") / F.lit(micros)).cast("long"))
    inst = rows.groupBy("_k", "_b", "_t").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy("_k").orderBy("_b")
    buckets = inst.groupBy("_k", "_b").agg(F.sum("_n").alias("_c"))
    prev_n = F.when(F.lag("_b").over(w) == F.col("_b") - 1, F.lag("_c").over(w)).otherwise(0)
    buckets = buckets.withColumn("_calm", F.col("_c") + prev_n <= limit)
    buckets = buckets.withColumn("_feeds", F.coalesce((F.lead("_b").over(w) == F.col("_b") + 1) & ~F.lead("_calm").over(w), F.lit(False)))
    # a run starts at each calm bucket and at each crowded one without a neighbour before it; the crowded buckets follow
    starts = F.col("_calm") | ~F.coalesce(F.lag("_b").over(w) == F.col("_b") - 1, F.lit(False))
    buckets = buckets.withColumn("_run", F.sum(starts.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    crowded = buckets.filter("not _calm or _feeds").select("_k", "_b", "_run", "_calm")
    todo = inst.join(crowded, ["_k", "_b"]).select("_k", "_run", "_t", "_n", "_calm")

    def fold(batches):
        current, state = None, deque()
        for pdf in batches:
            admitted = []
            for k, run, at, n in zip(pdf["_k"], pdf["_run"], pdf["_t"], pdf["_n"]):
                if (k, run) != current:
                    current, state = (k, run), deque()
                admitted.append(admit_counts(state, at, n, limit, micros))
            yield pd.DataFrame({"_k": pdf["_k"], "_t": pdf["_t"], "_m": admitted})[~pdf["_calm"].to_numpy(dtype=bool)]

    verdict = todo.repartition("_k", "_run").sortWithinPartitions("_k", "_run", "_t").mapInPandas(
        fold, "_k string, _t bigint, _m bigint")
    # of the requests of one instant the first ones in order are admitted; join and rank share one partitioning
    out = rows.join(verdict, ["_k", "_t"], "left")
    rn = F.row_number().over(W.partitionBy("_k", "_t").orderBy(order))
    return out.withColumn("_rn", rn).select(*df.columns, (F.col("_t").isNotNull() & F.coalesce(F.col("_rn") <= F.col("_m"), F.lit(True))).alias("admitted"))


def usage_by(df: DataFrame, keys: list[str], ts: str, period: str = "day", limit: int | None = None) -> DataFrame:
    """Requests per key and period, and by how many they exceed ``limit``."""
    out = df.groupBy(*keys, F.date_trunc(period, F.col(ts)).alias("period")).agg(F.count(F.lit(1)).alias("requests"))
    if limit is None:
        return out
    return out.withColumn("over_limit", F.greatest(F.col("requests") - limit, F.lit(0)))
