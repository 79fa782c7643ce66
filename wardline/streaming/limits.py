"""Per-key admission on a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from wardline import fixed
from wardline.operators.ratelimit import admit_counts

#: the store that states with timers need
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


#: keys are dealt over this many buckets by a hash, and Python is called once a bucket of a micro-batch; a checkpoint is bound to it
BUCKETS = 4096
#: what Spark hands to a stateful step must not begin with an underscore, or it loses its name
KEY, BUCKET = "wardline_key", "wardline_bucket"


class Admission(StatefulProcessor):
    """Of each key in a bucket the instants of its admitted requests in the last window, at most ``limit`` of them, until the watermark
    has passed their window. A bucket's timer stands at the earliest such end."""

    def __init__(self, ts: str, order: str, limit: int, micros: int):
        self.ts, self.order, self.limit, self.micros = ts, order, limit, micros

    def init(self, handle) -> None:
        self.handle = handle
        self.live = handle.getMapState("live", "k string", "at array<long>, n array<long>")

    def _end(self, last: int) -> int:
        """When no request can fall into the window of the instant ``last`` any more, in milliseconds."""
        return (last + self.micros) // 1000 + 1

    def _wake(self, end: int) -> None:
        set_ = list(self.handle.listTimers())
        if not set_ or end < min(set_):
            for t in set_:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(end)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        behind = timerValues.getCurrentWatermarkInMs() * 1000
        got = pd.concat(list(rows), ignore_index=True).sort_values([KEY, self.ts, self.order], kind="stable", ignore_index=True)
        instants = got[self.ts].astype("datetime64[us]").astype("int64")
        got["late"] = got[self.ts].isna() | (instants < behind)
        known, admitted, ends = self.live.exists(), [], []
        current, live = None, deque()
        for k, t, late in [*zip(got[KEY], instants.tolist(), got["late"].tolist()), (None, 0, True)]:
            if k != current:
                if live:
                    self.live.updateValue((current,), ([x for x, _ in live], [n for _, n in live]))
                    ends.append(self._end(live[-1][0]))
                had = self.live.getValue((k,)) if known and k is not None else None
                current, live = k, deque(zip(*had)) if had else deque()
            admitted.append(not late and admit_counts(live, t, 1, self.limit, self.micros) == 1)
        got["admitted"] = admitted[:-1]
        if ends:
            self._wake(min(ends))
        yield got.drop(columns=[KEY, BUCKET], errors="ignore")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left = timerValues.getCurrentWatermarkInMs(), []
        for (k,), (at, _) in list(self.live.iterator()):
            end = self._end(at[-1])
            if end <= now:
                self.live.removeKey((k,))
            else:
                left.append(end)
        if left:
            self.handle.registerTimer(min(left))
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(df: DataFrame, key: str, ts: str, order: str, limit: int = fixed.USER_LIMIT,
                      window_seconds: int = fixed.USER_WINDOW_SECONDS, delay: str = "1 hour") -> DataFrame:
    """The stream with ``admitted`` and ``late``, as :func:`wardline.operators.ratelimit.rate_limit` decides it when every
    micro-batch is later than the one before. No row is dropped: one behind the watermark (``delay``), whose window may be
    forgotten, or without a time is refused with ``late`` true and leaves the state as it was.

    A key's state is the instants of its admitted requests in the last window. Keys are dealt over BUCKETS buckets, each with its
    keys' states in a map, so that a micro-batch costs a call of Python for each bucket and not for each key. A timer removes a state once
    the watermark has passed its window, so what is kept grows with the keys of the last ``delay`` and window, not with all keys ever seen. Spark
    would discard rows behind the watermark before a stateful step that reads the watermarked column; this one reads a copy of it,
    which carries no watermark, and tells late rows itself. A micro-batch of one bucket is ordered in memory, so bound micro-batches
    (``maxFilesPerTrigger``). Timers need the RocksDB state store; it is set for the session if it isn't yet."""
    spark = df.sparkSession
    if spark.conf.get(PROVIDER, None) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)
    d = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    d = d.withColumn(ts, F.timestamp_micros(F.unix_micros(ts)))
    # the key as the batch form tells it: null apart from ''
    d = d.withColumn(KEY, F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")))
    d = d.withColumn(BUCKET, F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int"))
    schema = T.StructType([*[f for f in d.schema.fields if f.name not in (KEY, BUCKET)], T.StructField("late", T.BooleanType()), T.StructField("admitted", T.BooleanType())])
    out = d.groupBy(BUCKET).transformWithStateInPandas(Admission(ts, order, limit, window_seconds * 1_000_000), schema, "Append", "EventTime")
    return out.select(*df.columns, "admitted", "late")
