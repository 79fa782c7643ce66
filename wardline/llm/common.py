"""What several operators of this subpackage share: checkpoints, joins that bear hot keys, word shingles."""

from __future__ import annotations

import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: words are runs of anything but the space and the control characters tab to carriage return
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(module: str) -> None:
    """Send the functions of ``module`` to the executors by value, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, under ``spark.checkpoint.dir``. A local session without the setting (tests) gets a folder of its
    own; a cluster without it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="llm-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: read many times, computed once, and safe when an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Jobs that run inside send at most ``rows`` rows at a time to Python (or fewer, as the session has it). Long texts otherwise fill
    buffers of tens of megabytes, once in the JVM and once in the worker of every task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    if int(was) <= 0 or int(was) > rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def store(df: DataFrame, **options: str) -> DataFrame:
    """Like ``keep``, as a Parquet table. For loops: a checkpoint inherits the size that was estimated for its plan, and joins multiply
    such sizes, so that after some rounds of joins the planner works on numbers of millions of digits. A table has its real size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(c, UPPER, LOWER)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, share: int = 1024) -> DataFrame:
    """Left join of ``rows`` to ``groups``, which has one row a ``key`` and in ``size`` how many of ``rows`` carry that key.

    A key with over 1/``share`` of all rows would land in one task. There are fewer than ``share`` such keys, so their groups are
    broadcast, and their rows take part in the shuffle join under random extra key parts that match nothing. ``groups`` is read three
    times and should be a checkpoint. Columns of ``groups`` must not clash with those of ``rows``, except ``key``."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    cols = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > total / share).select(key, F.struct(*cols).alias("_hot"))
    cold = groups.where(F.col(size) <= total / share).select(key, F.struct(*cols).alias("_cold"), F.lit(0).alias("_part"))
    out = rows.join(F.broadcast(hot), key, "left")
    out = out.withColumn("_part", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(4096))).cast("int"))
    out = out.join(cold, [key, "_part"], "left")
    got = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *[got[c].alias(c) for c in cols])
