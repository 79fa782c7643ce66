"""Session defaults and the few helpers every operator shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: settings the operators rely on; all are ordinary Spark options
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # state of streams (ids seen, open windows) on disk instead of the heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "wardline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword options use ``__`` for the dots of the option name."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder named by ``spark.checkpoint.dir`` and go on from there, so that several
    branches read it once and a lost executor costs a re-read, not a recomputation. Where the setting is absent, a local
    session (tests) gets a folder of its own; on a cluster it is an error, as every branch would be computed anew."""
    shared_folder(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()      # a frame made here: an older one goes by the settings of its own time


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a compressed Parquet table: for rows of long texts, which take a fraction of a checkpoint's space there."""
    path = scratch(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """What a job that runs inside has shuffled is removed from the disks with its end, not some time after its plan is forgotten:
    its result is in the shared folder, and no one reads the files again."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, set up as :func:`cut` needs it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="wardline-")
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder, for tables and streams of one run."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Files of long texts that make fewer read partitions than there are cores are spread out before dear work per row. The number
    of partitions follows from the sizes of the files, so nothing is run to find it; frames that aren't read from files pass."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    return df.repartition(cores) if files and len(files) < cores and _bytes_of(df, files, cores) < cores * (16 << 20) else df


def _bytes_of(df: DataFrame, files: list[str], most: int) -> int:
    """Bytes of at most ``most`` files, asked of their file system."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in files[:most]]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def row_bound(df: DataFrame, limit: int) -> int | None:
    """The row count if it is at most ``limit``, else None. Reads no more than it needs to decide."""
    n = df.limit(limit + 1).count()
    return n if n <= limit else None


def small_lookup(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """Hint a broadcast only after counting: a side that outgrew ``limit`` rows is left to the shuffle join."""
    return F.broadcast(df) if row_bound(df, limit) is not None else df


def text_list(col: Column) -> Column:
    """An array of strings shown as ``['a', 'b']``."""
    return F.concat(F.lit("["), F.array_join(F.transform(col, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
