"""Reading raw documents and tables, in batch and as incremental streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_documents(spark: SparkSession, path: str, stream: bool = True, max_files: int | None = None, lines: bool = False) -> DataFrame:
    """One row per file, or with ``lines`` one per line: raw text in ``value`` and the file it came from. As a stream each file is ingested once
    (the checkpoint of the query remembers which); ``max_files`` bounds a micro-batch."""
    reader = spark.readStream if stream else spark.read
    reader = reader.format("text").option("wholetext", not lines)
    if stream:
        reader = reader.schema("value string")
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select("value", F.col("_metadata.file_path").alias("source_file"))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def stream_table(spark: SparkSession, path: str, schema: T.StructType | str, max_files: int | None = None) -> DataFrame:
    """A Parquet table as an incremental source: rows of files not seen before. The schema is given, never inferred."""
    reader = spark.readStream.format("parquet").schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
