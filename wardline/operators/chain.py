"""Tamper-evident hash chains over audit records: extend and verify."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline import fixed


def payload(fields: list[str] | None = None) -> Column:
    """The hashed content of a record: its fields as a compact JSON array, nulls kept."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in (fields or fixed.CHAIN_FIELDS)]))


def expected_hash(prev: Column, fields: list[str] | None = None) -> Column:
    return F.sha2(F.concat(F.coalesce(prev, F.lit("")), F.lit("|"), payload(fields)), 256)


def chain(df: DataFrame, order: list[str], key: list[str] = (), last: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """Adds ``seq, prev_hash, row_hash``: each hash covers the content of its row and the hash before it.

    A chain is sequential by definition, so parallelism comes from many chains: ``key`` names them (user, user and day,
    ...). Chains of one key can be tied together by chaining their heads, see :func:`seal`. Without a key there is one
    chain, which one task folds from end to end, as its definition demands: give a key where the log is large. ``last`` has the
    current end of each chain (key columns, ``seq``, ``row_hash``).

    Rows stream through sorted partitions and the fold remembers one hash, so memory does not depend on chain length."""
    keys = list(key)
    cols = df.columns
    d = df.withColumn("_p", payload(fields))
    if last is not None and keys:
        d = d.join(last.select(*keys, F.col("seq").alias("_s"), F.col("row_hash").alias("_h")), keys, "left")
    elif last is not None:
        end = last.agg(F.max_by(F.struct("seq", "row_hash"), "seq").alias("e")).first()["e"]
        d = d.withColumn("_s", F.lit(end["seq"] if end else None).cast("long")).withColumn("_h", F.lit(end["row_hash"] if end else None).cast("string"))
    else:
        d = d.withColumn("_s", F.lit(None).cast("long")).withColumn("_h", F.lit(None).cast("string"))
    d = d.withColumn("_key", F.to_json(F.array(*[F.col(k).cast("string") for k in keys])) if keys else F.lit(""))
    d = (d.repartition("_key") if keys else d.repartition(1)).sortWithinPartitions("_key", *order)

    def fold(batches):
        current, seq, prev = None, 0, None
        for batch in batches:
            seqs, prevs, hashes = [], [], []
            for k, p, s, h in zip(*(batch.column(c).to_pylist() for c in ("_key", "_p", "_s", "_h"))):
                if k != current:
                    current, seq, prev = k, s or 0, h
                seq += 1
                digest = sha256(f"{prev or ''}|{p}".encode()).hexdigest()
                seqs.append(seq)
                prevs.append(prev)
                hashes.append(digest)
                prev = digest
            new = [pa.array(seqs, pa.int64()), pa.array(prevs, pa.string()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in cols] + new, [*cols, "seq", "prev_hash", "row_hash"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", seq bigint, prev_hash string, row_hash string"
    return d.mapInArrow(fold, schema)


def chain_heads(chained: DataFrame, key: list[str]) -> DataFrame:
    """The last row of each chain."""
    return chained.groupBy(*key).agg(F.max_by(F.struct("seq", "row_hash"), "seq").alias("_e")).select(
        *key, F.col("_e.seq").alias("seq"), F.col("_e.row_hash").alias("row_hash"))


def seal(chained: DataFrame, key: list[str], outer: list[str]) -> DataFrame:
    """A second-level chain over the heads of the chains of one ``outer`` key: removing a whole chain then shows too."""
    heads = chain_heads(chained, key).withColumnRenamed("seq", "rows_in_chain").withColumnRenamed("row_hash", "head_hash")
    inner = [k for k in key if k not in outer]
    return chain(heads, inner, outer, fields=[*key, "rows_in_chain", "head_hash"])


def verify_chain(df: DataFrame, key: list[str] = (), fields: list[str] | None = None, bucket_rows: int = 100_000) -> DataFrame:
    """Problems found, one row each: (key,) seq, problem, detail. No rows means the chains are intact.

    ``gap``: the number is not one more than the row before; ``prev_hash``: it does not name the hash of the row before;
    ``edited``: content and hash disagree; ``no_seq``: the row has no number, and no part in the chain. Each row needs its predecessor only. A global ordered window would run in one
    task, so rows look back within buckets of ``bucket_rows`` numbers and the first row of a bucket takes its predecessor
    from the small table of bucket ends."""
    keys = list(key)
    own = F.to_json(F.array(*[F.col(k).cast("string") for k in keys])) if keys else F.lit("")
    unnumbered = df.where("seq IS NULL").select(*keys, "seq", F.lit("no_seq").alias("problem"), F.lit("a row without a number").alias("detail"))
    d = df.where("seq IS NOT NULL").withColumn("_key", own).withColumn("_bk", F.floor(F.col("seq") / bucket_rows).cast("long")).withColumn(
        "_edited", ~(expected_hash(F.nullif("prev_hash", F.lit("")), fields).eqNullSafe(F.col("row_hash"))))
    slim = d.select(*keys, "_key", "seq", "_bk", "prev_hash", "row_hash", "_edited")
    w = W.partitionBy("_key", "_bk").orderBy("seq", "row_hash")
    inner = slim.withColumn("_ps", F.lag("seq").over(w)).withColumn("_ph", F.lag("row_hash").over(w))
    ends = slim.groupBy("_key", "_bk").agg(F.max(F.struct("seq", "row_hash")).alias("_e"))
    across = W.partitionBy("_key").orderBy("_bk")
    edges = ends.withColumn("_pe", F.lag("_e").over(across)).select("_key", "_bk", "_pe")
    j = inner.join(edges, ["_key", "_bk"])
    ps = F.coalesce("_ps", F.col("_pe.seq"))
    ph = F.when(F.col("_ps").isNotNull(), F.col("_ph")).otherwise(F.col("_pe.row_hash"))
    expected = F.coalesce(ps + 1, F.lit(1))
    found = F.array_compact(F.array(
        F.when(F.col("seq") != expected, F.struct(F.lit("gap").alias("problem"), F.format_string(
            "seq %d: expected %d (a row is missing or out of order)", F.col("seq"), expected).alias("detail"))),
        F.when(~F.nullif("prev_hash", F.lit("")).eqNullSafe(ph), F.struct(F.lit("prev_hash").alias("problem"), F.format_string(
            "seq %d: prev_hash does not match the previous row", F.col("seq")).alias("detail"))),
        F.when(F.col("_edited"), F.struct(F.lit("edited").alias("problem"), F.format_string(
            "seq %d: row content does not match its hash (edited)", F.col("seq")).alias("detail")))))
    return j.select(*keys, "seq", F.explode(found).alias("_f")).select(*keys, "seq", "_f.*").unionByName(unnumbered)
