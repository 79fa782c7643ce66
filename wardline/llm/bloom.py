"""Blocked Bloom filters as DataFrames of 64-bit words, built and probed with SQL functions only.

A 64-bit hash picks one word and two bits of it. The filter is a table (word, bits) with at most MAX_WORDS rows, whatever the number of
keys, so it may be broadcast: 2^20 words are 8 MB of bits (about 50 MB as a hash table). With 16 bits a key two or three in a hundred
absent keys pass; past 2^22 keys the share grows, up to all of them. A filter only spares work: what passes is always checked exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORDS = 1 << 20
BITS_PER_KEY = 16


def words_for(n: int) -> int:
    return min(MAX_WORDS, 1 << max(6, (max(n, 1) * BITS_PER_KEY // 64 - 1).bit_length()))


def _word(h: str, words: int) -> Column:
    return F.expr(f"{h} & {words - 1}L")


def _bit(h: str, at: int) -> str:
    return f"CAST(shiftright({h}, {at}) & 63 AS INT)"


def _mask(h: str) -> Column:
    return F.expr(f"shiftleft(1L, {_bit(h, 40)}) | shiftleft(1L, {_bit(h, 50)})")


def members(keys: DataFrame, h: str, n: int) -> DataFrame:
    """The filter of the hashes in column ``h``; about ``n`` keys."""
    return keys.groupBy(_word(h, words_for(n)).alias("_word")).agg(F.bit_or(_mask(h)).alias("_bits"))


def repeated(keys: DataFrame, h: str, n: int) -> DataFrame:
    """The filter of bits that at least two rows set: a hash that occurs twice passes it. Only counts of bits are shuffled."""
    bits = keys.select(_word(h, words_for(n)).alias("_word"), F.explode(F.array_distinct(F.array(F.expr(_bit(h, 40)), F.expr(_bit(h, 50))))).alias("_bit"))
    twice = bits.groupBy("_word", "_bit").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return twice.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))


def probe(df: DataFrame, filter_: DataFrame, h: str, n: int, flag: str) -> DataFrame:
    """``df`` with a boolean column ``flag``: false only for hashes that are certainly not in the filter. Nothing of ``df`` is shuffled."""
    out = df.withColumn("_word", _word(h, words_for(n))).join(F.broadcast(filter_), "_word", "left")
    mask = _mask(h)
    return out.withColumn(flag, F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))).drop("_word", "_bits")


def without(docs: DataFrame, key: Column, gone: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose ``key`` isn't in column ``name`` of ``gone`` (distinct, a checkpoint). Only rows that the filter of the
    keys lets through are shuffled; null keys stay."""
    n = gone.count()
    # the rows are packed, so that no column of theirs can clash
    mine = docs.select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).withColumn("_h", F.xxhash64("_key"))
    seen = probe(mine, members(gone.select(F.xxhash64(name).alias("_h")), "_h", n), "_h", n, "_maybe")
    maybe = seen.where("_maybe").join(gone.select(F.col(name).alias("_gone")), F.col("_key") == F.col("_gone"), "left_anti")
    return seen.where("NOT _maybe").select("_row.*").unionByName(maybe.select("_row.*"))
