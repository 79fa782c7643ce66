"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment search.

The similarity of a short item and a long document is tiny even when the document holds all of the item, so sketches of both don't meet.
What does meet is the item's own sketch and the document's shingles. Items are partitioned by the number of their shingles, in classes whose
upper bound u is a power of two. The sketch of an item is its m smallest shingle hashes (bottom-m MinHash), m = u - ceil(share * u) + 1: a
document that holds ``share`` per cent of the item's shingles misses fewer than m of them, so it holds at least one of the sketch, whatever
the item. No contaminated document can be missed, and one that shares no rare shingle is never looked at again.

Documents that hold a sketch hash are read once more, and containment is counted exactly, on shingles as text.

The items' shingles are broadcast after counting them (up to BROADCAST rows); beyond that the same joins are shuffled.

Defined results: words and shingles as elsewhere (lower-case A-Z, five words); an item of fewer words is one shingle and found only in
documents that consist of it; items and documents without words match nothing. Null ids are reported as null; repeated rows are reported
once, and ``clean`` drops or keeps all of them. Items that repeat under one id count as one item with the shingles of all its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import LOWER, UPPER, keep

BROADCAST = 1_000_000


def _words(text: Column) -> Column:
    blank = "\t\n\x0b\x0c\r"
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + blank, LOWER + " " * len(blank)), " ", -1), lambda w: w != "")


def _windows(words: str, k: int, join) -> Column:
    """``join`` of each run of ``k`` elements of the array column ``words``, or of all of them if there are fewer."""
    n = F.size(words)
    many = F.transform(F.slice(words, F.lit(1), n - (k - 1)), lambda x, i: join([x] + [F.col(words)[i + j] for j in range(1, k)]))
    few = F.when(n > 0, F.array(join([F.array_join(words, " ")]))).otherwise(F.slice(F.array(join([F.lit("")])), 1, 0))
    return F.when(n >= k, many).otherwise(few)


def _key() -> Column:
    """A document by id and text, so that rows that repeat are one and rows that share an id are not."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def contamination(docs: DataFrame, items: DataFrame, k: int = 5, share: int = 80) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, n_shared, n_item (distinct shingles), and _key."""
    text = lambda x: F.concat_ws(" ", *x)
    hash_ = lambda x: F.xxhash64(*x)
    owned = items.select("item_id", _words(F.col("text")).alias("w")).select("item_id", F.explode(_windows("w", k, text)).alias("shingle")).distinct()
    # words are hashed one by one and shingles from those, as below for the documents
    owned = owned.withColumn("w", F.split("shingle", " ", -1))
    owned = keep(owned.withColumn("_w", F.transform("w", lambda w: F.xxhash64(w))).select("item_id", "shingle", F.when(F.size("w") >= k, _windows("_w", k, hash_)[0]).otherwise(F.xxhash64("shingle")).alias("h")))
    per = owned.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"), F.array_sort(F.collect_set("h")).alias("hs"))
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.col("n_item"))))
    m = (upper - F.ceil(F.lit(share) * upper / 100) + 1).cast("int")
    sketch = keep(per.select(F.explode(F.slice("hs", F.lit(1), m)).alias("h")).distinct())
    sizes = per.select("item_id", "n_item")

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    w = d.select(_key().alias("_key"), _words(F.col("text")).alias("w"))
    w = w.withColumn("_w", F.when(F.size("w") >= k, F.transform("w", lambda x: F.xxhash64(x))))
    hashes = F.when(F.size("w") >= k, F.transform(F.slice("_w", F.lit(1), F.size("_w") - (k - 1)), lambda x, i: hash_([x] + [F.col("_w")[i + j] for j in range(1, k)])))
    hashes = hashes.otherwise(F.array(F.xxhash64(F.array_join("w", " "))))
    found = w.where(F.size("w") > 0).select("_key", F.explode(hashes).alias("h")).join(_small(sketch), "h", "left_semi").select("_key").distinct()
    found = keep(found)
    n = found.count()
    seen = bloom.probe(d.withColumn("_key", _key()).withColumn("_h", F.xxhash64("_key")), bloom.members(found.withColumn("_h", F.xxhash64("_key")), "_h", n), "_h", n, "_maybe")
    seen = seen.where("_maybe").select("_key", "doc_id", _words(F.col("text")).alias("w")).join(found, "_key", "left_semi").dropDuplicates(["_key"])
    own = seen.select("_key", "doc_id", F.explode(F.array_distinct(_windows("w", k, text))).alias("shingle"))
    hits = own.join(_small(owned.select("shingle", "item_id")), "shingle").groupBy("_key", "doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    sizes = sizes.withColumnRenamed("item_id", "_item")
    return hits.join(_small(keep(sizes)), F.col("item_id").eqNullSafe(F.col("_item"))).where(f"100 * n_shared >= {share} * n_item").select("doc_id", "item_id", "n_shared", "n_item", "_key")


def clean(docs: DataFrame, items: DataFrame, k: int = 5, share: int = 80) -> DataFrame:
    """The rows of ``docs`` without any item in them, with all their columns."""
    gone = keep(contamination(docs, items, k, share).select("_key").distinct())
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(F.coalesce("text", F.lit(""))).cast("string"))
    return bloom.without(docs, key, gone, "_key")


ORACLE = """
WITH w AS (SELECT 'd' AS k, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') FROM benchmark),
s AS (SELECT DISTINCT k, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS t FROM w),
n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE k = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, n_item FROM s d JOIN s i ON d.t = i.t JOIN n ON n.item_id = i.id
WHERE d.k = 'd' AND i.k = 'i' GROUP BY d.id, i.id, n_item HAVING 100 * count(*) >= 80 * n_item
"""
