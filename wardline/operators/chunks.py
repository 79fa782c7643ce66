"""Text chunks: one per parent with its children, templated rows, and the refresh of an index from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import fixed
from wardline.session import cut

ENCOUNTER_KEYS = ["encounter_id", "mrn", "unit", "patient_name", "encounter_class", "period_start", "diagnosis_code"]
LAB_FIELDS = ["observed_at", "test_code", "result_value", "result_flag"]


def code_name(col: Column, names: dict[str, str] | None = None) -> Column:
    """A code spelled out; unknown codes stay as they are."""
    table = F.create_map(*[F.lit(x) for kv in (names or fixed.CODE_NAMES).items() for x in kv])
    return F.coalesce(F.element_at(table, col), col)


def distinct_parents(parents: DataFrame) -> DataFrame:
    """Encounters whose texts would be the same as one row with their number, ``copies``, dealt as the join to their labs needs them: so they are counted
    before labs hang on them, and :func:`chunk_parents` has nothing left to gather."""
    return parents.repartition("mrn", "encounter_id").groupBy(*ENCOUNTER_KEYS).agg(F.count(F.lit(1)).cast("int").alias("copies"))


def chunk_parents(gold: DataFrame, code_names: dict[str, str] | None = None, slice_chars: int = 7) -> DataFrame:
    """One chunk per encounter with its labs in time order.

    Labs are ordered by (observed_at, test_code, result_value, result_flag); a lab without a code is not counted, a lab
    with another null field drops out of the text, and a null encounter field makes the whole content null.

    ``gold`` has a row per encounter and lab, or per encounter with its labs as the array ``children``. In the first case
    the labs of one encounter are gathered in two steps, first per time slice (the leading ``slice_chars`` of
    ``observed_at``: a month by default) and then per encounter, so sorting and rendering a very large encounter is
    spread over tasks and the last step only concatenates texts that are already in order. In the second they are gathered
    already: the fields of an encounter travel once, not with each lab. With ``copies`` (:func:`distinct_parents`) the encounters are, too."""
    def render(x):
        return F.concat(code_name(x["test_code"], code_names), F.lit(" = "), x["result_value"], F.lit(" (flag "),
                        x["result_flag"], F.lit(") at "), x["observed_at"])

    if "children" in gold.columns:
        lab = F.transform("children", lambda x: F.struct(*[x[c].alias(c) for c in LAB_FIELDS]))
        if "copies" in gold.columns:
            parts = gold.select(*ENCOUNTER_KEYS, F.when(F.col("copies") == 1, lab).otherwise(F.flatten(F.array_repeat(lab, F.col("copies")))).alias("_labs"))
        else:
            parts = gold.groupBy(*ENCOUNTER_KEYS).agg(F.flatten(F.collect_list(lab)).alias("_labs"))
        parts = parts.withColumn("_n", F.size(F.filter("_labs", lambda x: x["test_code"].isNotNull())))
        labs = F.array_join(F.array_compact(F.transform(F.array_sort("_labs"), render)), "; ")
    else:
        lab = F.struct(*[F.col(c) for c in LAB_FIELDS])
        sliced = (gold.withColumn("_slice", F.substring("observed_at", 1, slice_chars))
                  .groupBy(*ENCOUNTER_KEYS, "_slice")
                  .agg(F.count("test_code").alias("_n"), F.collect_list(lab).alias("_labs")))
        ordered = F.array_compact(F.transform(F.array_sort("_labs"), render))
        text = sliced.withColumn("_texts", ordered).withColumn(
            "_part", F.when(F.size("_texts") > 0, F.array_join("_texts", "; ")))
        parts = text.groupBy(*ENCOUNTER_KEYS).agg(
            F.sum("_n").alias("_n"),
            F.collect_list(F.when(F.col("_part").isNotNull(), F.struct("_slice", "_part"))).alias("_parts"))
        labs = F.array_join(F.transform(F.array_sort("_parts"), lambda p: p["_part"]), "; ")
    c = {k: F.col(k) for k in ENCOUNTER_KEYS}
    content = F.concat(
        F.lit("Patient "), c["patient_name"], F.lit(" (MRN "), c["mrn"], F.lit("), "), c["encounter_class"],
        F.lit(" encounter "), c["encounter_id"], F.lit(" on "), c["period_start"], F.lit(" in "), c["unit"],
        F.lit(", diagnosis code "), c["diagnosis_code"],
        F.when(F.col("_n") == 0, F.lit("")).otherwise(F.concat(F.lit(". Labs: "), labs)), F.lit("."))
    return parts.select(F.concat(F.lit("enc-"), c["encounter_id"]).alias("chunk_id"),
                        F.lit("gold_patient_summary").alias("source_table"), "mrn", "unit", content.alias("content"))


def chunk_rows(df: DataFrame, id_prefix: str, id_col: str, template: list[str | Column], source: str) -> DataFrame:
    """Rows as sentences: ``template`` mixes literal text and columns, and a null column makes the content null."""
    parts = [F.lit(p) if isinstance(p, str) else p for p in template]
    return df.select(F.concat(F.lit(id_prefix), F.col(id_col)).alias("chunk_id"), F.lit(source).alias("source_table"),
                     F.concat(*parts).alias("content"))


def chunk_general(facilities: DataFrame, policies: DataFrame, beds: DataFrame) -> DataFrame:
    """Facilities, policies and current beds in one chunk table with deterministic ids."""
    f = chunk_rows(facilities, "facility-", "facility_id",
                   [F.col("name"), " (", F.col("location"), "): open ", F.col("opens"), " to ", F.col("closes"), ". ",
                    F.col("notes")], "facilities_info")
    p = chunk_rows(policies, "policy-", "doc_id", [F.col("title"), ": ", F.col("content")], "policy_docs")
    b = chunk_rows(beds, "beds-", "unit",
                   [F.col("unit"), " unit has ", F.col("beds_available").cast("string"), " of ",
                    F.col("beds_total").cast("string"), " beds available as of ", F.col("as_of"), "."],
                   "gold_bed_availability_by_unit")
    return f.unionByName(p).unionByName(b)


def null_content(chunks: DataFrame) -> DataFrame:
    """Chunks that lost their content to a null field, by source."""
    return chunks.filter(F.col("content").isNull()).groupBy("source_table").agg(F.count(F.lit(1)).alias("rows"))


def sync_index(source: DataFrame, index: DataFrame, key: str = "chunk_id", content: str = "content") -> DataFrame:
    """What an index must do to follow its source: every key with ``insert``, ``update``, ``delete`` or ``same``.
    Only keys and content hashes are shuffled."""
    s = source.select(F.col(key), F.xxhash64(content).alias("_s"), F.lit(True).alias("_in_s"))
    i = index.select(F.col(key), F.xxhash64(content).alias("_i"), F.lit(True).alias("_in_i"))
    action = (F.when(F.col("_in_i").isNull(), "insert").when(F.col("_in_s").isNull(), "delete")
              .when(F.col("_s") == F.col("_i"), "same").otherwise("update"))
    return s.join(i, key, "full").select(key, action.alias("action"))


def apply_sync(source: DataFrame, index: DataFrame, key: str = "chunk_id", content: str = "content") -> DataFrame:
    """The index after the sync: source rows that changed or are new, index rows that stayed the same. One full join brings both rows of
    a key together; columns that only one side has are null in rows of the other."""
    names = [*index.columns, *[c for c in source.columns if c not in index.columns]]
    s = source.select(F.col(key).alias("_sk"), F.struct("*").alias("_s"))
    i = index.select(F.col(key).alias("_ik"), F.struct("*").alias("_i"))
    both = s.join(i, F.col("_sk") == F.col("_ik"), "full").filter(F.col("_s").isNotNull())
    same = F.col("_i").isNotNull() & F.col(f"_s.{content}").eqNullSafe(F.col(f"_i.{content}"))
    side = lambda t, df, c: F.col(f"{t}.{c}") if c in df.columns else F.lit(None)
    return both.select(*[F.when(same, side("_i", index, c)).otherwise(side("_s", source, c)).alias(c) for c in names])


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def digest_table(df: DataFrame, key: str = "chunk_id", content: str = "content", buckets: int = 4096) -> DataFrame:
    """_bucket, rows, sum and xor of the row hashes of every bucket of keys: equal for two tables exactly where their rows are (but
    for hash collisions of both kinds at once). Partial sums; only one row a bucket and task is shuffled."""
    h = F.xxhash64(key, content)
    return df.groupBy(bucket_of(key, buckets).alias("_bucket")).agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(20,0)")).alias("total"), F.bit_xor(h).alias("parity"))


def changed_buckets(new: DataFrame, old: DataFrame) -> DataFrame:
    """The buckets whose digests differ: at most as many rows as there are buckets."""
    o = old.select("_bucket", F.struct("rows", "total", "parity").alias("_o"))
    n = new.select("_bucket", F.struct("rows", "total", "parity").alias("_n"))
    return n.join(o, "_bucket", "full").filter(~F.col("_n").eqNullSafe(F.col("_o"))).select("_bucket")


def sync_buckets(source: DataFrame, index: DataFrame, digests: DataFrame, key: str = "chunk_id", content: str = "content",
                 buckets: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(the rows of all buckets that changed, as they are after the sync, with ``_bucket``; the digests of the new index). ``index`` has the
    column ``_bucket``; stored partitioned by it, only the folders of changed buckets are read, and only those are to be rewritten
    (:func:`store_index` does both). ``digests`` is the digest table kept from the last sync. Rows of unchanged buckets are neither
    joined nor shuffled; the source is read twice, once for its digests."""
    now = digest_table(source, key, content, buckets)
    todo = F.broadcast(changed_buckets(now, digests))           # at most ``buckets`` integers
    s = source.withColumn("_bucket", bucket_of(key, buckets)).join(todo, "_bucket", "left_semi")
    i = index.join(todo, "_bucket", "left_semi")
    return apply_sync(s, i, key, content), now


def store_index(source: DataFrame, path: str, key: str = "chunk_id", content: str = "content", buckets: int = 4096) -> int:
    """Bring the index at ``path`` (rows by bucket, digests beside them) up to its source; returns the number of buckets rewritten. A
    run that is cut off leaves old digests behind, so the next one does its buckets again."""
    spark = source.sparkSession
    rows, digests = f"{path}/rows", f"{path}/digests"
    spark.catalog.refreshByPath(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(digests)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        full = source.withColumn("_bucket", bucket_of(key, buckets))
        full.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(rows)
        digest_table(source, key, content, buckets).coalesce(1).write.mode("overwrite").parquet(digests)
        return spark.read.parquet(digests).count()
    index, old = spark.read.parquet(rows), cut(spark.read.parquet(digests))
    after, now = sync_buckets(source, index, old, key, content, buckets)
    after, now = cut(after), cut(now)
    changed = cut(changed_buckets(now, old))
    # a bucket that lost all its rows has none to write over the old ones with: a row of nulls takes its place and is never read
    gone = changed.join(after.select("_bucket").distinct(), "_bucket", "left_anti")
    blank = gone.select("_bucket", *[F.lit(None).cast(t).alias(c) for c, t in after.dtypes if c != "_bucket"])
    after.unionByName(blank).repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(rows)
    now.coalesce(1).write.mode("overwrite").parquet(digests)
    return changed.count()


def read_index(spark: SparkSession, path: str, key: str = "chunk_id") -> DataFrame:
    return spark.read.parquet(f"{path}/rows").filter(F.col(key).isNotNull()).drop("_bucket")


def duplicate_keys(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys that are not unique; an index needs none."""
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
