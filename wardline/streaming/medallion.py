"""Raw documents to bronze, silver and gold: incremental where the data only grows, recomputed where it does not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import parse as P
from wardline.operators import gold, quality
from wardline.sources import documents as D
from wardline.sources import tables as S
from wardline.streaming import quarantine as Q

FEEDS = ("ehr_fhir", "lab_results", "scheduling")
BRONZE = "value string, source_file string"
#: expectations by silver table; every other row is kept
RULES = {"silver_patient_encounters": {"valid_encounter_id": "encounter_id IS NOT NULL"}}
#: keys of which the first row to arrive is kept, for as long as REMEMBERED after it arrived
KEYS = {"silver_patient_encounters": ["encounter_id"]}
REMEMBERED = "30 days"


def _append(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run what has arrived since the last run into a Parquet table, then stop. Raw texts repeat themselves, so they are written with zstd."""
    q = (df.writeStream.format("parquet").option("compression", "zstd").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def parse_encounters(bronze: DataFrame) -> DataFrame:
    return P.parse_json(bronze, P.ENCOUNTER_PATHS, ingested_at=True)


def silver_encounters(bronze: DataFrame) -> DataFrame:
    """The batch form: parsed encounters, one per id, rows without an id dropped."""
    good, _, _ = quality.expect_or_drop(parse_encounters(bronze), {n: F.expr(c) for n, c in RULES["silver_patient_encounters"].items()})
    return quality.dedupe(good, KEYS["silver_patient_encounters"], [F.col("_ingested_at"), F.col("period_start")])


def silver_labs(bronze: DataFrame) -> DataFrame:
    return P.parse_json(bronze, P.LAB_PATHS, ingested_at=True)


def silver_beds(bronze: DataFrame) -> DataFrame:
    return P.parse_json(bronze, P.BED_PATHS, P.BED_CASTS)


def gold_patient_summary(encounters: DataFrame, labs: DataFrame) -> DataFrame:
    return gold.join_child_to_parent(encounters, labs.withColumnRenamed("_ingested_at", "_lab_ingested_at"))


def gold_beds(beds: DataFrame) -> DataFrame:
    cols = ["beds_total", "beds_available", "as_of"]
    return gold.latest_by(beds.filter("unit is not null"), ["unit"], F.when(F.col("as_of").isNotNull(), F.struct("as_of", "beds_total", "beds_available")), cols)


SILVER = {"silver_patient_encounters": ("ehr_fhir", parse_encounters), "silver_lab_results": ("lab_results", silver_labs),
          "silver_bed_availability": ("scheduling", silver_beds)}


def run_pipeline(spark: SparkSession, src: str, dst: str, generation: int = 1, max_files: int | None = None, lines: bool = False,
                 remembered: str = REMEMBERED) -> dict[str, str]:
    """One incremental run over the three feeds under ``src`` (a document per file, or per line with ``lines``); returns the folder of
    each table. Silver tables are written with what they drop and with their counts (:mod:`wardline.streaming.quarantine`); the folder
    returned for one holds the kept rows, ``checked_<table>`` is the folder of the whole. Checkpoints lie beside the tables in the shared
    folder ``dst``, so a run that lost its driver is simply started again. A full refresh is a run with the next ``generation``: new
    tables, new checkpoints, all files read again.

    Ids are told apart by the time of arrival, which never runs behind: an id is forgotten ``remembered`` after it came, so the state is
    bounded by the ids of that time, and no row is lost to the watermark. A copy that comes later still is a row again."""
    root = f"{dst}/generation={generation}"
    at = {f"bronze_{f}": f"{root}/bronze_{f}" for f in FEEDS}
    at |= {f"checked_{t}": f"{root}/{t}" for t in SILVER} | {t: f"{root}/{t}/outcome={Q.KEPT}" for t in SILVER}
    at |= {t: f"{root}/{t}" for t in ("gold_patient_summary", "gold_bed_availability_by_unit")}
    for f in FEEDS:
        _append(D.read_documents(spark, f"{src}/{f}", max_files=max_files, lines=lines), at[f"bronze_{f}"], f"{root}/_checkpoints/bronze_{f}")
    t = {}
    for name, (feed, parse) in SILVER.items():
        rows = parse(D.stream_table(spark, at[f"bronze_{feed}"], BRONZE, max_files)).withColumn("_arrived", F.current_timestamp())
        rules = {n: F.expr(c) for n, c in RULES.get(name, {}).items()}
        out = Q.checked(rows, rules, name, KEYS.get(name), ("_arrived", remembered)).drop("_arrived")
        Q.write_checked(out, at[f"checked_{name}"], f"{root}/_checkpoints/{name}").awaitTermination()
        t[name] = Q.read_outcome(spark, at[f"checked_{name}"], out.drop("failed_rules").schema, Q.KEPT).drop("run", "batch_id")
    S.overwrite(gold_patient_summary(t["silver_patient_encounters"], t["silver_lab_results"]), at["gold_patient_summary"])
    S.overwrite(gold_beds(t["silver_bed_availability"]), at["gold_bed_availability_by_unit"])
    return at


def quality_counts(spark: SparkSession, at: dict[str, str]) -> DataFrame:
    """table_name, outcome, rule, rows of all runs so far: kept rows, dropped rows (rule empty), and dropped rows by rule."""
    each = [Q.read_counts(spark, at[f"checked_{t}"]).groupBy("outcome", "rule").agg(F.sum("rows").alias("rows")).select(F.lit(t).alias("table_name"), "outcome", "rule", "rows") for t in SILVER]
    return each[0].unionByName(each[1]).unionByName(each[2])
