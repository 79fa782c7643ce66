"""Expectations on streams: every row is kept or kept aside, counted once, whatever is run again."""

import json

import pytest
from pyspark.sql import functions as F

from wardline.operators import quality
from wardline.streaming import medallion
from wardline.streaming import quarantine as Q

SCHEMA = "id long, v int"


def rules():
    return {"has_id": F.col("id").isNotNull(), "positive": F.col("v") > 0}


def load(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def start(spark, tmp_path, keys=None, name="checks"):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("_arrived", F.current_timestamp())
    out = Q.checked(s, rules(), name, keys, ("_arrived", "1 day")).drop("_arrived")
    q = Q.write_checked(out, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    return out.schema


def counts(spark, tmp_path):
    return {(r.outcome, r.rule): r.n for r in Q.read_counts(spark, f"{tmp_path}/out").groupBy("outcome", "rule").agg(F.sum("rows").alias("n")).collect()}


FIRST = [(1, 5), (1, 5), (None, 1), (None, -1), (2, 0), (3, None), (4, 7)]
SECOND = [(1, 9), (5, 1), (None, 1), (2, 3)]


def test_kept_dropped_and_counted(spark, tmp_path):
    listener = Q.QualityListener()
    spark.streams.addListener(listener)
    try:
        load(spark, f"{tmp_path}/in", FIRST)
        schema = start(spark, tmp_path, ["id"])
        load(spark, f"{tmp_path}/in", SECOND)
        start(spark, tmp_path, ["id"])
        start(spark, tmp_path, ["id"])                          # nothing new: nothing more
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(listener)
    kept = sorted((r.id, r.v) for r in Q.read_outcome(spark, f"{tmp_path}/out", schema, Q.KEPT).collect())
    assert kept == [(1, 5), (2, 3), (4, 7), (5, 1)]             # 1 came again in both loads; the dropped 2 doesn't count as seen
    dropped = sorted((str(r.id), str(r.v), tuple(r.failed_rules)) for r in Q.read_outcome(spark, f"{tmp_path}/out", schema, Q.DROPPED).collect())
    assert dropped == [("2", "0", ("positive",)), ("3", "None", ("positive",)), ("None", "-1", ("has_id", "positive")), ("None", "1", ("has_id",)), ("None", "1", ("has_id",))]
    assert counts(spark, tmp_path) == {("kept", ""): 4, ("dropped", ""): 5, ("dropped", "has_id"): 3, ("dropped", "positive"): 3}
    assert listener.totals("checks") == {"rows": 9, "failed_has_id": 3, "failed_positive": 3}
    assert listener.totals("checks_passed") == {"rows": 6} and listener.totals("unknown") == {}


def test_a_batch_that_failed_half_way_is_written_again(spark, tmp_path, monkeypatch):
    """The data of a batch is out, its counts aren't, and the query dies: the restart replaces the batch."""
    load(spark, f"{tmp_path}/in", FIRST)
    whole = Q.read_outcome

    def fail(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(Q, "read_outcome", fail)
    with pytest.raises(Exception, match="lost"):
        start(spark, tmp_path)
    assert Q._exists(spark, f"{tmp_path}/out/outcome=kept") and not Q._exists(spark, f"{tmp_path}/out/_quality")
    monkeypatch.setattr(Q, "read_outcome", whole)
    schema = start(spark, tmp_path)
    assert Q.read_outcome(spark, f"{tmp_path}/out", schema, Q.KEPT).count() == 3 and Q.read_outcome(spark, f"{tmp_path}/out", schema, Q.DROPPED).count() == 4
    assert counts(spark, tmp_path) == {("kept", ""): 3, ("dropped", ""): 4, ("dropped", "has_id"): 2, ("dropped", "positive"): 3}


def test_tables_without_rows_are_empty(spark, tmp_path):
    assert Q.read_counts(spark, f"{tmp_path}/none").count() == 0
    assert Q.read_outcome(spark, f"{tmp_path}/none", spark.createDataFrame([], SCHEMA).schema, Q.DROPPED).columns == ["id", "v", "run", "batch_id"]
    load(spark, f"{tmp_path}/in", [(1, 1)])
    schema = start(spark, tmp_path)
    assert Q.read_outcome(spark, f"{tmp_path}/out", schema, Q.DROPPED).count() == 0
    assert counts(spark, tmp_path) == {("kept", ""): 1, ("dropped", ""): 0}


def test_expect_or_drop_on_a_stream_reports_in_its_progress(spark, tmp_path):
    load(spark, f"{tmp_path}/in", FIRST)
    good, _, obs = quality.expect_or_drop(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), rules(), "seen")
    assert obs is None
    q = good.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [p.observedMetrics["seen"].asDict() for p in q.recentProgress if p.numInputRows] == [{"rows": 7, "failed_has_id": 2, "failed_positive": 3}]
    assert spark.read.parquet(f"{tmp_path}/o").count() == 3


def test_medallion_keeps_what_it_drops(spark, tmp_path):
    src = tmp_path / "in"
    for feed in medallion.FEEDS:
        (src / feed).mkdir(parents=True)
    (src / "ehr_fhir" / "a.json").write_text("\n".join([json.dumps({"id": "E1"}), "not json", json.dumps({"id": None}), json.dumps({"id": "E1"})]))
    at = medallion.run_pipeline(spark, str(src), str(tmp_path / "out"), lines=True)
    got = {(r.table_name, r.outcome, r.rule): r.rows for r in medallion.quality_counts(spark, at).collect()}
    t = "silver_patient_encounters"
    assert got == {(t, "kept", ""): 1, (t, "dropped", ""): 2, (t, "dropped", "valid_encounter_id"): 2}
    assert spark.read.parquet(at[t]).count() == 1 and spark.read.parquet(at["gold_patient_summary"]).count() == 1
