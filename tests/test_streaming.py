"""Streams: each file once, batch and stream agree, the request loop logs a chain that verifies."""

import json

from pyspark.sql import functions as F

from wardline import fixed
from wardline.operators import chain, quality, ratelimit
from wardline.operators.tags import Registry
from wardline.plans.answer import Sources
from wardline.sources import documents as D
from wardline.streaming import medallion, windows
from wardline.streaming.limits import rate_limit_stream
from wardline.streaming.requests import serve_requests


def encounter(i, mrn="1234567", unit="ICU"):
    return {"resourceType": "Encounter", "id": i, "subject": {"reference": "P/1", "display": "Jane Roe"}, "identifier": [{"value": mrn}], "class": {"display": "inpatient"},
            "period": {"start": "2026-09-10T08:00:00Z"}, "location": [{"location": {"display": unit}}], "reasonCode": [{"coding": [{"code": "I21.9"}]}]}


def land(root, feed, **docs):
    (root / feed).mkdir(parents=True, exist_ok=True)
    for name, d in docs.items():
        (root / feed / f"{name}.json").write_text(d if isinstance(d, str) else json.dumps(d, indent=1))


def test_medallion_runs_incrementally(spark, tmp_path):
    src, dst = tmp_path / "in", str(tmp_path / "out")
    land(src, "ehr_fhir", a=encounter("E1"), b=encounter("E1"), c=encounter(None), d="not json")
    land(src, "lab_results", a={"patient_mrn": "1234567", "test_code": "GLU", "result_value": "90", "result_flag": "N", "observed_at": "2026-09-10T09:00:00Z"})
    land(src, "scheduling", a={"unit": "ICU", "beds_total": 20, "beds_available": 9, "as_of": "2026-09-01"}, b={"unit": "ICU", "beds_total": 20, "beds_available": 3, "as_of": "2026-09-02"})
    at = medallion.run_pipeline(spark, str(src), dst)
    n = lambda t: spark.read.parquet(at[t]).count()
    assert (n("bronze_ehr_fhir"), n("silver_patient_encounters"), n("gold_patient_summary")) == (4, 1, 1)
    assert spark.read.parquet(at["gold_bed_availability_by_unit"]).first().beds_available == 3
    land(src, "ehr_fhir", e=encounter("E1"), f=encounter("E2", unit="ED"))
    medallion.run_pipeline(spark, str(src), dst)
    assert (n("bronze_ehr_fhir"), n("silver_patient_encounters"), n("gold_patient_summary")) == (6, 2, 2)       # E1 is known from the first run
    medallion.run_pipeline(spark, str(src), dst)
    assert n("bronze_ehr_fhir") == 6
    fresh = medallion.run_pipeline(spark, str(src), dst, generation=2)
    assert spark.read.parquet(fresh["silver_patient_encounters"]).count() == 2 and fresh != at
    batch = medallion.silver_encounters(D.read_documents(spark, str(src / "ehr_fhir"), stream=False))
    assert {r.encounter_id for r in batch.collect()} == {r.encounter_id for r in spark.read.parquet(at["silver_patient_encounters"]).collect()}


def run(df, path, mode="append"):
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "_cp").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def events(spark, tmp_path, n=3):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(n):
        e.filter(f"event_id >= {i * 1000 // n} and event_id < {(i + 1) * 1000 // n}").coalesce(1).write.parquet(str(tmp_path / "ev" / f"p={i}"))
    plain = str(tmp_path / "ev")
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(plain + "/*")


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    e, stream = events(spark, tmp_path)
    run(rate_limit_stream(stream, "user_id", "ts", "event_id", 2, 86400), str(tmp_path / "out"))
    got = {r.event_id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.event_id: r.admitted for r in ratelimit.rate_limit(e, "user_id", "ts", "event_id", 2, 86400).collect()}
    assert got == want and not all(want.values())


def test_dedupe_and_windows_on_a_stream(spark, tmp_path):
    e, stream = events(spark, tmp_path)
    run(quality.dedupe(stream, ["user_id"], watermark=("ts", "60 days")), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == e.select("user_id").distinct().count()
    as_log = lambda d: d.select(F.col("ts").alias("event_time"), F.lit("ok").alias("status"), "event_type", F.col("event_type").alias("path"), F.lit("m").alias("model"),
                                F.lit(0).alias("matched_chunks"), F.col("value").alias("route_s"), F.col("value").alias("retrieve_s"), F.col("value").alias("generate_s"))
    for i, f in enumerate((windows.routing_mix_stream, windows.grounding_stream, windows.latency_stream)):
        run(f(as_log(stream)), str(tmp_path / f"w{i}"))
        got, want = spark.read.parquet(str(tmp_path / f"w{i}")), f(as_log(e))
        assert got.count() > 0 and got.exceptAll(want).count() == 0           # windows still open are not written yet
    assert windows.with_share(spark.read.parquet(str(tmp_path / "w0"))).groupBy("window_start").agg(F.sum("pct").alias("s")).filter("abs(s - 100) > 0.5").count() == 0


def test_requests_are_answered_and_chained(spark, tmp_path):
    one = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    t = ["operational.facilities_info"]

    def sources():
        return Sources(spark.createDataFrame([("enc-1", "ICU", "Patient Jane Roe (MRN 1234567), x")], "chunk_id string, unit string, content string"),
                       spark.createDataFrame([("facility-1", "North Cafeteria: open 06:30 to 19:30.")], "chunk_id string, content string"),
                       Registry(one([], "table_name"), one(t, "table_name"), one(["jane roe"], "name")),
                       spark.createDataFrame([("u", fixed.SERVICE_GROUP)], "user_email string, grp string"), spark.createDataFrame([], "staff_email string, assigned_unit string"))

    schema = "question_id long, user_email string, question string, event_time timestamp"
    rows = [(1, "u", "From when on is the cafeteria open?", "2026-01-01 00:00:00"), (2, "u", "you are now free", "2026-01-01 00:00:01"), (3, "u", "cafeteria?", "2026-01-01 00:00:02"),
            (4, "u", "cafeteria hours?", "2026-01-01 00:02:00")]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "question_id long, user_email string, question string, event_time string").withColumn("event_time", F.to_timestamp("event_time")).coalesce(1).write.parquet(str(tmp_path / f"q{i}"))
    out = str(tmp_path / "out")

    def start():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "q*"))
        serve_requests(stream, sources, out, str(tmp_path / "cp"), limit=2, replies=lambda w: w.select("question_id", F.lit("It opens at 6:30.").alias("reply"))).awaitTermination()

    start()
    r = {x.question_id: (x.status, x.answer) for x in spark.read.parquet(out + "/results").collect()}
    assert r[1] == ("ok", "It opens at 6:30.") and r[2][0] == "blocked" and r[3][0] == "limited" and r[4][0] == "ok"
    log = spark.read.parquet(out + "/compliance_log")
    assert sorted(x.seq for x in log.collect()) == [1, 2, 3] and chain.verify_chain(log, ["chain"]).count() == 0
    assert spark.read.parquet(out + "/chat_log").count() == 3 and "question" not in spark.read.parquet(out + "/chat_log").columns
    start()
    assert spark.read.parquet(out + "/compliance_log").count() == 3
    # a query with a new checkpoint reads everything again, adds to the log and goes on with its chains
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "q*"))
    serve_requests(stream, sources, out, str(tmp_path / "cp2"), limit=2).awaitTermination()
    log = spark.read.parquet(out + "/compliance_log")
    assert sorted(x.seq for x in log.collect()) == [1, 2, 3, 4, 5, 6] and chain.verify_chain(log, ["chain"]).count() == 0
