"""Requests behind the watermark are refused, not lost."""

from pyspark.sql import functions as F

from test_streaming import run
from wardline.streaming.limits import rate_limit_stream


def test_late_rows_get_a_verdict(spark, tmp_path):
    parts = [[(1, "u", "2026-01-02 12:00:00")], [(2, "u", "2026-01-02 12:00:01")], [(3, "u", "2026-01-02 09:00:00"), (4, "v", "2026-01-02 09:00:00"), (5, "u", "2026-01-02 12:00:02"), (6, "v", None)]]
    stream = None
    for i, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "id long, user string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1)
        df.write.parquet(str(tmp_path / f"q{i}"))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "q*"))
    run(rate_limit_stream(stream, "user", "ts", "id", 3, 60), str(tmp_path / "out"))
    got = {r.id: (r.admitted, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, True), 4: (False, True), 5: (True, False), 6: (False, True)}


def test_state_of_one_time_keys_is_removed(spark, tmp_path):
    """Thousands of keys that ask once leave nothing behind once the watermark has passed their window; null and '' are two keys."""
    many = spark.range(3000).select((F.col("id") + 100).alias("id"), F.concat(F.lit("k"), "id").alias("user"), F.timestamp_seconds(F.lit(1_767_355_200) + F.col("id") % 60).alias("ts"))
    odd = spark.createDataFrame([(1, None), (2, None), (3, ""), (4, "")], "id long, user string").withColumn("ts", F.timestamp_seconds(F.lit(1_767_355_200)))
    next_day = spark.createDataFrame([(5, "z")], "id long, user string").withColumn("ts", F.timestamp_seconds(F.lit(1_767_355_200 + 86_400)))
    path = str(tmp_path / "in")
    for part in (many.unionByName(odd), next_day):
        part.coalesce(1).write.mode("append").parquet(path)
        q = (rate_limit_stream(spark.readStream.schema(many.schema).parquet(path), "user", "ts", "id", 1, 60).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        q.awaitTermination()
    states = [sum(o.numRowsTotal for o in p.stateOperators) for p in q.recentProgress]
    assert max(states) >= 3000 and states[-1] <= 1
    assert sum(o.numRowsDroppedByWatermark for p in q.recentProgress for o in p.stateOperators) == 0
    got = {r.id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 3005 and [got[i] for i in (1, 2, 3, 4, 5)] == [True, False, True, False, True]


def test_python_is_called_once_a_bucket(spark, tmp_path, monkeypatch):
    """Keys share buckets, and one bucket's keys are told apart; the verdicts are those of the batch form."""
    from wardline.operators import ratelimit
    from wardline.streaming import limits

    monkeypatch.setattr(limits, "BUCKETS", 3, raising=False)
    rows = spark.range(600).select("id", F.concat(F.lit("k"), F.col("id") % 40).alias("user"), F.timestamp_seconds(F.lit(1_767_355_200) + F.col("id") % 90).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    calls = spark.sparkContext.accumulator(0)

    class Counted(limits.Admission):
        def handleInputRows(self, key, rows, timers):
            calls.add(1)
            return super().handleInputRows(key, rows, timers)

    monkeypatch.setattr(limits, "Admission", Counted)
    run(rate_limit_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "user", "ts", "id", 3, 60), str(tmp_path / "out"))
    got = {r.id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.id: r.admitted for r in ratelimit.rate_limit(rows, "user", "ts", "id", 3, 60).collect()} and not all(got.values())
    assert 1 <= calls.value <= 3
