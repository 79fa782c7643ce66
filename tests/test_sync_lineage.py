"""An index that follows its source bucket by bucket, and what answered each request."""

import os

from pyspark.sql import functions as F

from wardline.operators import chunks, lineage


def table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, content string")


def pairs(df):
    return sorted((str(r.chunk_id), str(r.content)) for r in df.select("chunk_id", "content").collect())


OLD = [(f"c{i}", f"text {i}") for i in range(200)]


def written(path):
    return {d: max(os.stat(os.path.join(path, d, f)).st_mtime_ns for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("_bucket=")}


def test_only_changed_buckets_are_rewritten(spark, tmp_path):
    path, rows = str(tmp_path / "index"), str(tmp_path / "index" / "rows")
    chunks.store_index(table(spark, OLD), path, buckets=32)
    assert pairs(chunks.read_index(spark, path)) == sorted(OLD)
    before = written(rows)
    assert chunks.store_index(table(spark, OLD[::-1]), path, buckets=32) == 0 and written(rows) == before
    new = [("c3", "other"), *OLD[4:190], ("n1", "new"), ("n2", None)]                    # updated, deleted, inserted
    n = chunks.store_index(table(spark, new), path, buckets=32)
    after = written(rows)
    touched = {d for d in after if after[d] != before.get(d)}
    assert pairs(chunks.read_index(spark, path)) == sorted((a, str(b)) for a, b in new)
    assert 0 < len(touched) == n < 32
    # all rows of some buckets go, and come back
    assert chunks.store_index(table(spark, []), path, buckets=32) > 20 and chunks.read_index(spark, path).count() == 0
    chunks.store_index(table(spark, OLD), path, buckets=32)
    assert pairs(chunks.read_index(spark, path)) == sorted(OLD)


def test_a_sync_that_was_cut_off_is_done_again(spark, tmp_path):
    path, new = str(tmp_path / "index"), [("c0", "changed"), *OLD[1:]]
    chunks.store_index(table(spark, OLD), path, buckets=8)
    digests = spark.read.parquet(path + "/digests").collect()
    chunks.store_index(table(spark, new), path, buckets=8)
    spark.createDataFrame(digests, "_bucket int, rows long, total decimal(30,0), parity long").coalesce(1).write.mode("overwrite").parquet(path + "/digests")   # rows out, digests not
    assert chunks.store_index(table(spark, new), path, buckets=8) == 1
    assert pairs(chunks.read_index(spark, path)) == sorted(new)


def test_unchanged_buckets_are_not_shuffled(spark):
    source, index = table(spark, [("c0", "changed"), *OLD[1:]]), table(spark, OLD).withColumn("_bucket", chunks.bucket_of("chunk_id", 64))
    after, _ = chunks.sync_buckets(source, index, chunks.digest_table(index, buckets=64), buckets=64)
    assert 0 < after.count() < 20 and after.filter("content = 'changed'").count() == 1
    p = after._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("FullOuter") == 2 and p.count("LeftSemi") == 2       # digests with digests, rows with rows; rows are cut down first


def test_digests_tell_tables_apart(spark):
    a = table(spark, [("a", "1"), ("b", "2"), ("b", "2"), (None, "x"), ("c", None)])
    for other in ([("a", "2"), ("b", "1"), ("b", "2"), (None, "x"), ("c", None)], [("a", "1"), ("b", "2"), (None, "x"), ("c", None)], [("a", "1"), ("b", "2"), ("b", "2"), (None, "x"), ("c", "")]):
        assert chunks.changed_buckets(chunks.digest_table(table(spark, other), buckets=4), chunks.digest_table(a, buckets=4)).count() > 0
    assert chunks.changed_buckets(chunks.digest_table(a.repartition(3), buckets=4), chunks.digest_table(a, buckets=4)).count() == 0


def test_columns_of_one_side_only(spark):
    s = table(spark, [("a", "1"), ("b", "new")]).withColumn("fresh", F.lit(1))
    i = table(spark, [("a", "1"), ("b", "old"), ("z", "gone")]).withColumn("vector", F.lit("v"))
    got = sorted(tuple(r) for r in chunks.apply_sync(s, i).select("chunk_id", "content", "vector", "fresh").collect())
    assert got == [("a", "1", "v", None), ("b", "new", None, 1)]


def test_requests_meet_what_was_live(spark):
    ts = lambda x: F.to_timestamp(x)
    changes = spark.createDataFrame([("e", "m1", 1, None, "2026-01-01 00:00:00", None), ("e", "m1", 2, None, "2026-01-02 00:00:00", "2026-01-02 12:00:00"), ("e", "m2", 3, "p", "2026-01-03 00:00:00", "2026-01-05 00:00:00"),
                                     ("e", "m2", 4, "p", "2026-01-04 00:00:00", None), ("f", "m9", 1, None, "2026-01-02 00:00:00", "2026-01-01 00:00:00")],
                                    "endpoint string, model string, version int, provider string, valid_from string, valid_to string").withColumns({c: ts(c) for c in ("valid_from", "valid_to")})
    prompts = spark.createDataFrame([("phi", "v1", "2026-01-01 00:00:00"), ("phi", "v2", "2026-01-03 06:00:00")], "path string, version string, valid_from string").withColumn("valid_from", ts("valid_from"))
    asked = spark.createDataFrame([(1, "phi", "e", "2025-12-31 00:00:00"), (2, "phi", "e", "2026-01-01 00:00:00"), (3, "phi", "e", "2026-01-02 11:59:59"), (4, "phi", "e", "2026-01-02 12:00:00"), (5, "general", "e", "2026-01-03 00:00:00"),
                                   (6, "phi", "e", "2026-01-04 12:00:00"), (7, "phi", "f", "2026-01-02 00:00:01"), (8, "phi", None, "2026-01-02 00:00:01"), (9, "phi", "e", None)], "id int, path string, endpoint string, event_time string").withColumn("event_time", ts("event_time"))
    got = {r.id: (r.prompt_version, r.model, r.model_version, r.provider, r.in_gap) for r in lineage.request_lineage(asked, prompts, changes).collect()}
    none = (None, None, None, True)
    assert got == {1: (None, *none), 2: ("v1", "m1", 1, None, False), 3: ("v1", "m1", 2, None, False), 4: ("v1", *none), 5: (None, "m2", 3, "p", False), 6: ("v2", "m2", 4, "p", False), 7: ("v1", *none), 8: ("v1", *none), 9: (None, *none)}
    bad = sorted((r.endpoint, r.problem, str(r.starts), str(r.ends)) for r in lineage.history_problems(changes).collect())
    assert bad == [("e", "gap", "2026-01-02 12:00:00", "2026-01-03 00:00:00"), ("e", "overlap", "2026-01-04 00:00:00", "2026-01-05 00:00:00"), ("f", "inverted", "2026-01-01 00:00:00", "2026-01-02 00:00:00")]


def test_asof_goes_through_one_sort(spark):
    """Requests and versions of an hour never meet as pairs, and an instant, a null or a row that comes twice changes nothing."""
    from datetime import datetime, timedelta

    from wardline.operators import lineage

    t0 = datetime(2024, 1, 1, 23, 58)
    at = [None if i % 13 == 5 else t0 + timedelta(seconds=(i * 37) % 9000) for i in range(300)]
    versions = [(f"e{i % 2}" if i % 7 else None, i, at[i]) for i in range(0, 300, 3)]
    asked = [(i, f"e{i % 3}" if i % 11 else None, at[i]) for i in range(300)] + [(7, "e1", at[7])]
    v = spark.createDataFrame(versions, "endpoint string, version int, valid_from timestamp")
    r = spark.createDataFrame(asked, "id int, endpoint string, event_time timestamp")
    out = lineage.lineage_asof(r, v)
    assert "NestedLoop" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "event_time" not in "".join(x for x in plan.splitlines() if "Join" in x)

    def live(e, t):
        before = [f for x, _, f in versions if e is not None and t is not None and f is not None and x == e and f <= t]
        return max(before) if before else None

    assert sorted((x.id, str(x.valid_from)) for x in out.collect()) == sorted((i, str(live(e, t))) for i, e, t in asked)
