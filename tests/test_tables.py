"""Gold, chunks, quality, governance, monitoring and table writers on small hand-written rows."""

import pytest
from pyspark.sql import functions as F

from wardline import fixed
from wardline.functions import parse as P
from wardline.operators import audit, chunks, gold, lineage, monitor, policy, quality, tags
from wardline.plans.governance import governance_refresh, refresh_chunks
from wardline.sources import tables as S

ENC = "encounter_id string, patient_ref string, patient_name string, mrn string, encounter_class string, period_start string, unit string, diagnosis_code string"
LAB = "mrn string, lab_encounter_id string, test_code string, result_value string, result_flag string, observed_at string"
E1 = ("E1", "P/1", "Jane Roe", "1234567", "inpatient", "2026-09-10T08:00:00Z", "ICU", "I21.9")


def enc(spark, *rows):
    return spark.createDataFrame(list(rows), ENC)


def lab(spark, *rows):
    return spark.createDataFrame(list(rows), LAB)


def test_children_meet_their_parent_or_all(spark):
    e = enc(spark, E1, ("E2", *E1[1:]), ("E3", "P/2", "Wei Chen", "9", *E1[4:]), ("E4", "P/3", "No Mrn", None, *E1[4:]))
    x = lab(spark, ("1234567", "E1", "GLU", "1", "N", "t"), ("1234567", None, "NA", "2", "N", "t"), ("1234567", "NOBODY", "CR", "3", "N", "t"),
            ("9", "E1", "HGB", "4", "N", "t"), (None, None, "WBC", "5", "N", "t"))
    got = sorted(((r.encounter_id, r.test_code) for r in gold.join_child_to_parent(e, x).collect()), key=str)
    assert got == [("E1", "GLU"), ("E1", "NA"), ("E2", "NA"), ("E3", None), ("E4", None)]


def test_latest_row_does_not_mix_snapshots(spark):
    df = spark.createDataFrame([("A", 9, 1, "2026-01-02"), ("A", 5, 5, "2026-01-01"), ("B", 1, 1, None)], "unit string, total int, free int, as_of string")
    got = {r.unit: (r.total, r.free, r.as_of) for r in gold.latest_by(df, ["unit"], "as_of", ["total", "free", "as_of"]).collect()}
    assert got == {"A": (9, 1, "2026-01-02"), "B": (None, None, None)}


def test_reference_ranges(spark):
    x = lab(spark, *[("1", None, c, v, "N", "t") for c, v in [("GLU", "69"), ("GLU", "70"), ("GLU", "99.5"), ("XX", "1"), ("NA", "n/a")]])
    got = [r.computed_flag for r in gold.flag_results(x, gold.reference_ranges(spark)).orderBy("test_code", "result_value").collect()]
    assert got == ["L", "N", "H", None, None]


def test_chunk_text(spark):
    x = lab(spark, ("1234567", "E1", "NA", "140", "N", "2026-10-01T00:00:00Z"), ("1234567", "E1", "GLU", "90", "H", "2026-09-30T09:30:00Z"), ("1234567", "E1", "K", "4", "N", "2026-10-01T00:00:00Z"),
            ("1234567", "E1", "CR", None, "N", "2026-09-01T00:00:00Z"))
    e = enc(spark, E1, ("E2", "P/2", "Wei Chen", "9", *E1[4:]), ("E3", "P/3", None, "8", *E1[4:]))
    got = {r.chunk_id: r.content for r in chunks.chunk_parents(gold.join_child_to_parent(e, x)).collect()}
    assert got["enc-E1"] == ("Patient Jane Roe (MRN 1234567), inpatient encounter E1 on 2026-09-10T08:00:00Z in ICU, diagnosis code I21.9. Labs: glucose (GLU) = 90 (flag H) at 2026-09-30T09:30:00Z; "
                             "K = 4 (flag N) at 2026-10-01T00:00:00Z; sodium (NA) = 140 (flag N) at 2026-10-01T00:00:00Z.")
    assert got["enc-E2"].endswith("diagnosis code I21.9.") and got["enc-E3"] is None


def test_parse_survives_bad_documents(spark):
    docs = ['{"unit":"ICU","beds_total":20,"beds_available":"x","as_of":"t","more":1}', "not json", '{"unit":"ED","beds_total":"5"}', "{}"]
    df = spark.createDataFrame([(d,) for d in docs], "value string")
    got = [tuple(r) for r in P.parse_json(df, P.BED_PATHS, P.BED_CASTS).collect()]
    assert got == [("ICU", 20, None, "t"), (None,) * 4, ("ED", 5, None, None), (None,) * 4]


def test_expectations(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", None), (None, None)], "id string, v int")
    good, bad, obs = quality.expect_or_drop(df, {"has_id": F.col("id").isNotNull(), "positive": F.col("v") > 0})
    assert [r.id for r in good.collect()] == ["a"]
    assert obs.get == {"rows": 4, "failed_has_id": 2, "failed_positive": 2}
    assert sorted(map(str, (r.failed_rules for r in bad.collect()))) == ["['has_id', 'positive']", "['has_id']", "['positive']"]


def people(spark):
    g = spark.createDataFrame([("sp", fixed.SERVICE_GROUP), ("doc", fixed.STAFF_GROUP), ("idle", fixed.STAFF_GROUP)], "user_email string, grp string")
    s = spark.createDataFrame([("doc", "ICU"), ("doc", "ED"), ("ghost", "ICU")], "staff_email string, assigned_unit string")
    return g, s


@pytest.mark.parametrize("user,rows,name", [("sp", 3, fixed.MASK_TEXT), ("doc", 2, "Jane Roe"), ("idle", 0, None), ("ghost", 0, None), ("nobody", 0, None)])
def test_secure_view(spark, user, rows, name):
    g, s = people(spark)
    e = enc(spark, E1, ("E2", *E1[1:6], "ED", "x"), ("E3", *E1[1:6], None, "x"))
    tt = spark.createDataFrame([("e", "classification", "phi"), ("e", "row_scope", "unit")], "table_name string, tag_name string, tag_value string")
    ct = spark.createDataFrame([("e", "unit", "unit_key", "true")], "table_name string, column_name string, tag_name string, tag_value string")
    v = policy.secure_view(e, "e", user, tt, ct, g, s, ["patient_name"])
    assert v.count() == rows and (not rows or v.filter("encounter_id = 'E1'").first().patient_name == name)
    scopes = policy.reader_scopes(spark.createDataFrame([(user,)], "user_email string"), g, s)
    assert policy.visible_counts(e, "unit", scopes).first().visible_rows == rows
    clinical = spark.createDataFrame([("e", "classification", "phi"), ("e", "row_scope", "clinical")], "table_name string, tag_name string, tag_value string")
    assert policy.secure_view(e, "e", user, clinical, ct, g, s).count() == (3 if user in ("sp", "doc", "idle") else 0)


TAGS = "table_name string, tag_name string, tag_value string"
KEYS = "table_name string, column_name string, tag_name string, tag_value string"


@pytest.mark.parametrize("tagged,key,seen", [
    ([("e", "classification", "phi")], True, {"sp": 3, "doc": 3, "idle": 3, "nobody": 0}),                               # no scope yet: the role gate
    ([("e", "classification", "phi"), ("e", "row_scope", "other")], True, {"sp": 3, "doc": 3, "idle": 3, "nobody": 0}),
    ([("e", "classification", "phi"), ("e", "row_scope", "unit")], False, {"sp": 3, "doc": 0, "idle": 0, "nobody": 0}),   # no key column
    ([("e", "row_scope", "unit"), ("e", "classification", "general")], True, {"nobody": 3}), ([], False, {"nobody": 3})])
def test_tags_that_are_half_done_leave_nothing_open(spark, tagged, key, seen):
    g, s = people(spark)
    e = enc(spark, E1, ("E2", *E1[1:6], "ED", "x"), ("E3", *E1[1:6], None, "x"))
    ct = spark.createDataFrame([("e", "unit", "unit_key", "true")] if key else [("e", "unit_price", "unit_key", "true")], KEYS)
    for user, rows in seen.items():
        assert policy.secure_view(e, "e", user, spark.createDataFrame(tagged, TAGS), ct, g, s).count() == rows, user


def test_membership_is_read_when_the_frame_is(spark, tmp_path):
    """The same frame, run again after a reader left a group: no job runs while it is built."""
    source = tmp_path / "groups"
    source.write_text("sp " + fixed.SERVICE_GROUP + "\ndoc " + fixed.STAFF_GROUP)
    path = str(source)

    def members(batches):
        import pandas as pd

        for _ in batches:
            yield pd.DataFrame([x.split() for x in open(path).read().splitlines()], columns=["user_email", "grp"])

    g, s = spark.range(1).coalesce(1).mapInPandas(members, "user_email string, grp string"), people(spark)[1]
    e = enc(spark, E1, ("E2", *E1[1:6], "ED", "x"), ("E3", *E1[1:6], None, "x"))
    spark.sparkContext.setJobGroup("building", "")
    kept = [policy.filter_by_unit(e, "doc", "unit", g, s), policy.filter_by_role(e, "doc", g), policy.mask(e, ["patient_name"], "doc", g).filter("patient_name = 'Jane Roe'")]
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    spark.sparkContext.setJobGroup("reading", "")
    assert [k.count() for k in kept] == [2, 3, 3]
    source.write_text("sp " + fixed.SERVICE_GROUP)
    assert [k.count() for k in kept] == [0, 0, 0]


def test_unit_filter_prunes_partitions(spark, tmp_path):
    g, s = people(spark)
    path = str(tmp_path / "t")
    spark.range(100).select("id", F.concat(F.lit("U"), F.col("id") % 10).alias("unit")).unionByName(spark.createDataFrame([(1000, "ICU"), (1001, "ED")], "id long, unit string")).write.partitionBy("unit").parquet(path)
    t = spark.read.parquet(path)
    tt, ct = spark.createDataFrame([("t", "classification", "phi"), ("t", "row_scope", "unit")], TAGS), spark.createDataFrame([("t", "unit", "unit_key", "true")], KEYS)
    for v in (policy.filter_by_unit(t, "doc", "unit", g, s), policy.secure_view(t, "t", "doc", tt, ct, g, s, unit_cols=["unit"])):
        assert sorted(r.id for r in v.collect()) == [1000, 1001]
        plan = v._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "unit" in plan.split("PartitionFilters:")[1].split("\n")[0]


def test_classifier_and_tags(spark):
    df = spark.createDataFrame([("1234567", "x", "a@b.org", "ICU", 1, "free", "123-45-6789")] * 30, "code string, _x string, note string, unit string, available int, text string, other string")
    c = {r.column_name: (r.label, r.strong) for r in tags.classify_columns(df, "t", "clinical").collect()}
    assert c == {"code": ("phi", True), "_x": (None, False), "note": ("pii", False), "unit": (None, False), "available": (None, False) if "lab" not in "available" else ("phi", False),
                 "text": (None, False), "other": ("phi", True)}
    ops = spark.createDataFrame([("2026-01-01", "free")], "when string, label string")
    empty = spark.createDataFrame([], "a string")
    old_t = spark.createDataFrame([("o", "classification", "phi"), ("gone", "classification", "phi"), ("none", "classification", "pii")], "table_name string, tag_name string, tag_value string")
    old_c = spark.createDataFrame([("t", "text", "classification", "pii"), ("gone", "a", "classification", "pii")], "table_name string, column_name string, tag_name string, tag_value string")
    tt, ct, skipped = governance_refresh({"t": ("clinical", df), "o": ("operational", ops), "none": ("clinical", empty)}, old_t, old_c)
    assert skipped == ["none"]
    assert {tuple(r) for r in tt.collect()} == {("t", "classification", "phi"), ("t", "row_scope", "unit"), ("o", "classification", "general"), ("gone", "classification", "phi"), ("none", "classification", "pii")}
    assert {tuple(r) for r in ct.collect()} == {("t", "code", "classification", "phi"), ("t", "note", "classification", "pii"), ("t", "available", "classification", "phi"),
                                                ("t", "other", "classification", "phi"), ("t", "unit", "unit_key", "true"), ("gone", "a", "classification", "pii"), ("o", "label", "classification", "phi")}
    again = tags.apply_tags(ct, ct.filter("table_name = 't'"), spark.createDataFrame([("t",)], "table_name string"))
    assert again.count() == ct.count()


def test_access_review_with_and_without_nulls(spark):
    audit_rows = spark.createDataFrame([("2026-01-01", ("a",), ("clinical.x",), "getTable", "catalog"), ("2026-01-02", ("b",), ("clinical.y",), "getTable", "catalog"),
                                        ("2026-01-03", (None,), ("clinical.y",), "getTable", "catalog"), ("2026-01-04", ("b",), ("other.y",), "getTable", "catalog")],
                                       "event_time string, user_identity struct<email:string>, request_params struct<full_name_arg:string>, action_name string, service_name string")
    reads = audit.flatten_access_audit(audit_rows)
    staff = spark.createDataFrame([("a", "ICU")], "staff_email string, assigned_unit string")
    holes = staff.union(spark.createDataFrame([(None, "ED")], staff.schema))
    who = lambda s, n: {r.user_email for r in audit.access_review(reads, s, "clinical.", null_aware=n).collect()}
    assert who(staff, False) == who(holes, False) == {"b", None}
    assert who(staff, True) == {"b"} and who(holes, True) == set()
    assert [r.user_email for r in audit.touches(reads, "clinical.", 2).collect()] == [None, "b"]


def test_writers(spark, tmp_path):
    p = str(tmp_path / "t")
    schema = "staff_email string, assigned_unit string"
    assert S.load_reference(spark, [("a", "ICU")], schema, p).count() == 1
    S.merge_insert_missing_into(spark, p, spark.createDataFrame([("a", "ICU"), ("a", "ED")], schema), ["staff_email", "assigned_unit"])
    S.append_rows(spark.createDataFrame([("a", "ED")], schema), p)
    assert spark.read.parquet(p).count() == 3
    assert S.missing_inputs(spark, {"t": p, "u": p + "x"}) == ["u"]
    with pytest.raises(LookupError):
        S.require(spark, {"u": p + "x"})
    S.copy_table(spark.read.parquet(p), p + "2", ["staff_email"])
    assert spark.read.parquet(p + "2").columns == ["staff_email"] and S.non_empty(spark.read.parquet(p)) and not S.non_empty(spark.read.parquet(p).filter("false"))
    log = S.AppendOnlyTable(p + "3", audit.CHAT_LOG)
    assert log.read(spark).count() == 0
    row = spark.createDataFrame([(1, "a", "ok", ["x", "y"], "2026-01-01 00:00:00", "1.5", "n/a")], "question_id int, user_email string, status string, sources array<string>, event_time string, route_s string, generate_s string")
    log.append(audit.to_chat_log(row))
    log.append(audit.to_chat_log(row))
    r = log.read(spark).first()
    assert log.read(spark).count() == 2 and (r.chunk_ids, r.matched_chunks, r.route_s, r.generate_s, r.error) == ("x,y", 2, 1.5, None, None)
    with pytest.raises(ValueError):
        log.append(row)
    S.register_views(monitor.monitoring_views(log.read(spark)))
    assert spark.table("routing_mix_daily").first().pct_of_day == 100.0


def test_refresh_chunks(spark, tmp_path):
    f = spark.createDataFrame([("F1", "Cafe", "L1", "06:30", "19:30", "Hot.")], "facility_id string, name string, location string, opens string, closes string, notes string")
    p = spark.createDataFrame([("P1", "Parking", "Garage B.")], "doc_id string, title string, content string")
    b = spark.createDataFrame([("ICU", 20, 3, "now")], "unit string, beds_total int, beds_available int, as_of string")
    index = spark.createDataFrame([("policy-P1", "Parking: Garage B."), ("policy-P0", "old"), ("beds-ICU", "ICU unit has 4 of 20 beds available as of then.")], "chunk_id string, content string")
    todo = refresh_chunks(enc(spark, E1), lab(spark), f, p, b, str(tmp_path / "phi"), str(tmp_path / "gen"), {"general": index})["general"]
    assert {tuple(r) for r in todo.collect()} == {("policy-P1", "same"), ("policy-P0", "delete"), ("beds-ICU", "update"), ("facility-F1", "insert")}
    text = {r.chunk_id: r.content for r in spark.read.parquet(str(tmp_path / "gen")).collect()}
    assert text == {"facility-F1": "Cafe (L1): open 06:30 to 19:30. Hot.", "policy-P1": "Parking: Garage B.", "beds-ICU": "ICU unit has 3 of 20 beds available as of now."}


def test_lineage_before_first_and_at_the_edge(spark):
    v = spark.createDataFrame([("e", "1", "2026-01-02 10:00:00"), ("e", "2", "2026-01-02 12:00:00"), ("f", "9", "2026-01-01 00:00:00")], "endpoint string, version string, valid_from string").withColumn("valid_from", F.to_timestamp("valid_from"))
    r = spark.createDataFrame([(1, "e", "2026-01-02 09:59:59"), (2, "e", "2026-01-02 10:00:00"), (3, "e", "2026-01-02 12:00:00"), (4, "e", "2026-03-01 00:00:00"), (5, "f", "2026-01-05 00:00:00"), (6, "g", "2026-01-05 00:00:00")],
                              "id int, endpoint string, event_time string").withColumn("event_time", F.to_timestamp("event_time"))
    assert {x.id: x.version for x in lineage.lineage_asof(r, v).collect()} == {1: None, 2: "1", 3: "2", 4: "2", 5: "9", 6: None}


def test_gathered_children_give_the_same_chunks(spark):
    """One row per parent instead of one per lab: the same texts, with rows that come twice, nulls and labs of several parents."""
    e = enc(spark, E1, E1, ("E2", *E1[1:]), ("E1", "P/9", *E1[2:]), ("E3", "P/2", "Wei Chen", "9", *E1[4:]), ("E4", "P/3", "No Mrn", None, *E1[4:]), (None, "P/1", *E1[2:]))
    x = lab(spark, ("1234567", "E1", "GLU", "1", "N", "2026-10-01T00:00:00Z"), ("1234567", None, "NA", "2", "N", "2026-09-01T00:00:00Z"), ("1234567", None, "NA", "2", "N", "2026-09-01T00:00:00Z"),
            ("1234567", "NOBODY", "CR", "3", "N", "t"), ("1234567", "E2", None, "3", "N", "t"), ("9", "E3", "HGB", "4", None, "t"), (None, None, "WBC", "5", "N", "t"), (None, "E4", "WBC", "5", "N", "t"))
    wide, nested = gold.join_child_to_parent(e, x), gold.join_child_to_parent(e, x, gather=chunks.LAB_FIELDS)
    assert nested.count() == 7 and nested.select(F.sum(F.size("children"))).first()[0] == wide.filter("lab_encounter_id is not null or test_code is not null").count()
    rows = lambda g: sorted((tuple(r) for r in chunks.chunk_parents(g).collect()), key=str)
    assert rows(nested) == rows(wide) and len(rows(nested)) == 5
