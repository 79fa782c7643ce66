"""Records are matched once; odd texts give what a match per group gives."""

from pyspark.sql import functions as F
from wardline import fixed
from wardline.functions import parse as P

RECORDS = [
    "Patient A B (MRN 8000001), O encounter ENC-1 on 1996-01-02T00:00:00Z in ICU, diagnosis code 5-LOW.",
    "Patient A (MRN 8), O encounter ENC-1 on x in ICU, diagnosis code D. Labs: glucose (GLU) = 17 (flag O) at 1996; a = 1 (flag N) at t.",
    "Patient A (MRN 8), O encounter ENC-1 on x in ICU, diagnosis code D. Labs: glucose = 17 (flag O) at 1996; odd.",
    "Patient A\x01 (MRN 8), O encounter ENC-1 on x in ICU, diagnosis code D. Labs: a\x01b = 1 (flag N) at t.",
    "Patient A (MRN 8), O encounter ENC-1 on x in ICU, diagnosis code D.\n",
    "Patient $1 (MRN \\2), O encounter ENC-1 on x in ICU, diagnosis code D. Labs: $3 = \\ (flag O) at z.",
    "a\x01b\x01c\x01d\x01e\x01f\x01g\x01h\x01", "other", "", None]


def test_fields_of_one_match(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(RECORDS)], "i int, content string")
    rx = "(?dU)" + fixed.RECORD_PATTERN
    got = P.parse_record_text(df)
    ok = F.col("content").rlike(rx)
    each = [F.when(ok, F.regexp_extract("content", rx, i)).alias(f"g{i}") for i in range(1, 8)]
    want = {tuple(x) for x in df.select("i", F.coalesce(ok, F.lit(False)), *each).collect()}
    assert {tuple(x) for x in got.select("i", "parsed", "patient_name", "mrn", "encounter_class", "encounter_id", "period_start", "unit", "diagnosis_code").collect()} == want
    labs = {r.i: None if r.labs is None else [tuple(x) for x in r.labs] for r in got.select("i", "labs").collect()}
    assert labs[1] == [("glucose (GLU)", "17", "O", "1996"), ("a", "1", "N", "t")] and labs[2] is None
    assert labs[3] == [("a\x01b", "1", "N", "t")] and labs[5] == [("$3", "\\", "O", "z")] and labs[0] is None


def test_one_match_per_record_in_the_plan(spark):
    df = spark.createDataFrame([("x",)], "content string").filter("content <> ''")
    plan = P.parse_record_text(df).select("patient_name", "mrn", "unit")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
