"""Records are normalised once for all facts of an answer, and encounters are counted before labs hang on them."""

import random
import re

from pyspark.sql import functions as F

from wardline import fixed
from wardline.functions import text as X
from wardline.operators import chunks, gold


def test_records_are_not_normalised_for_each_fact(spark):
    d = spark.createDataFrame([("a1", "a1")], "a string, r string").select(X.unsupported_facts(F.col("a"), F.col("r")).alias("x"))
    plan = d._jdf.queryExecution().analyzed().toString()
    assert "btrim(r" in plan and "btrim(r" not in plan[plan.index("lambdafunction("):]


def test_missing_facts_as_by_the_rule(spark):
    rng = random.Random(5)
    bits = ["0", "00", "5", "05", "a", "Σ", "σ", "ς", "'", ".", ":", " ", "-", "(", ")", "é", "10", "٣"]
    word = lambda n: "".join(rng.choices(bits, k=rng.randint(0, n)))
    rows = [(i, word(9), None if i % 50 == 0 else word(25)) for i in range(1500)] + [(1500, "5ΑΣ 5ας", "x 5ΑΣ'α"), (1501, None, "5"), (1502, "0:00", "T00:00:00Z")]
    d = spark.createDataFrame(rows, "i int, a string, r string")
    # as written before: the tokens and the text of the records worked out for every fact
    lowered = lambda c: F.regexp_replace(F.lower(F.btrim(c, F.lit(fixed.EDGE_PUNCTUATION))), r"(?dU)(?<!\d)0+(?=\d)", "")
    tokens = F.transform(X.facts(F.col("r")), lowered)
    bad = F.filter(X.facts(F.col("a")), lambda t: (lowered(t) != "") & ~F.array_contains(tokens, lowered(t)) & ~F.contains(lowered(F.col("r")), lowered(t)))
    want = F.array_sort(F.array_distinct(F.transform(bad, lambda t: F.btrim(t, F.lit(fixed.LISTED_PUNCTUATION)))))
    got = d.select("i", X.unsupported_facts(F.col("a"), F.col("r")).alias("x"), want.alias("y")).collect()
    assert [r for r in got if r.x != r.y] == [] and sum(bool(r.x) for r in got) > 100 and sum(bool(r.a and re.search(r"\d", r.a)) for r in d.collect()) > 500


def test_counted_encounters_give_the_same_texts(spark):
    e = [(f"E{i % 7}" if i % 11 else None, f"M{i % 5}" if i % 13 else None, "ICU" if i % 3 else None, "Ann", "F", "2026", "X") for i in range(40)]
    lab = [(f"M{i % 6}" if i % 9 else None, f"E{i % 8}" if i % 4 else None, f"2026-0{i % 3}" if i % 10 else None, "GLU" if i % 7 else None, str(i % 4), "N") for i in range(90)]
    ed = spark.createDataFrame(e + e[:15], "encounter_id string, mrn string, unit string, patient_name string, encounter_class string, period_start string, diagnosis_code string")
    ld = spark.createDataFrame(lab, "mrn string, lab_encounter_id string, observed_at string, test_code string, result_value string, result_flag string")
    rows = lambda x: sorted(tuple(map(str, r)) for r in x.collect())
    counted = chunks.chunk_parents(gold.join_child_to_parent(chunks.distinct_parents(ed), ld, gather=chunks.LAB_FIELDS))
    assert rows(counted) == rows(chunks.chunk_parents(gold.join_child_to_parent(ed, ld))) and len(rows(counted)) == len({tuple(r) for r in e})
