"""Records are read once, and their texts travel once, however many steps follow."""

from pyspark.sql import functions as F

from wardline.operators import grounding, retrieve


def test_counts_read_the_records_once(spark, tmp_path):
    text = "Patient {} (MRN 1), F encounter E{} on t in {}, diagnosis code X."
    rows = [(f"enc-{i}", u, text.format(n, i, u)) for i, (u, n) in enumerate([("ICU", "Jane"), ("ICU", "Jane"), ("ED", "Jane"), ("ED", "Wei"), ("ED", "Kim"), (None, "Kim")])]
    rows += [rows[0], ("enc-9", "ED", None)]
    spark.createDataFrame(rows, "chunk_id string, unit string, content string").write.parquet(f"{tmp_path}/chunks")
    q = spark.createDataFrame([(1, "how many?", True, []), (2, "how many in the icu?", True, []), (3, "how many?", False, ["ED"]), (4, "how many in icu?", False, ["ED"]), (5, "how many?", False, [])],
                              "question_id int, question string, sees_all boolean, units array<string>")
    out = retrieve.count_entities(q, spark.read.parquet(f"{tmp_path}/chunks"))
    assert not out.inputFiles()
    assert sorted(tuple(r) for r in out.collect()) == [(1, None, 3, 7), (2, "ICU", 1, 3), (3, None, 3, 3), (4, None, 3, 3), (5, None, 0, 0)]


def test_records_without_markdown_are_shown_as_they_are(spark):
    a = spark.createDataFrame([(1, "It is 5."), (2, "It is 6."), (3, "It is 7."), (3, "None.")], "question_id int, answer string")
    r = spark.createDataFrame([(1, ["5 here"]), (2, ["5 here", "4"])], "question_id int, records array<string>")
    rows = lambda x: sorted(tuple(map(str, y)) for y in grounding.check_grounded(a, x).collect())
    got = rows(r)
    assert got == rows(r.withColumn("markdown", F.col("records"))) and got[0][2:] == ("[]", "It is 5.") and got[1][3].endswith("5 here\n\n4")
