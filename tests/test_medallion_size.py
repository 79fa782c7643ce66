"""What the two loads write is compressed, and holds what it held."""

import os
from datetime import datetime

from wardline.plans import queries
from wardline.streaming import medallion


def test_feeds_and_tables_are_written_compressed(spark, tmp_path):
    t = datetime(2024, 1, 1)
    tables = {"customer": ([(1, "C1", "ICU")], "c_custkey long, c_name string, c_mktsegment string"),
              "orders": ([(k, 1, "F", t, "1-URGENT") for k in (1, 2, 11)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"),
              "lineitem": ([(1, 1, 1, 5.0, "O", t), (2, 1, 4, 5.0, "O", t)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_linestatus string, l_shipdate timestamp"),
              "events": ([(30, t, 1, "view", '{"k": 7}')], "event_id long, ts timestamp, user_id long, event_type string, props string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    at = queries._medallion(spark, str(tmp_path))
    root = at["gold_patient_summary"].rsplit("/out/", 1)[0].removeprefix("file:")
    names = lambda d: [f for _, _, files in os.walk(d) for f in files if f.startswith("part-")]
    assert (fed := names(f"{root}/in")) and all(f.endswith(".txt.gz") for f in fed)
    for table in ("bronze_ehr_fhir", "silver_patient_encounters"):
        assert (kept := names(f"{root}/out/generation=1/{table}")) and any(f.endswith(".zstd.parquet") for f in kept)
    got = {tuple(r) for r in medallion.quality_counts(spark, at).collect()}
    assert {("silver_patient_encounters", "kept", "", 2), ("silver_lab_results", "kept", "", 2)} <= got
