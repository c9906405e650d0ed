"""How often patterns run over a text and how the scan's rows are dealt over tasks."""

import pyarrow as pa
import pyarrow.parquet as pq

from wordloom.llm import entries, secret_scan


def test_a_pattern_is_matched_once(spark):
    df = spark.createDataFrame([("x",)], "text string")
    plan = secret_scan.find_secrets(df)._jdf.queryExecution().optimizedPlan().toString()
    # One for each kind, one for the values of assignments; the last cuts texts in pieces.
    for pattern, most in ((secret_scan.ASSIGN, 2), (secret_scan.ACCESS_LONG, 1), (secret_scan.HEX_LONG, 1), (secret_scan.RUN, 1)):
        found = plan.split("regexp_extract_all(")[1:]
        assert sum(f", {pattern}, " in f[: len(pattern) + 60] for f in found) == most


def test_scan_keeps_all_cores_busy(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": range(400), "text": [f"token = abc{i}def{i}" for i in range(400)]}), tmp_path / "documents.parquet")
    for name in ("op2_secret_scan", "secret_scan_planted"):
        out = entries.QUERIES[name](spark, f"file://{tmp_path}")
        assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert [r["n_assign"] for r in out.collect()] == [1] * 400
