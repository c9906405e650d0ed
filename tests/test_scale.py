"""How often texts are tokenized and how rows are dealt over tasks."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF
from pyspark.sql import functions as F

from wordloom.functions import text as fn
from wordloom.operators import index as ix
from wordloom.plans import queries
from wordloom.sources import readers, snapshot


def scans(df):
    """How often a plan tokenizes."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")


@pytest.fixture
def docs(spark):
    rows = [(str(i), " ".join(f"w{j % (i + 1)}" for j in range(20))) for i in range(40)]
    return spark.createDataFrame(rows + [("none", None), ("blank", " ")], "id string, text string").repartition(4)


def config():
    return ix.IndexConfig.create(["text"])


def test_postings_tokenize_once(docs):
    assert scans(ix.postings(docs, config())) == 1


def test_saved_tables_stay_in_their_tasks(spark, docs, tmp_path, monkeypatch):
    def refuse(*_):
        raise AssertionError("rows are dealt by range")

    monkeypatch.setattr(type(docs), "repartitionByRange", refuse)
    tables = ix.build(docs, config())
    snapshot.save(tables, f"file://{tmp_path}/at")
    files = [pq.read_table(f).to_pylist() for f in sorted((tmp_path / "at/postings").glob("*.parquet"))]
    assert sum(bool(f) for f in files) == 4
    for rows in files:
        assert rows == sorted(rows, key=lambda r: (r["term"], r["id"]))
    got = snapshot.load(spark, f"file://{tmp_path}/at")
    for name in ("postings", "vocabulary", "prefixes", "deletes"):
        assert sorted(getattr(got, name).collect()) == sorted(getattr(tables, name).collect())


def test_few_row_groups_keep_all_cores_busy(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": range(8000), "text": [f"text {i} {i * i}" for i in range(8000)]}), tmp_path / "t.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = spark.read.parquet(f"file://{tmp_path}/t.parquet")
        assert df.rdd.getNumPartitions() > 1
        rows = readers.spread(df).rdd.glom().map(len).collect()
        assert sum(rows) == 8000 and max(rows) <= 1.5 * 8000 / spark.sparkContext.defaultParallelism
        even = df.repartition(16)
        assert readers.spread(even) is even
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parts_are_read_by_all_cores(spark):
    assert queries._read(spark, SF, "part").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_search_after_deletes_tokenizes_no_more(spark):
    assert scans(queries.deleted_never_found(spark, SF)) == 0


def test_added_parts_tokenize_once(spark):
    assert scans(queries.batch_equivalence(spark, SF)) == 1


def test_added_parts_make_no_postings(spark):
    plan = queries.batch_equivalence(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and not re.search("zip_with|lambda", plan)


def test_totals_are_those_of_postings(spark, docs):
    two = ix.IndexConfig.create(["text", "tags"], {"tags": 3})
    tags = F.when(F.length("id") == 1, F.array(F.lit("w1 x"), F.lit("x"), F.lit(None)))
    for df, c in ((docs, config()), (docs.withColumn("tags", tags), two)):
        sums = ix.postings(df, c).groupBy("term").agg(F.count("*").alias("df"), F.sum("score").alias("score"))
        got = ix.term_totals(df, c)
        assert got.dtypes == sums.dtypes and sorted(got.collect()) == sorted(sums.collect())


def test_tokens_of_every_character(spark):
    """Each character within a word, alone, and at an end, as Python tells its class."""
    points = [*range(0x250), 0x1680, *range(0x2000, 0x2030), 0x205F, 0x3000, 0x4E00, 0x1F600]
    rows = [(i, f"x{chr(i)}y {chr(i)} Z{chr(i)}") for i in points]
    df = spark.createDataFrame(rows, "i int, text string")
    got = {r["i"]: r["n"] for r in df.select("i", F.size(fn.tokenize(F.col("text"))).alias("n")).collect()}
    assert got == {i: fn.count_tokens(text) for i, text in rows}


def test_vocabulary_makes_no_scores(spark):
    for df in (queries.vocab_df(spark, SF), queries.delete_keys(spark, SF)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert scans(df) == 1 and not re.search("zip_with|100000", plan)


def test_token_pools_tokenize_once(spark):
    assert scans(queries.doc_token_pools(spark, SF)) == 1
