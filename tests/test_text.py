"""Tokenizing, scores, prefixes, delete keys and filter values."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.config import IndexConfig
from wordloom.functions import text as fn
from wordloom.operators import index as ix


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("hello, world! foo-bar co.uk", ["hello", "world", "foobar", "couk"]),
        ("a the and coffee", ["coffee"]),
        ("café naïve", ["café", "naïve"]),
        ("日本語 音楽", ["日本語", "音楽"]),
        ("İSTANBUL", ["istanbul"]),
        ("ΣΟΦΟΣ", ["σοφοσ"]),
        ("hello👋 café—latte song٤٢", ["hello", "cafélatte", "song٤٢"]),
        ("  \t\n 　x y ", ["x", "y"]),
        ("A.N.D t-h-e", []),
        ("", []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert spark.range(1).select(fn.tokenize(F.lit(text)).alias("t")).first()["t"] == tokens


def test_prefixes_and_delete_keys(spark):
    row = spark.range(1).select(fn.proper_prefixes(F.lit("añb")).alias("p"), fn.proper_prefixes(F.lit("x")).alias("q"), fn.delete_keys(F.lit("aab")).alias("d"), fn.query_keys(F.lit("ab")).alias("k"), fn.query_keys(F.lit("a")).alias("one")).first()
    assert row["p"] == ["a", "añ"] and row["q"] == []
    assert sorted(row["d"]) == ["aa", "aab", "ab"]
    assert row["k"] == ["ab", "b", "a"] and row["one"] == ["a"]


def test_weighted_scores_and_floor(spark):
    docs = spark.createDataFrame([("1", "apple phone", "apple"), ("2", "", None)], "id string, title string, body string")
    config = IndexConfig.create(["title", "body"], {"title": 3})
    got = {r["term"]: r["score"] for r in ix.postings(docs, config).collect()}
    assert got == {"apple": 300000 // 7 + 100000 // 7, "phone": 300000 // 7}
    long = spark.range(1).select(F.lit("1").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(100_001)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("body"))
    assert ix.postings(long, IndexConfig.create(["body"])).agg(F.min("score")).first()[0] == 1


def test_array_fields_and_other_kinds(spark):
    docs = spark.createDataFrame([("1", ["Red Cup", None], 5)], "id string, tags array<string>, n int")
    got = {r["term"] for r in ix.postings(docs, IndexConfig.create(["tags", "n"])).collect()}
    assert got == {"red", "cup"}


def test_filter_values(spark):
    df = spark.createDataFrame([(2025.0, 2024, "", ["x", "", None], True, [["a"], ["b"]])], "d double, i int, s string, a array<string>, b boolean, n array<array<string>>")
    keys = {f.name: fn.filter_values(df[f.name], f.dataType) for f in df.schema.fields}
    assert keys.pop("b") is None
    row = df.select(*(c.alias(n) for n, c in keys.items())).first()
    assert row.asDict() == {"d": ["2025"], "i": ["2024"], "s": [], "a": ["x"], "n": ["a", "b"]}


def test_popularity_and_content(spark):
    df = spark.createDataFrame([("x", 3.9, ["a", "b"], -4), (None, None, None, None)], "s string, d double, a array<string>, n int")
    assert [r[0] for r in df.select(fn.popularity(df, "d")).collect()] == [3, 0]
    assert [r[0] for r in df.select(fn.popularity(df, "n")).collect()] == [0, 0]
    assert [r[0] for r in df.select(fn.popularity(df, "s")).collect()] == [0, 0]
    assert [r[0] for r in df.select(fn.embed_content(df, ("s", "d", "a"))).collect()] == ["x 3.9 [a b]", ""]


def test_live_documents_skip_bad_ids(spark):
    df = spark.createDataFrame([("1",), ("",), ("<nil>",), (None,)], T.StructType([T.StructField("id", T.StringType())]))
    assert [r["id"] for r in ix.live_documents(df, IndexConfig.create(["id"])).collect()] == ["1"]
