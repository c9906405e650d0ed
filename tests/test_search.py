"""Search over small indexes with known results."""

import pytest
from pyspark.sql import functions as F

from wordloom.config import IndexConfig, Knobs
from wordloom.operators import expand
from wordloom.operators import index as ix
from wordloom.operators.search import allowed_ids, any_hits, search, search_batch, to_response, with_data


def tables(spark, rows, schema, fields, weights=None, filters=(), k=10):
    config = IndexConfig.create(fields, weights, filters, k)
    return ix.build(ix.live_documents(spark.createDataFrame(rows, schema), config), config)


def hits(query, t, **how):
    return [(r["id"], r["score"]) for r in search(query, t, **how).orderBy("rank").collect()]


def titles(spark, *texts):
    return tables(spark, [(str(i + 1), x) for i, x in enumerate(texts)], "id string, title string", ["title"])


def test_exact_beats_prefix(spark):
    assert hits("pro", titles(spark, "pro", "project")) == [("1", 1_000_000), ("2", 100_000)]


def test_multi_term_exact_and_prefix(spark):
    assert hits("apple phone", titles(spark, "apple phone", "apple phonecase")) == [("1", 1_000_000), ("2", 550_000)]


def test_fuzzy_takes_the_most_frequent(spark):
    t = titles(spark, "irok", "irop", "iroq", "iros", *["iron"] * 5)
    got = {i for i, _ in hits("irom", t)}
    assert {"5", "6", "7", "8", "9"} <= got


def test_first_match_counts_not_the_sum(spark):
    assert dict(hits("pea", titles(spark, "pearl peach", "peach")))["1"] == 50_000


RANKED = [("1", "Apple presentation", ["slides"], "tech"), ("2", "Appreciate phone", ["phone"], "tech"), ("3", "Apprentice photo book art", ["x"], "art"), ("4", "banana", ["fruit"], "food")]


def test_fuzzy_first_and_prefix_last(spark):
    t = tables(spark, RANKED, "id string, title string, tags array<string>, genre string", ["title", "tags"], filters=["genre"])
    assert hits("appreciat pho", t) == [("2", 99999)]
    assert hits("banan", t, filters={"genre": ["tech"]}) == []
    assert [i for i, _ in hits("banan", t, filters={"genre": ["food", "tech"]})] == ["4"]


def test_duplicate_tokens_are_groups_of_their_own(spark):
    t = titles(spark, "that hat")
    assert hits("that that", t) == [("1", 2 * 500_000)]


def test_empty_group_and_no_tokens(spark):
    t = titles(spark, "apple phone")
    assert hits("zzzzqq phone", t) == hits("the and", t) == hits("", t) == []


def test_ties_go_to_the_lesser_id_and_k_cuts(spark):
    t = titles(spark, *["same"] * 12)
    assert [i for i, _ in hits("same", t, k=3)] == ["1", "10", "11"]
    assert any_hits("same", t, 2).count() == 2


def test_filters_or_and_unknown(spark):
    rows = [("1", "x", "Alice", "rock"), ("2", "x", "Bob", "rock"), ("3", "x", "Eve", "jazz")]
    t = tables(spark, rows, "id string, title string, author string, genre string", ["title"], filters=["author", "genre"])
    ids = lambda spec: sorted(r["id"] for r in allowed_ids(t.filters, spec).collect())
    assert ids({"author": ["Alice", "Bob"], "genre": ["rock"]}) == ["1", "2"]
    assert ids({"author": ["Alice"], "genre": ["jazz"]}) == ids({"author": ["nobody"]}) == ids({"author": []}) == []


def test_numeric_filter_of_whole_doubles(spark):
    t = tables(spark, [("1", "ceramic", 2025.0), ("2", "ceramic", 2024.0)], "id string, title string, year double", ["title"], filters=["year"])
    assert [i for i, _ in hits("ceramic", t, filters={"year": ["2025"]})] == ["1"]


def test_popularity_breaks_ties(spark):
    t = tables(spark, [("1", "coffee", 10), ("2", "coffee", 1000), ("3", "cold brew", 5)], "id string, title string, popularity int", ["title"])
    assert hits("coffee", t) == [("2", 1_001_000), ("1", 1_000_010)]


def test_prefix_order_follows_frequency(spark):
    t = titles(spark, "pearl", "pearl", "pearl", "peach", "peach", "peanut", "pebble", "pesto")
    got = t.prefixes.where("prefix = 'pea'").orderBy("rank").collect()
    assert [r["term"] for r in got] == ["pearl", "peach", "peanut"]
    assert t.prefixes.where("prefix = term").count() == 0


@pytest.mark.parametrize(
    ("words", "query", "cap", "found"),
    [
        ("black block back blacks slack flack", "blacj", 5, {"black"}),
        ("black block back blacks slack flack", "blac", 5, {"black", "back"}),
        ("black block back blacks slack flack", "lack", 5, {"black", "flack", "slack", "back"}),
        ("black block back blacks slack flack", "xyz", 5, set()),
        ("iphone phane phone1", "phone", 5, {"iphone", "phane", "phone1"}),
        ("hello helo hell jello", "hello", 10, {"helo", "hell", "jello"}),
        ("abcd", "bcde", 5, {"abcd"}),
    ],
)
def test_fuzzy_dictionary(spark, words, query, cap, found):
    t = titles(spark, *words.split())
    asked = spark.createDataFrame([(query,)], "token string")
    got = expand.fuzzy_candidates(asked, t.deletes).where(F.col("rank") <= cap)
    assert {r["term"] for r in got.collect()} == found


def test_short_terms_are_not_fuzzy(spark):
    assert titles(spark, "cat dog").deletes.count() == 0


def test_batch_equals_single(spark):
    t = titles(spark, "apple phone", "apple phonecase", "aple pie", "green apple", "phone")
    texts = ["apple", "apple phone", "appl", "gren apple", "zzz"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    got = {(r["query_id"], r["rank"], r["id"], r["score"]) for r in search_batch(queries, t).collect()}
    want = {(i, n + 1, *h) for i, x in enumerate(texts) for n, h in enumerate(hits(x, t))}
    assert got == want


def test_knobs_change_expansion(spark):
    t = titles(spark, "pearl", "peach", "peanut", "pebble")
    assert len(hits("pe", t)) == 3
    assert len(hits("pe", t, knobs=Knobs(single_term_max_prefix_tokens=1))) == 1


def test_data_and_response(spark):
    t = tables(spark, [("1", "tea", "x")], "id string, title string, other string", ["title"])
    rows = with_data(search("tea", t), t)
    assert rows.first()["data"]["other"] == "x"
    assert '"ID":"1"' in to_response(rows, "i", "tea").first()["json"]


def test_plan_prunes_and_shuffles_once_for_both_sums(spark, tmp_path):
    from wordloom.sources import snapshot

    path = f"file://{tmp_path}/index"
    snapshot.save(titles(spark, "apple phone", "apple phonecase"), path)
    t = snapshot.load(spark, path)
    plan = search("apple phone", t)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert "ReadSchema: struct<term:string,id:string,score:bigint>" in plan
