"""Configuration, catalog, maintenance, snapshots, readers and streams."""

import random

import pytest
from pyspark.sql import functions as F

from wordloom import config as c
from wordloom.operators import maintain
from wordloom.plans.catalog import AlreadyExists, Catalog, SearchCanceled
from wordloom.sources import datagen, readers, snapshot
from wordloom.streaming import ingest


def test_limits():
    assert [c.multi_term_prefix_limit(x) for x in ("ab", "é", "abcde", "abcdef")] == [50, 50, 40, 30]
    assert [c.fuzzy_limit(x) for x in ("abcd", "éé", "abcdef", "abcdefg")] == [30, 30, 20, 10]


def test_definition_limits():
    for bad in ({"index_fields": []}, {"index_fields": ["a", "a"]}, {"index_fields": ["a b"]}, {"index_fields": ["a"], "weights": {"b": 1}}, {"index_fields": ["a"], "weights": {"a": 1001}}, {"index_fields": ["a"], "result_size": 10_001}, {"index_fields": ["a"] * 33}):
        with pytest.raises(c.InvalidRequest):
            c.IndexConfig.create(**bad)
    assert c.IndexConfig.create(["a"]).result_size == 100
    assert c.normalized_weights(["a", "b"], {"a": 0, "b": 4, "z": 9}) == {"a": 1, "b": 4}


def test_filter_strings():
    assert c.parse_filter("a:1, b:x:y ,a:2", ["a", "b"]) == {"a": ["1", "2"], "b": ["x:y"]}
    for bad in ("z:1", "a", "a:", "a:" + "x" * 257, ",".join(["a:1"] * 65), "a:" + "1," * 2048):
        with pytest.raises(c.InvalidRequest):
            c.parse_filter(bad, ["a"])


def test_knobs_from_env():
    env = {"WORDLOOM_MAX_PREFIX_TERMS": "7", "WORDLOOM_EXACT_MATCH_BOOST": "-1", "WORDLOOM_AI_CATEGORY_THRESHOLD": "x", "WORDLOOM_SKIP_UPDATE_PREFIX": "true"}
    k = c.Knobs.from_env(env=env)
    assert (k.max_prefix_terms, k.exact_match_boost, k.ai_category_threshold, k.skip_update_prefix) == (7, 10, 0.60, True)


def test_catalog_life(spark, tmp_path):
    cat = Catalog(spark)
    idx = cat.create_index("shop", ["name"], filters=["year"], result_size=5)
    with pytest.raises(AlreadyExists):
        cat.create_index("shop", ["name"])
    (tmp_path / "in.csv").write_text("id,name,year\n1,Sunny Rio,2020\n2,Cloudy Day,2021\n")
    (tmp_path / "in.json").write_text('[{"id": "1", "name": "Sunny Rio", "year": "2020"}, {"id": "2", "name": "Cloudy Day", "year": "2021"}]')
    for kind in ("csv", "json"):
        idx.add(readers.read_documents(spark, f"file://{tmp_path}/in.{kind}"))
    ids = lambda q, **how: [r["id"] for r in idx.search(q, **how).collect()]
    assert (ids("sunny"), ids("cloudy"), ids("rio")) == (["1"], ["2"], ["1"])
    idx.upsert('{"document": {"id": "1", "name": "Rainy Rio", "year": "2022"}}')
    assert ids("sunny") == [] and ids("rio", filters="year:2022") == ["1"] and ids("rio", filters="year:2020") == []
    assert idx.delete("2") and not idx.delete("2") and ids("cloudy") == []
    path = f"file://{tmp_path}/snap"
    idx.save(path)
    idx.save(path)
    again = cat.load("copy", path)
    assert [r["id"] for r in again.search("rio").collect()] == ["1"] and again.config == idx.config
    again.compact(f"file://{tmp_path}/compact")
    assert again.stats().first()["documents"] == 1
    with pytest.raises(c.InvalidRequest):
        cat.load("copy", f"file://{tmp_path}/nothing")
    assert cat.get("copy") is again and [x["name"] for x in cat.list_indexes()] == ["copy", "shop"]
    with pytest.raises(c.InvalidRequest):
        idx.save_vectors(path)


def test_vectors_in_an_index(spark, tmp_path):
    idx = Catalog(spark).create_index("v", ["name"])
    idx.add(spark.createDataFrame([("1", "red phone"), ("2", "laptop")], "id string, name string"))
    idx.cluster(spark.createDataFrame([("1", 0, [1.0, 0.0]), ("2", 1, [0.8, 0.2])], "id string, ord int, vector array<double>"))
    got = idx.search("red phone", embedding=[1.0, 0.1]).collect()
    assert [(r["id"], r["ai"]) for r in got] == [("1", False), ("1", True), ("2", True)]
    assert all(not r["ai"] for r in idx.search("phone", embedding=[1.0, 0.1]).collect())
    path = f"file://{tmp_path}/vec"
    idx.save_vectors(path)
    assert snapshot.load_vectors(spark, path)[3]["ai_category_threshold"] == 0.6
    assert snapshot.load_vectors(spark, path + "-none") is None
    assert idx.list_categories().count() == 1


def test_repeated_ids_in_one_upload(spark):
    idx = Catalog(spark).create_index("r", ["name"])
    idx.add(spark.createDataFrame([(1, "old apple"), (2, "pear"), (1, "new apple")], "id int, name string").coalesce(1))
    assert [(r["id"], r["data"]["name"]) for r in idx.search("apple").collect()] == [("1", "new apple")] and not idx.search("old").collect()


def test_documents_are_fetched_where_they_are(spark, tmp_path):
    idx = Catalog(spark).create_index("f", ["name"])
    idx.add(spark.createDataFrame([(i, f"tea {i}") for i in range(50)], "id int, name string"))
    idx.materialize(f"file://{tmp_path}/f")
    plan = idx.search("tea", k=5)._jdf.queryExecution().optimizedPlan().toString()
    # Nothing outer: neither the documents nor a popularity that no document has.
    assert "Join Inner" in plan and "LeftOuter" not in plan
    assert len(idx.search("tea", k=5).collect()) == 5


def test_vector_life(spark, tmp_path):
    class Letters:
        """Embeds by letters; fails on a word."""

        def __call__(self, texts):
            if any("broken" in t for t in texts):
                raise OSError("down")
            return [[float(t.count("a")), float(t.count("o")), float(t.count("e"))] for t in texts]

    cat = Catalog(spark)
    idx = cat.create_index("life", ["name"])
    rows = [("1", "banana mama"), ("2", "papaya mama"), ("3", "bobo moon"), ("4", "broken"), ("5", "xyz")]
    idx.add(spark.createDataFrame(rows, "id string, name string").coalesce(1))
    idx.enable_ai(Letters())
    assert idx.categorize() == {"ok": 3, "failed": 2} and idx.ai_enabled()
    assert (idx.ai_document_count(), idx.category_count()) == (3, 2)
    first = idx.ai_document("1")
    assert first["categories"] == ["cat-1"] and first["norm"] == 5.0 and idx.ai_document("4") is None
    assert [(r["id"], r["ai"]) for r in idx.search("mama papaya").collect() if r["ai"]][0][0] in ("1", "2")
    assert not [r for r in idx.search("broken mama").collect() if r["ai"]]  # the query's embedding fails
    idx.upsert({"document": {"id": "1", "name": "moon bobo"}})
    idx.categorize_document("1")
    again = idx.ai_document("1")
    assert again["categories"] == ["cat-2"] and again["created_at"] == first["created_at"]
    assert {r["name"]: (r["count"], r["centroid"]) for r in idx.list_categories().collect()} == {"cat-1": (1, [5.0, 0.0, 0.0]), "cat-2": (2, [0.0, 8.0, 0.0])}
    with pytest.raises(c.InvalidRequest):
        idx.categorize_document("4")
    idx.save(f"file://{tmp_path}/docs")
    idx.save_vectors(f"file://{tmp_path}/vec")
    back = Catalog(spark, c.Knobs(ai_category_threshold=0.9)).load("life", f"file://{tmp_path}/docs", f"file://{tmp_path}/vec")
    assert back.knobs.ai_category_threshold == 0.6 and back.category_count() == 2
    assert back.remove_document("2") and not back.remove_document("2")
    assert back.category_count() == 1 and back.ai_document_count() == 2
    assert back.delete("3") and back.ai_document_count() == 1
    assert back.filter_fields() == [] and back.stored_document_count() == 4
    assert back.compact(f"file://{tmp_path}/c") == {"stored_before": 4, "stored_after": 4, "active_after": 4, "removed_versions": 0}


def test_query_tokens_are_counted_without_a_job(spark):
    from wordloom.functions.text import count_tokens, tokenize

    texts = ["", "the and", "a b\u2003c", "foo-bar ¼ é́x", "!! the1 x\x1cy", "Ünï\u0085 co"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(tokenize(F.col("t")))).collect()
    assert [count_tokens(t) for t in texts] == [r[0] for r in got]


def test_prefix_refresh_can_be_skipped(spark):
    docs = spark.createDataFrame([("1", "pearl peach")], "id string, name string")
    for skip in (False, True):
        idx = Catalog(spark, c.Knobs(skip_update_prefix=skip)).create_index("p", ["name"])
        idx.add(docs)
        before = idx.tables.prefixes
        assert (idx.refresh_prefixes() is before) == skip


def test_one_document_checks(spark):
    for bad in ({}, {"document": {"name": "x"}}, {"document": {"id": ""}}, {"document": {"id": "1"}, "more": 1}, {"document": {"id": "x" * 257}}):
        with pytest.raises(c.InvalidRequest):
            readers.one_document(spark, bad)


def test_compaction_is_idempotent(spark):
    log = spark.createDataFrame([("1", 1, "a"), ("1", 2, "b"), ("2", 1, "c")], "id string, version int, text string")
    gone = spark.createDataFrame([("2",), ("9",)], "id string")
    live = maintain.compact(log, gone)
    assert [(r["id"], r["text"]) for r in live.collect()] == [("1", "b")]
    assert maintain.compact(live, gone).collect() == live.collect()
    assert maintain.compact_stats(log, live).first().asDict() == {"stored_before": 2, "stored_after": 1, "active_after": 1, "removed_versions": 0}


def test_upsert_and_delete(spark):
    base = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, text string")
    delta = spark.createDataFrame([("2", "c", 1), ("2", "d", 2), ("3", "e", 1)], "id string, text string, version int")
    got = {r["id"]: r["text"] for r in maintain.upsert(base, delta).collect()}
    assert got == {"1": "a", "2": "d", "3": "e"}


def test_word_files(spark, tmp_path):
    words = spark.createDataFrame([("x",), ("y",)], "word string")
    readers.write_words(words, f"file://{tmp_path}/w")
    assert readers.read_words(spark, f"file://{tmp_path}/w").count() == 2
    (tmp_path / "empty.txt").write_text("\n  \n")
    with pytest.raises(c.InvalidRequest):
        readers.read_words(spark, f"file://{tmp_path}/empty.txt")


def test_first_seen_and_pools(spark):
    docs = spark.createDataFrame([(1, "b a2 b"), (2, "c b"), (3, "x x")], "k int, t string")
    got = {r["term"]: (r["ord"], r["pos"]) for r in readers.first_seen_vocabulary(docs, "k", "t").collect()}
    assert got == {"b": (1, 0), "a2": (1, 1), "c": (2, 0), "x": (3, 0)}
    assert {r["id"]: r["tokens"] for r in readers.token_pools(docs, "k", "t").collect()} == {1: ["b", "a2"], 2: ["c", "b"]}


def test_generators(spark):
    rng = random.Random(1)
    assert datagen.misspell("ab", rng) == "ab"
    assert all(abs(len(datagen.misspell("coffee", rng)) - 6) <= 1 for _ in range(50))
    words = datagen.random_vocabulary(100)
    assert len(set(words)) == 100 and all(3 <= len(w) <= 12 for w in words)
    docs = datagen.documents(spark, 200, words).collect()
    assert all(3 <= len(d["title"].split()) <= 20 and 1 <= len(d["tags"]) <= 10 and 2000 <= d["year"] <= 2024 for d in docs)
    pooled = datagen.query_load(words, 400, ["en"], mix="load", pools=[["xx", "yy"], ["zz", "ww"]])
    firsts = [q.split()[:-1] for _, m, q, _ in pooled if m.startswith("multi")]
    assert all(set(q) <= {"xx", "yy"} or set(q) <= {"zz", "ww"} for q in firsts)
    assert {m for _, m, _, _ in datagen.query_load(words, 8, ["en"])} == {"single", "single_filter", "multi", "multi_filter"}


def test_latency_nearest_rank(spark):
    rows = spark.createDataFrame([("m", float(x)) for x in range(1, 11)], "mode string, v double")
    r = maintain.latency_stats(rows, "mode", "v").first()
    assert (r["n"], r["mean"], r["p50"], r["p95"], r["p99"]) == (10, 5.5, 5.0, 10.0, 10.0)
    assert maintain.status_counts(rows, "mode", F.col("v") > 8).first()["errors"] == 2


def test_stream_upserts(spark, tmp_path):
    rows = [("1", 1, "a", False), ("2", 1, "b", False), ("1", 2, "c", False), ("2", 3, None, True)]
    schema = "id string, version int, text string, deleted boolean"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    ingest.upsert_stream(source, f"file://{tmp_path}/log", f"file://{tmp_path}/cp").awaitTermination()
    got = ingest.current(spark.read.parquet(f"file://{tmp_path}/log")).collect()
    assert [(r["id"], r["text"]) for r in got] == [("1", "c")]
    texts = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    q = ingest.live_terms(texts, "text").writeStream.format("memory").queryName("live").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r["term"]: r["n"] for r in spark.table("live").collect()} == {"b": 1, "c": 1}


def test_deadline_and_early_stop(spark):
    idx = Catalog(spark, c.Knobs(single_term_skip_whole_scan=True)).create_index("d", ["name"])
    idx.add(spark.createDataFrame([(str(i), "tea") for i in range(20)], "id string, name string"))
    assert idx.search("tea", k=3).count() == 3
    assert len(idx.search_within(60, "tea", k=2)) == 2
    with pytest.raises(SearchCanceled):
        idx.search_within(0.001, "tea")


def test_load_test(spark, tmp_path):
    from wordloom.operators import index as ix
    from wordloom.plans import load

    words = datagen.random_vocabulary(30)
    docs = datagen.documents(spark, 40, words).withColumn("lang", F.lit("en"))
    cfg = c.IndexConfig.create(["title"], filters=["lang"])
    path = f"file://{tmp_path}/index"
    snapshot.save(ix.build(ix.live_documents(docs, cfg), cfg), path)
    tables = snapshot.load(spark, path)
    asked = datagen.query_load(words, 8, ["en"], mix="load")
    log = load.run_clients(spark, tables, asked, "lang", workers=4).cache()
    got = {r["mode"]: r for r in load.report(log).collect()}
    assert got["overall"]["n"] == 8 and got["overall"]["errors"] == 0 and len(got) == 5
    assert load.run_batch(spark, tables, asked, k=3).select("query_id").distinct().count() <= 4


def test_latency_equals_sorting(spark):
    rng = random.Random(4)
    rows = [(m, rng.choice([1.0, 2.5, rng.expovariate(0.1)])) for m in ("a", "b", None) for _ in range(rng.randint(1, 400))] + [("one", 7.0)]
    got = {r["mode"]: r for r in maintain.latency_stats(spark.createDataFrame(rows, "mode string, v double"), "mode", "v").collect()}
    for m in ("a", "b", None, "one"):
        v = sorted(x for k, x in rows if k == m)
        assert [got[m][f"p{p}"] for p in (50, 95, 99)] == [v[-(-p * len(v) // 100) - 1] for p in (50, 95, 99)]
