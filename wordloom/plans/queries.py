"""The registered queries: each operator applied to the bundled tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.config import IndexConfig, Knobs
from wordloom.functions import text as fn
from wordloom.functions import vector as vf
from wordloom.operators import expand, maintain, vectors
from wordloom.operators import index as ix
from wordloom.operators.search import any_hits, search, search_batch, to_response, with_data
from wordloom.sources import datagen, readers, snapshot
from wordloom.sources.snapshot import shared_folder

DOCS = IndexConfig.create(["text"], filters=["lang", "source"], id_field="doc_id")
PARTS = IndexConfig.create(["p_name", "p_type", "p_brand"], {"p_name": 3}, ["p_size", "p_brand"], id_field="p_partkey", popularity_field="p_retailprice")
TALKS = IndexConfig.create(["text"], filters=["role"], id_field="conv_id")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_BUILT: dict[tuple[str, str, str], ix.Tables] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return readers.spread(df) if name in ("documents", "pages", "part") else df


def _index(spark: SparkSession, sf_dir: str, name: str, config: IndexConfig, docs: Callable[[], DataFrame] | None = None) -> ix.Tables:
    """The index of a table, written once for a session and read by each query."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        raw = docs() if docs else _read(spark, sf_dir, name)
        path = f"{shared_folder(spark)}/{name}"
        snapshot.save(ix.build(ix.live_documents(raw, config, distinct=True), config), path)
        _BUILT[key] = snapshot.load(spark, path)
    return _BUILT[key]


def documents_index(spark: SparkSession, sf_dir: str) -> ix.Tables:
    return _index(spark, sf_dir, "documents", DOCS)


def parts_index(spark: SparkSession, sf_dir: str) -> ix.Tables:
    return _index(spark, sf_dir, "part", PARTS)


def talks_index(spark: SparkSession, sf_dir: str) -> ix.Tables:
    def docs() -> DataFrame:
        turns = _read(spark, sf_dir, "conversations")
        return turns.groupBy("conv_id").agg(F.collect_set("role").alias("role"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).select("conv_id", "role", F.col("t.text").alias("text"))

    return _index(spark, sf_dir, "talks", TALKS, docs)


def _lazy(spark: SparkSession, sf_dir: str) -> ix.Tables:
    return ix.build(ix.live_documents(_read(spark, sf_dir, "documents"), DOCS, distinct=True), DOCS)


@query
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _read(spark, sf_dir, "documents").select("doc_id", F.explode(fn.tokenize(F.col("text"))).alias("term"))
    return each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query
def tokenize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.size(fn.tokenize(F.col("html"))).cast("bigint").alias("n_tokens"), F.md5(F.array_join(fn.tokenize(F.col("html")), " ")).alias("tokens_md5"))


@query
def stopword_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = fn.tokenize(F.col("text"))
    words = F.array_remove(F.split("text", f"[{fn.WHITE}]+"), "")
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("bigint").alias("n_words"), F.size(tokens).cast("bigint").alias("n_tokens"))


@query
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ix.live_documents(_read(spark, sf_dir, "part"), PARTS, distinct=True)
    return ix.postings(docs, PARTS).select("id", "term", "score")


@query
def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lazy(spark, sf_dir).postings


@query
def vocab_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lazy(spark, sf_dir).vocabulary


@query
def prefix_table_top64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lazy(spark, sf_dir).prefixes


@query
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).prefixes.where(F.col("prefix") == "tha").select("rank", "term", "df")


@query
def delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lazy(spark, sf_dir).deletes.groupBy("term").agg(F.count("*").alias("n_keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query
def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in ("tihng", "thqle", "thatt", "for", "enre")], "token string")
    return expand.fuzzy_candidates(words, documents_index(spark, sf_dir).deletes).where("rank <= 30")


#: Search queries over documents: (text, result size, filters).
SEARCHES: dict[str, tuple[str, int, dict[str, list[str]] | None]] = {
    "search_single_exact": ("for", 20, None),
    "search_single_exact_prefix": ("eren", 500, None),
    "search_single_prefix": ("tha", 50, None),
    "search_single_fuzzy": ("tihng", 50, None),
    "search_single_miss": ("zzzzqqxx", 50, None),
    "search_multi_exact": ("that with", 40, None),
    "search_multi_prefix_last": ("of tio", 60, None),
    "search_multi_fuzzy_first": ("tihng that", 60, None),
    "search_multi_dup_token": ("that that", 40, None),
    "search_multi_three": ("la que de", 60, None),
    "search_empty_group": ("zzzzqq that", 40, None),
    "search_no_tokens": ("the and !!", 40, None),
    "filter_eq": ("that", 60, {"lang": ["en"]}),
    "filter_or": ("que", 60, {"lang": ["fr", "es"]}),
    "filter_and": ("that with", 60, {"lang": ["en"], "source": ["src0", "src3"]}),
    "filter_unknown": ("that", 60, {"lang": ["xx"]}),
    "filter_empty_values": ("that", 60, {"lang": []}),
}


def _search_query(name: str, text: str, k: int, spec: dict[str, list[str]] | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(text, documents_index(spark, sf_dir), k=k, filters=spec)

    QUERIES[name] = run


for _name, _args in SEARCHES.items():
    _search_query(_name, *_args)

#: Search queries over parts, whose popularity is the price, and over talks.
PART_SEARCHES = {
    "popularity_single": ("small", 100, None),
    "popularity_multi": ("small red", 100, None),
    "filter_numeric": ("small", 100, {"p_size": ["7", "9"]}),
}


def _part_query(name: str, text: str, k: int, spec: dict[str, list[str]] | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(text, parts_index(spark, sf_dir), k=k, filters=spec)

    QUERIES[name] = run


for _name, _args in PART_SEARCHES.items():
    _part_query(_name, *_args)


@query
def filter_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search("that", talks_index(spark, sf_dir), k=100, filters={"role": ["assistant", "system"]})


def batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokens of every benchmark text: its first and, cut short, its last."""
    rows = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), fn.tokenize(F.col("text")).alias("t")).where(F.size("t") >= 2)
    last = F.element_at("t", -1)
    cut = F.substring(last, F.lit(1), F.greatest(F.length(last) - 1, F.lit(1)))
    return rows.select("query_id", F.concat_ws(" ", F.element_at("t", 1), cut).alias("query"))


@query
def search_batch_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_batch(batch_queries(spark, sf_dir), documents_index(spark, sf_dir), k=10)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version log: every document, and newer versions of every third."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", "text", "lang")
    newer = docs.where("doc_id % 3 = 0").select("id", "doc_id", F.concat(F.lit("update "), F.col("text")).alias("text"), F.lit("xx").alias("lang"))
    return docs.withColumn("version", F.lit(1).cast("bigint")).unionByName(newer.withColumn("version", F.lit(2).cast("bigint")))


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").cast("string").alias("id"))


@query
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.latest(_log(spark, sf_dir), "version").select("id", "version", "lang", F.length("text").cast("bigint").alias("n_chars"))


@query
def delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.delete(_log(spark, sf_dir), _gone(spark, sf_dir)).groupBy("lang").agg(F.count("*").alias("n"))


@query
def compact_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return maintain.compact_stats(log, maintain.compact(log, _gone(spark, sf_dir)))


@query
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.index_stats(documents_index(spark, sf_dir))


@query
def batch_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings by term of the documents added in three parts."""
    docs = ix.live_documents(_read(spark, sf_dir, "documents"), DOCS, distinct=True)
    part = lambda i: docs.where(F.pmod("doc_id", F.lit(3)) == i)
    whole = maintain.upsert(maintain.upsert(part(0), part(1)), part(2))
    return ix.term_totals(whole, DOCS)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("name"), F.col("embedding").alias("vector"), F.col("vec_id").alias("ord"))


#: A fixed query vector: the first ten axes.
PROBE = [1.0 if i < 10 else 0.0 for i in range(64)]


@query
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cosine_topk(_vectors(spark, sf_dir).select("id", "vector"), PROBE, 25)


@query
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = F.col("vector"), vectors.literal_vector(PROBE)
    return _vectors(spark, sf_dir).select("id", F.round(vf.dot(v, q), 6).alias("dot"), F.round(vf.norm(v), 6).alias("norm"), vf.similarity_score(F.round(vf.cosine(v, q), 9)).alias("score"))


@query
def centroid_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.centroids(_vectors(spark, sf_dir)).select("name", "pos", F.round("total", 6).alias("total"), "n")


@query
def category_probe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return vectors.probe_topk(rows, vectors.categories(rows), PROBE, 25)


@query
def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    allowed = rows.where("name in ('c1', 'c2')").select("id")
    return vectors.cosine_topk(rows.select("id", "vector"), PROBE, 25, allowed)


@query
def hybrid_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    classic = search("that with", documents_index(spark, sf_dir), k=10)
    return vectors.hybrid(classic, vectors.cosine_topk(_vectors(spark, sf_dir).select("id", "vector"), PROBE, 10))


@query
def cluster_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cluster_incremental(_vectors(spark, sf_dir), Knobs()).select("id", F.array_join("categories", ",").alias("categories"))


@query
def zero_vectors_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustering skips and counts vectors without a direction."""
    rows = _vectors(spark, sf_dir).select("id", "ord", F.when(F.pmod("ord", F.lit(10)) == 0, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector")).alias("vector"))
    return vectors.embedding_counts(rows)


@query
def centroid_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category sums after every third vector is removed."""
    rows = _vectors(spark, sf_dir)
    gone = rows.where("ord % 3 = 0")
    left = vectors.subtract(vectors.centroids(rows), vectors.centroids(gone))
    return left.select("name", "pos", F.round("total", 6).alias("total"), "n")


@query
def vector_state_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved vectors, members and categories, read again: members and size of each category."""
    rows, path = _vectors(spark, sf_dir), f"{shared_folder(spark)}/vectors"
    snapshot.save_vectors(rows.select("id", "ord", "vector"), rows.select("id", "name", "vector"), vectors.categories(rows), path, {"ai_category_threshold": 0.6})
    _, members, cats, knobs = snapshot.load_vectors(spark, path)
    n = members.groupBy("name").agg(F.count("*").alias("members"))
    return cats.join(n, "name").select("name", "members", "count", F.round("norm", 6).alias("norm"), F.lit(knobs["ai_category_threshold"]).alias("threshold"))


@query
def embed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "part")
    return docs.select("p_partkey", fn.embed_content(docs, ("p_name", "p_size", "p_brand")).alias("content"))


@query
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/roundtrip"
    snapshot.save(ix.build(ix.live_documents(_read(spark, sf_dir, "part"), PARTS, distinct=True), PARTS), path)
    return snapshot.load(spark, path).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("score").alias("score"))


@query
def json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/parts-json"
    _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name", "p_size").write.json(path)
    docs = readers.read_json_lines(spark, path)
    return docs.select("id", "p_name", docs["p_size"].cast("bigint").alias("p_size"))


@query
def json_array_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold an array of objects each, as bulk uploads do."""
    path = f"{shared_folder(spark)}/parts-array"
    rows = _read(spark, sf_dir, "part").select(F.to_json(F.struct(F.col("p_partkey").alias("id"), "p_name", "p_size")).alias("j"), F.pmod("p_partkey", F.lit(4)).alias("k"))
    rows.groupBy("k").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).write.partitionBy("k").text(path)
    docs = ix.live_documents(readers.read_documents(spark, path), IndexConfig.create(["p_name"]))
    return docs.select("id", "p_name", docs["p_size"].cast("bigint").alias("p_size"))


@query
def single_document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after one part is replaced and one added, each by a request."""
    base = ix.live_documents(_read(spark, sf_dir, "part"), PARTS, distinct=True).select("id", "p_name")
    for key in ("1", "new"):
        one = readers.one_document(spark, {"document": {"id": key, "p_name": f"upserted {key}"}})
        base = maintain.upsert(base, ix.live_documents(one, IndexConfig.create(["p_name"])))
    return base.select("id", "p_name")


@query
def bulk_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of repeated ids in one upload the last row read counts."""
    rows = _read(spark, sf_dir, "documents").orderBy("doc_id").select((F.col("doc_id") % 100).alias("id"), "doc_id", "lang")
    return ix.live_documents(rows, IndexConfig.create(["lang"])).select("id", "doc_id", "lang")


@query
def search_with_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best parts with their documents."""
    tables = parts_index(spark, sf_dir)
    return with_data(search("small red", tables, k=20), tables).select("rank", "id", "score", F.col("data.p_name").alias("p_name"), F.col("data.p_size").alias("p_size"), "ai")


@query
def search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer as one JSON text, read again."""
    tables = parts_index(spark, sf_dir)
    answer = to_response(with_data(search("small red", tables, k=20), tables), "parts", "small red")
    kind = "status string, statusCode int, index string, query string, response struct<Docs: array<struct<ID: string, Data: struct<p_name: string>, Score: long, AI: boolean>>>"
    r = answer.select(F.from_json("json", kind).alias("r"))
    return r.select("r.status", "r.statusCode", "r.index", "r.query", F.posexplode("r.response.Docs").alias("at", "d")).select("status", "statusCode", "index", "query", "at", F.col("d.ID").alias("id"), F.col("d.Data.p_name").alias("p_name"), F.col("d.Score").alias("score"), F.col("d.AI").alias("ai"))


@query
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some five matching documents: how many, and how many of them match."""
    tables = documents_index(spark, sf_dir)
    some = any_hits("that", tables, 5)
    match = tables.postings.where("term = 'that'").select("id").distinct()
    return some.agg(F.count("*").alias("n")).crossJoin(some.join(match, "id", "left_semi").agg(F.count("*").alias("n_match")))


@query
def deleted_never_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search after every seventh document is deleted."""
    docs = maintain.delete(ix.live_documents(_read(spark, sf_dir, "documents"), DOCS, distinct=True), _gone(spark, sf_dir))
    return search("that with", snapshot.staged(ix.build(docs, DOCS)), k=30)


@query
def word_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands written as a word file and read again."""
    path = f"{shared_folder(spark)}/words"
    readers.write_words(_read(spark, sf_dir, "part").select(F.col("p_brand").alias("word")).distinct(), path)
    return readers.read_words(spark, path)


@query
def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/parts-csv"
    _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size").write.option("header", True).csv(path)
    return readers.read_csv(spark, path).select("id", "p_name", "p_size")


@query
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = maintain.latency_stats(_read(spark, sf_dir, "events"), "event_type", "value")
    return out.withColumn("mean", F.round("mean", 6))


@query
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.status_counts(_read(spark, sf_dir, "events"), "event_type", F.col("value") > 100)


@query
def vocab_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.first_seen_vocabulary(_read(spark, sf_dir, "documents"), "doc_id", "text").select("term", "ord", F.col("pos").cast("bigint").alias("pos"))


@query
def doc_token_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = readers.token_pools(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return pools.select("id", F.size("tokens").cast("bigint").alias("n_tokens"), F.element_at("tokens", 1).alias("first_token"))


@query
def query_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datagen.query_load(datagen.random_vocabulary(500), 1000, ["en", "fr", "de", "es"])
    return spark.createDataFrame(rows, "query_id long, mode string, query string, filter string")


@query
def datagen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datagen.documents(spark, 2000, datagen.random_vocabulary(300)).select("id", "title", F.size("tags").alias("n_tags"), "year")


@query
def live_terms_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document counts by language from a stream of version batches read to its end."""
    from wordloom.streaming.ingest import current, upsert_stream

    root = shared_folder(spark)
    _log(spark, sf_dir).write.parquet(f"{root}/in")
    log = spark.read.parquet(f"{root}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    upsert_stream(stream, f"{root}/log", f"{root}/offsets").awaitTermination()
    return current(spark.read.parquet(f"{root}/log").drop("batch")).groupBy("lang").agg(F.count("*").alias("n"))


@query
def rank_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents of each of the hundred most frequent terms."""
    tables = documents_index(spark, sf_dir)
    top = tables.vocabulary.orderBy(F.desc("df"), "term").limit(100)
    w = Window.partitionBy("term").orderBy(F.desc("score"), "id")
    return tables.postings.join(F.broadcast(top.select("term")), "term").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("term", "rank", "id", "score")
