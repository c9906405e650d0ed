"""The index facade and the registry of indexes."""

from __future__ import annotations

import logging
import threading
import uuid
from dataclasses import asdict, replace
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.config import MAX_NAME, IndexConfig, InvalidRequest, Knobs, check_identifier, check_query, parse_filter
from wordloom.functions import text as fn
from wordloom.functions import vector as vf
from wordloom.functions.text import count_tokens
from wordloom.operators import index as ix
from wordloom.operators import maintain, search, vectors
from wordloom.sources import readers, snapshot


class AlreadyExists(InvalidRequest):
    """An index of that name exists."""


class SearchCanceled(RuntimeError):
    """A search ran out of time."""


class Index:
    """Documents with a definition, searched through their derived tables.

    Changes give new document tables; the derived tables follow lazily, so the
    state is always that of a compacted index.  ``materialize`` or ``save``
    writes them for repeated use.
    """

    def __init__(self, spark: SparkSession, config: IndexConfig, knobs: Knobs = Knobs()):
        self.spark, self.config, self.knobs = spark, config, knobs
        self.docs: DataFrame | None = None
        self._tables: ix.Tables | None = None
        self.vectors: DataFrame | None = None
        self.members: DataFrame | None = None
        self.categories: DataFrame | None = None
        self.embedder: Callable | None = None

    @property
    def tables(self) -> ix.Tables:
        if self.docs is None:
            raise InvalidRequest("the index has no documents")
        if self._tables is None:
            self._tables = ix.build(self.docs, self.config, self.knobs)
        return self._tables

    def _set(self, docs: DataFrame) -> None:
        self.docs, self._tables = docs, None

    def add(self, docs: DataFrame, version: str | None = None) -> None:
        """Bulk upsert; documents without an id are skipped."""
        fresh = ix.live_documents(docs, self.config, version)
        self._set(fresh if self.docs is None else maintain.upsert(self.docs, fresh))

    def upsert(self, body: str | Mapping[str, Any]) -> None:
        """One document, as in ``readers.one_document``."""
        self.add(readers.one_document(self.spark, body))

    def delete(self, key: str) -> bool:
        """Remove a document and its vector; false if it is unknown."""
        if self.docs is None or not self.docs.where(F.col("id") == key).take(1):
            return False
        self._set(self.docs.where(F.col("id") != key))
        self.remove_document(key)
        return True

    def _spec(self, filters: str | Mapping[str, Sequence[str]] | None) -> Mapping[str, Sequence[str]] | None:
        return parse_filter(filters, self.config.filters) if isinstance(filters, str) else filters

    def search(self, query: str, filters: str | Mapping[str, Sequence[str]] | None = None, k: int | None = None, embedding: Sequence[float] | None = None) -> DataFrame:
        """(rank, id, score, data, ai); vector hits follow the text hits.

        The vector part needs clustered vectors, a query of several tokens and
        its embedding, which the embedder gives if the caller doesn't; if that
        fails the text hits stand alone.
        """
        check_query(query)
        k = self.config.result_size if k is None else k
        spec = self._spec(filters)
        hits = search.with_data(self._ranked(query, k, spec), self.tables).withColumn("part", F.lit(0))
        if self.members is not None and count_tokens(query) >= self.knobs.ai_parallel_search_min_tokens and (embedding := self._embedding(query, embedding)) is not None:
            live = self.docs.select("id")
            allowed = search.allowed_ids(self.tables.filters, spec).join(live, "id", "left_semi") if spec else live
            near = vectors.probe_topk(self.members, self.categories, embedding, k, allowed, self.knobs.ai_search_top_n_categories)
            hits = hits.unionByName(search.with_data(near, self.tables, ai=True).withColumn("part", F.lit(1)))
        return hits.orderBy("part", "rank").drop("part")

    def _ranked(self, query: str, k: int, spec: Mapping[str, Sequence[str]] | None) -> DataFrame:
        """The best k hits; any k where a knob lets the scan stop at the first."""
        knobs = self.knobs
        if knobs.single_term_skip_whole_scan or knobs.multi_term_skip_whole_scan:
            if knobs.single_term_skip_whole_scan if count_tokens(query) == 1 else knobs.multi_term_skip_whole_scan:
                some = search.any_hits(query, self.tables, k, knobs, spec)
                return some.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), "id", "score")
        return search.search(query, self.tables, knobs, k, spec)

    def search_within(self, seconds: float, query: str, **how: Any) -> list[Row]:
        """The collected hits, or ``SearchCanceled`` when time is up: its jobs are stopped."""
        sc, tag = self.spark.sparkContext, f"search-{uuid.uuid4().hex}"
        late = threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, stop)
        sc.addJobTag(tag)
        timer.start()
        try:
            out = self.search(query, **how).collect()
        except Exception as e:
            if late.is_set():
                raise SearchCanceled("search canceled") from e
            raise
        finally:
            timer.cancel()
            sc.removeJobTag(tag)
        if late.is_set():
            raise SearchCanceled("search canceled")
        return out

    def _embedding(self, query: str, given: Sequence[float] | None) -> Sequence[float] | None:
        if given is not None or self.embedder is None:
            return given
        try:
            found = self.embedder([query])[0]
        except Exception as e:  # a service that is down costs the vector hits alone
            logging.getLogger(__name__).warning("no embedding of the query: %s", e)
            return None
        return found if any(found) else None

    def search_batch(self, queries: DataFrame, k: int | None = None, filters: str | Mapping[str, Sequence[str]] | None = None) -> DataFrame:
        return search.search_batch(queries, self.tables, self.knobs, k, self._spec(filters))

    def enable_ai(self, embedder: Callable[[list[str]], list[Sequence[float]]]) -> None:
        """Take the callable that embeds documents and queries."""
        self.embedder = embedder

    def ai_enabled(self) -> bool:
        return self.embedder is not None or self.vectors is not None

    def cluster(self, embedded: DataFrame) -> None:
        """Take (id, ord, vector) of live documents and fold them into categories from the start."""
        self.vectors = self.members = self.categories = None
        self._fold(embedded.join(self.docs.select("id"), "id", "left_semi"))

    def _fold(self, fresh: DataFrame) -> None:
        """Fold (id, ord, vector) into the written state; vectors of the same ids leave it first, exactly."""
        path = snapshot.shared_folder(self.spark)
        put = lambda df, name: (df.write.parquet(f"{path}/{name}"), self.spark.read.parquet(f"{path}/{name}"))[1]
        fresh = put(fresh.where(vectors.usable(F.col("vector"))).select("id", "ord", "vector", F.current_timestamp().alias("created_at")), "fresh")
        start: list[tuple[str, list[float], int]] = []
        if self.vectors is not None:
            ids = fresh.select("id")
            older, kept = self.vectors.join(ids, "id", "left_anti"), self.members.join(ids, "id", "left_anti")
            # At most ai_max_categories rows.
            start = [(r["name"], r["centroid"], r["count"]) for r in vectors.categories(kept).collect()]
            start.sort(key=lambda c: (len(c[0]), c[0]))
            since = self.vectors.select("id", F.col("created_at").alias("since"))
            fresh = fresh.join(since, "id", "left").select("id", "ord", "vector", F.coalesce("since", "created_at").alias("created_at"))
        found = put(vectors.cluster_incremental(fresh, self.knobs, start), "found")
        members = found.select("id", F.explode("categories").alias("name")).join(fresh.select("id", "vector"), "id")
        if self.vectors is not None:
            fresh, members = older.select(*fresh.columns).unionByName(fresh), kept.select(*members.columns).unionByName(members)
        self.vectors, self.members = put(fresh, "vectors"), put(members, "members")
        self.categories = put(vectors.categories(self.members), "categories")

    def categorize(self, docs: DataFrame | None = None) -> dict[str, int]:
        """Embed documents, ``ai_embed_concurrency`` tasks at once, and fold them in their order.

        Counts of those folded and of those whose embedding failed or has no
        direction; failures cost their documents alone.
        """
        if self.embedder is None:
            raise InvalidRequest("the index has no embedder")
        docs = self.docs if docs is None else docs
        rows = docs.select("id", fn.embed_content(docs, self.config.index_fields).alias("text")).withColumn("ord", F.monotonically_increasing_id())
        rows.write.parquet(path := f"{snapshot.shared_folder(self.spark)}/texts")
        rows = self.spark.read.parquet(path)
        got = vectors.embed(rows.repartition(self.knobs.ai_embed_concurrency, "id"), "text", self.embedder, tolerant=True)
        got.write.parquet(path := f"{snapshot.shared_folder(self.spark)}/embedded")
        got = self.spark.read.parquet(path).join(rows.select("id", "ord"), "id")
        counts = vectors.embedding_counts(got).first().asDict()
        self._fold(got)
        return counts

    def categorize_document(self, key: str) -> None:
        """Embed and fold one document; a failure or a vector without direction is an error."""
        if self.categorize(self.docs.where(F.col("id") == key)) != {"ok": 1, "failed": 0}:
            raise InvalidRequest(f"document {key!r} could not be embedded")

    def remove_document(self, key: str) -> bool:
        """Take a document's vector out of the categories, exactly; false if it has none."""
        if self.vectors is None or not self.vectors.where(F.col("id") == key).take(1):
            return False
        left = vectors.subtract(vectors.centroids(self.members), vectors.centroids(self.members.where(F.col("id") == key)))
        self.vectors, self.members = self.vectors.where(F.col("id") != key), self.members.where(F.col("id") != key)
        self.categories = vectors.of_sums(left)
        return True

    def ai_document_count(self) -> int:
        return self.vectors.count() if self.vectors is not None else 0

    def category_count(self) -> int:
        return self.categories.count() if self.categories is not None else 0

    def ai_document(self, key: str) -> Row | None:
        """(id, vector, norm, categories, created_at) of a document, if it has a vector."""
        if self.vectors is None:
            return None
        names = self.members.where(F.col("id") == key).agg(F.sort_array(F.collect_list("name")).alias("categories"))
        one = self.vectors.where(F.col("id") == key).select("id", "vector", vf.norm(F.col("vector")).alias("norm"), "created_at")
        return one.crossJoin(names).select("id", "vector", "norm", "categories", "created_at").first()  # a row by a row

    def list_categories(self) -> DataFrame:
        if self.categories is None:
            raise InvalidRequest("the index has no vectors")
        return self.categories.orderBy("name")

    def materialize(self, path: str) -> None:
        """Write all tables and read them from there from now on."""
        self.save(path)
        loaded = snapshot.load(self.spark, path)
        self.docs, self._tables = loaded.documents, loaded

    def compact(self, path: str) -> dict[str, int]:
        """``materialize``, and the documents stored and active before and after."""
        before = self.stored_document_count()
        self.materialize(path)
        after = self.stored_document_count()
        return {"stored_before": before, "stored_after": after, "active_after": after, "removed_versions": 0}

    def refresh_prefixes(self) -> DataFrame:
        """Rank the prefix table anew, unless a knob says to leave it."""
        if not self.knobs.skip_update_prefix:
            self.tables.prefixes = ix.prefix_table(self.tables.vocabulary, self.knobs.max_prefix_terms)
        return self.tables.prefixes

    def refresh_all(self) -> tuple[DataFrame, DataFrame]:
        self.tables.deletes = ix.delete_table(self.tables.vocabulary)
        return self.refresh_prefixes(), self.tables.deletes

    def filter_fields(self) -> list[str]:
        return sorted(self.config.filters)

    def stored_document_count(self) -> int:
        return self.docs.count() if self.docs is not None else 0

    def save(self, path: str) -> None:
        snapshot.save(self.tables, path)

    def save_vectors(self, path: str) -> None:
        knobs = {k: v for k, v in asdict(self.knobs).items() if k.startswith("ai_")}
        snapshot.save_vectors(self.vectors, self.members, self.categories, path, knobs)

    def stats(self) -> DataFrame:
        return maintain.index_stats(self.tables)


class Catalog:
    """Indexes by name."""

    def __init__(self, spark: SparkSession, knobs: Knobs = Knobs()):
        self.spark, self.knobs, self.indexes = spark, knobs, {}

    def create_index(self, name: str, index_fields: Sequence[str], weights: Mapping[str, int] | None = None, filters: Sequence[str] = (), result_size: int = 0, **more: str) -> Index:
        check_identifier(name, "index name", MAX_NAME)
        if name in self.indexes:
            raise AlreadyExists(f"index {name!r} exists")
        self.indexes[name] = Index(self.spark, IndexConfig.create(index_fields, weights, filters, result_size, **more), self.knobs)
        return self.indexes[name]

    def get(self, name: str) -> Index:
        if name not in self.indexes:
            raise InvalidRequest(f"no index {name!r}")
        return self.indexes[name]

    def list_indexes(self) -> list[dict[str, Any]]:
        """Names in order, each with its fields and its filters in order."""
        return [{"name": n, "indexFields": list(i.config.index_fields), "filters": sorted(i.config.filters)} for n, i in sorted(self.indexes.items())]

    def load(self, name: str, path: str, vectors_path: str | None = None) -> Index:
        """Read a snapshot; on failure an index of that name stays as it is."""
        check_identifier(name, "index name", MAX_NAME)
        loaded = snapshot.load(self.spark, path)
        out = Index(self.spark, loaded.config, self.knobs)
        out.docs, out._tables = loaded.documents, loaded
        if vectors_path and (saved := snapshot.load_vectors(self.spark, vectors_path)):
            out.vectors, out.members, out.categories = saved[:3]
            out.knobs = replace(self.knobs, **{k: v for k, v in saved[3].items() if v})
        self.indexes[name] = out
        return out

    def health(self) -> dict[str, str]:
        return {"status": "ok"}
