"""Ranked search: one plan for single, multi-term and batched queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.config import Knobs
from wordloom.operators.expand import BROADCAST_TOKENS, candidates, query_tokens
from wordloom.operators.index import Tables

FilterSpec = Mapping[str, Sequence[str]]


def allowed_ids(filters: DataFrame, spec: FilterSpec) -> DataFrame:
    """Ids with any of the values of every field, some repeatedly; an empty list allows nothing."""
    wanted = F.lit(False)
    for name, values in spec.items():
        wanted = wanted | ((F.col("field") == name) & F.col("value").isin(*values) if values else F.lit(False))
    met = filters.where(wanted)
    if len(spec) == 1:
        return met.select("id")
    return met.groupBy("id").agg(F.count_distinct("field").alias("n")).where(F.col("n") == len(spec)).select("id")


def scored(cands: DataFrame, postings: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) of documents that match every group of a query.

    Within a group the first matching candidate counts, over groups the scores
    add up.  Rows are dealt by document once, which serves the filter, both
    sums and whatever is joined by document later; filters act first.
    """
    hits = postings.join(cands, "term").select("query_id", "n_groups", "group_no", "id", "cand_rank", (F.col("score") * F.col("boost")).alias("s"))
    hits = hits.repartition("id") if allowed is None else hits.join(allowed, "id", "left_semi")
    groups = hits.groupBy("query_id", "id", "group_no", "n_groups").agg(F.min_by("s", "cand_rank").alias("s"))
    both = groups.groupBy("query_id", "id", "n_groups").agg(F.sum("s").alias("score"), F.count("*").alias("matched"))
    return both.where("matched = n_groups").select("query_id", "id", "score")


def _hits(queries: DataFrame, tables: Tables, knobs: Knobs, filters: FilterSpec | None, few: bool) -> DataFrame:
    cands = candidates(queries, tables, knobs, few)
    return scored(F.broadcast(cands) if few else cands, tables.postings, allowed_ids(tables.filters, filters) if filters else None)


def search_batch(queries: DataFrame, tables: Tables, knobs: Knobs = Knobs(), k: int | None = None, filters: FilterSpec | None = None, few: bool | None = None) -> DataFrame:
    """(query_id, rank, id, score): the best k documents of each (query_id, query).

    Ties go to the lesser id.  A query without tokens, or with a group that
    has no candidate, has no hits.  ``few`` tells that the tokens are few
    enough to broadcast; they are counted where it is not given.
    """
    k = tables.config.result_size if k is None else k
    if few is None:
        few = query_tokens(queries).count() <= BROADCAST_TOKENS
    hits = _hits(queries, tables, knobs, filters, few)
    hits = hits.join(tables.popularity, "id", "left").withColumn("score", F.col("score") + F.coalesce("popularity", F.lit(0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _one(query: str, tables: Tables) -> DataFrame:
    return tables.postings.sparkSession.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("query"))


def search(query: str, tables: Tables, knobs: Knobs = Knobs(), k: int | None = None, filters: FilterSpec | None = None) -> DataFrame:
    """(rank, id, score) of one query."""
    return search_batch(_one(query, tables), tables, knobs, k, filters, few=True).drop("query_id")


def any_hits(query: str, tables: Tables, k: int, knobs: Knobs = Knobs(), filters: FilterSpec | None = None) -> DataFrame:
    """Some k matching documents, unranked: the scan may stop early."""
    hits = _hits(_one(query, tables), tables, knobs, filters, True)
    return hits.select("id", "score").limit(k)


def with_data(hits: DataFrame, tables: Tables, ai: bool = False) -> DataFrame:
    """Hits with their whole document, fetched after ranking.

    Hits are a result's few rows, so they go to where the documents are.
    """
    docs = tables.documents.select("id", F.struct(*(c for c in tables.documents.columns if c != "id")).alias("data"))
    return docs.join(F.broadcast(hits), "id").select(*hits.columns, "data", F.lit(ai).alias("ai"))


def to_response(hits: DataFrame, index: str, query: str) -> DataFrame:
    """One row of JSON: status, index, query and the hits in order."""
    rows = hits.select(F.struct("rank", F.struct(F.col("id").alias("ID"), F.col("data").alias("Data"), F.col("score").alias("Score"), F.col("ai").alias("AI")).alias("hit")).alias("h"))
    docs = F.transform(F.array_sort(F.collect_list("h")), lambda h: h["hit"])
    body = F.struct(F.lit("success").alias("status"), F.lit(200).alias("statusCode"), F.lit(index).alias("index"), F.lit(query).alias("query"), F.struct(docs.alias("Docs")).alias("response"))
    return rows.agg(F.to_json(body).alias("json"))
