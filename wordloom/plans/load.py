"""Load tests: many clients over one index, or the same queries as one batch."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import maintain
from wordloom.operators.index import Tables
from wordloom.operators.search import search, search_batch

Load = Sequence[tuple[int, str, str, str | None]]


def run_clients(spark: SparkSession, tables: Tables, load: Load, filter_field: str, workers: int = 16) -> DataFrame:
    """(mode, ms, hits, failed) of each query, asked by so many threads at once."""

    def ask(item: tuple[int, str, str, str | None]) -> tuple[str, float, int, bool]:
        _, mode, text, value = item
        began = time.perf_counter()
        try:
            n = len(search(text, tables, filters={filter_field: [value]} if value else None).collect())
            return mode, (time.perf_counter() - began) * 1000, n, False
        except Exception:  # a failed query is counted, the load goes on
            return mode, (time.perf_counter() - began) * 1000, 0, True

    with ThreadPoolExecutor(workers) as pool:
        rows = list(pool.map(ask, load))
    return spark.createDataFrame(rows, "mode string, ms double, hits int, failed boolean")


def run_batch(spark: SparkSession, tables: Tables, load: Load, k: int | None = None) -> DataFrame:
    """The unfiltered part of the load as one job."""
    rows = [(i, text) for i, _, text, value in load if value is None]
    return search_batch(spark.createDataFrame(rows, "query_id long, query string"), tables, k=k)


def report(log: DataFrame) -> DataFrame:
    """Latencies by mode and over all, with the failures."""
    every = log.unionByName(log.withColumn("mode", F.lit("overall")))
    return maintain.latency_stats(every, "mode", "ms").join(maintain.status_counts(every, "mode", F.col("failed")).drop("n"), "mode")
