"""Headline timings as one JSON line.

``python bench.py`` reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS].  Besides the seconds of each query it gives the documents
indexed and the queries answered in a second, for loads in four modes (one or
several terms, with and without a filter) of 10 % misspelled, 25 % prefix and
65 % exact terms drawn from the corpus, and the latencies of single queries by
mode as asked by a few clients at once.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LOAD = int(os.environ.get("BENCH_QUERIES", "2000"))
CLIENT_QUERIES = 16
SINGLES = ("search_single_exact", "search_single_fuzzy", "search_multi_prefix_last", "filter_and", "popularity_multi", "cosine_topk", "category_probe_topk", "hybrid_append", "tokenize_documents", "vocab_df", "prefix_table_top64", "latency_nearest_rank")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("wordloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from wordloom.operators.search import search_batch
    from wordloom.plans import queries as q
    from wordloom.sources.datagen import query_load

    def timed(run) -> float:
        began = time.time()
        run().write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    began = time.time()
    tables = q.documents_index(spark, SF)
    seconds["index_build"] = round(time.time() - began, 3)
    q.parts_index(spark, SF)
    n_docs = tables.documents.count()

    words = [r["term"] for r in tables.vocabulary.where(F.length("term") >= 3).orderBy(F.desc("df"), "term").limit(5000).collect()]
    load = spark.createDataFrame(query_load(words, LOAD, ["en", "fr", "de", "es"]), "query_id long, mode string, query string, filter string").cache()
    load.count()
    for mode in ("single", "single_filter", "multi", "multi_filter"):
        part = load.where(F.col("mode") == mode)
        spec = {"lang": ["en"]} if mode.endswith("filter") else None
        seconds[f"batch_{mode}"] = timed(lambda part=part, spec=spec: search_batch(part, tables, k=100, filters=spec))
    for name in SINGLES:
        timed(lambda name=name: q.QUERIES[name](spark, SF)) if name in ("search_single_exact",) else None  # compiles the plan's code once
        seconds[name] = timed(lambda name=name: q.QUERIES[name](spark, SF))
    from wordloom.plans import load as clients

    log = clients.run_clients(spark, tables, query_load(words, CLIENT_QUERIES, ["en", "fr", "de", "es"], seed=7), "lang", workers=4)
    latency = {r["mode"]: {k: round(r[k], 1) for k in ("mean", "p50", "p95", "p99")} | {"n": r["n"], "errors": r["errors"]} for r in clients.report(log).collect()}
    batch = sum(v for k, v in seconds.items() if k.startswith("batch_"))
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF,
        "docs_per_second_indexed": round(n_docs / seconds["index_build"], 1), "queries_per_second_batch": round(LOAD / batch, 1), "latency_ms": latency,
    }))


def tool(args: list[str]) -> None:
    """``vocab N FILE``, ``datagen N DIR`` or ``loadtest N [WORKERS]``."""
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.scheduler.mode", "FAIR").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").getOrCreate()
    from wordloom.plans import load
    from wordloom.plans import queries as q
    from wordloom.sources import datagen, readers

    if args[0] == "vocab":
        readers.write_words(spark.createDataFrame([(w,) for w in datagen.random_vocabulary(int(args[1]))], "word string"), args[2])
    elif args[0] == "datagen":
        datagen.documents(spark, int(args[1]), datagen.random_vocabulary(5000)).write.mode("overwrite").json(args[2])
    elif args[0] == "loadtest":
        tables = q.documents_index(spark, SF)
        words = [r["term"] for r in tables.vocabulary.orderBy(F.desc("df"), "term").limit(5000).collect()]
        pools = [r["tokens"] for r in readers.token_pools(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text").limit(1000).collect()]
        asked = datagen.query_load(words, int(args[1]), ["en", "fr", "de", "es"], mix="load", pools=pools)
        load.report(load.run_clients(spark, tables, asked, "lang", int(args[2]) if len(args) > 2 else 16)).show()
    else:
        sys.exit(f"unknown tool {args[0]!r}: {tool.__doc__}")


if __name__ == "__main__":
    tool(sys.argv[1:]) if sys.argv[1:] else main()
