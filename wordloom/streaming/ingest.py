"""Continuous upserts into a version log, and live term counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.functions.text import tokenize
from wordloom.operators.index import latest


def upsert_stream(source: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append a stream of (id, version, ...) to a version log, once per batch.

    Each batch has a folder of its own that a retry overwrites, so a batch
    that runs twice counts once; ``current`` reads the last version of each id.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, "version").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(log: DataFrame) -> DataFrame:
    """Live documents of a version log; a row with ``deleted`` set removes its id."""
    last = latest(log, "version")
    return last.where(~F.coalesce(F.col("deleted"), F.lit(False))).drop("deleted") if "deleted" in log.columns else last


def live_terms(source: DataFrame, text: str) -> DataFrame:
    """(term, n): running occurrences of each term of a stream of texts."""
    return source.select(F.explode(tokenize(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
