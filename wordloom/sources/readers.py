"""Document readers and writers: JSON, CSV, Parquet, single documents, word files."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from typing import Any
from urllib import error, request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.config import MAX_DOC_FIELDS, MAX_ID, InvalidRequest, byte_length
from wordloom.functions.text import made_once, tokenize

#: A task may have so many times the rows of a core's even share.
UNEVEN = 1.25


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Documents of files that hold an array of objects."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Documents one to a line: the form that splits over tasks."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Documents of files with a header row; all values are strings."""
    return spark.read.option("header", True).option("multiLine", True).option("mode", "FAILFAST").option("escape", '"').csv(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON if the files parse as such, else CSV with at least a data row."""
    try:
        df = read_json(spark, path)
        if df.columns and "_corrupt_record" not in df.columns:
            return df
    except Exception as e:  # a parse failure; anything else fails again below
        if "MALFORMED" not in str(e) and "FAILFAST" not in str(e) and "parse" not in str(e).lower():
            raise
    df = read_csv(spark, path)
    if not df.take(1):
        raise InvalidRequest("the file is neither a JSON array nor CSV with a header and a row")
    return df


def one_document(spark: SparkSession, body: str | Mapping[str, Any]) -> DataFrame:
    """A request ``{"indexName"?, "document": {...}}`` as one row."""
    if isinstance(body, str):
        body = json.loads(body)
    unknown = set(body) - {"indexName", "document"}
    if unknown:
        raise InvalidRequest(f"unknown keys: {sorted(unknown)}")
    doc = body.get("document")
    if not isinstance(doc, Mapping) or not doc:
        raise InvalidRequest("document is missing")
    if len(doc) > MAX_DOC_FIELDS:
        raise InvalidRequest(f"more than {MAX_DOC_FIELDS} fields")
    key = doc.get("id")
    if key is None or str(key) in ("", "<nil>"):
        raise InvalidRequest("id is missing")
    if byte_length(str(key)) > MAX_ID:
        raise InvalidRequest(f"id is longer than {MAX_ID} bytes")
    text = json.dumps(doc)
    schema = spark.range(1).select(F.schema_of_json(F.lit(text))).first()[0]
    return spark.range(1).select(F.from_json(F.lit(text), schema).alias("d")).select("d.*")


def spread(df: DataFrame) -> DataFrame:
    """A table that few tasks would read, over all cores; others stay as they are.

    A row group is read by one task, whatever the size of the splits, so a table
    of few row groups keeps few cores busy.  Rows are counted by task, which
    reads no column.
    """
    cores, tasks = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if tasks > 1:
        rows = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        if not rows[0] or rows[0] * cores <= UNEVEN * rows[1]:
            return df
    return df.repartition(-(-tasks // cores) * cores)


def first_seen_vocabulary(docs: DataFrame, order: str, text: str) -> DataFrame:
    """(term, ord, pos): distinct tokens with the place where each is first seen."""
    each = docs.select(F.col(order).alias("ord"), F.posexplode(tokenize(F.col(text))).alias("pos", "term"))
    return each.groupBy("term").agg(F.min(F.struct("ord", "pos")).alias("at")).select("term", "at.ord", "at.pos")


def token_pools(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, tokens): the distinct tokens of documents that have two at least."""
    rows = made_once(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "id", tokens=F.array_distinct(tokenize(F.col("text"))))
    return rows.where(F.size("tokens") >= 2)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """One word a line, blanks skipped; a file without words is an error."""
    words = spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")
    if not words.take(1):
        raise InvalidRequest("the word file is empty")
    return words


def write_words(words: DataFrame, path: str) -> None:
    words.select("word").write.mode("overwrite").text(path)


class HttpEmbedder:
    """Vectors from ``POST {base}/embeddings``, usable inside ``vectors.embed``.

    Three attempts with waits of one and two seconds; a status of 400 or more
    and an answer without data are errors.
    """

    def __init__(self, base: str, model: str, key: str = "", timeout: float = 60.0, waits: Sequence[float] = (1.0, 2.0), opener: Callable | None = None):
        self.base, self.model, self.key, self.timeout, self.waits, self.opener = base.rstrip("/"), model, key, timeout, tuple(waits), opener

    def __call__(self, texts: list[str]) -> list[list[float]]:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        body = json.dumps({"input": texts, "model": self.model}).encode()
        for turn in range(len(self.waits) + 1):
            try:
                asked = request.Request(f"{self.base}/embeddings", body, head, method="POST")
                with (self.opener or request.urlopen)(asked, timeout=self.timeout) as answer:
                    data = json.loads(answer.read())["data"]
                if len(data) != len(texts):
                    raise ValueError("the service gave no vector for some texts")
                return [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
            except (error.URLError, OSError, KeyError, ValueError):
                if turn == len(self.waits):
                    raise
                time.sleep(self.waits[turn])
        raise AssertionError
