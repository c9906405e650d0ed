"""Snapshots of an index and of its vectors as Parquet and a line of JSON."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession

from wordloom.config import DEFAULT_RESULTS, IndexConfig, InvalidRequest, Knobs
from wordloom.operators import index
from wordloom.operators.index import Tables, build


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own under ``spark.checkpoint.dir``, gone with the session.

    Where that is unset a local session takes a temporary folder, a cluster the warehouse.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext.master.startswith("local"):
        at = "file://" + tempfile.mkdtemp(prefix="wordloom-index-")
        spark.conf.set("spark.checkpoint.dir", at)
    root = f"{(at or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex[:12]}"
    fs, path = _files(spark, root)
    fs.deleteOnExit(path)
    return root


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Rename the finished folder into place; a failed write leaves the old one."""
    fs, place = _files(spark, path)
    _, fresh = _files(spark, new)
    old = None
    if fs.exists(place):
        _, old = _files(spark, f"{path}.old-{uuid.uuid4().hex[:8]}")
        fs.rename(place, old)
    if place.getParent() is not None:
        fs.mkdirs(place.getParent())
    if not fs.rename(fresh, place):
        if old is not None:
            fs.rename(old, place)
        raise OSError(f"can't move the snapshot to {path}")
    if old is not None:
        fs.delete(old, True)


def save(tables: Tables, path: str, derived: bool = True, prefixes: int = Knobs.max_prefix_terms) -> None:
    """Write documents and definition, and the derived tables unless told not to.

    What follows from postings and vocabulary reads the written ones.  Every
    task sorts its rows by what looks them up, so a read skips pages; no row
    changes its task for that, so no key, however frequent, gathers in one.
    """
    spark = tables.documents.sparkSession
    new = f"{path}.new-{uuid.uuid4().hex[:8]}"

    def put(name: str, df: DataFrame) -> DataFrame:
        key = tables.SORTED.get(name)
        (df.sortWithinPartitions(*key) if key else df).write.parquet(f"{new}/{name}")
        return spark.read.schema(df.schema).parquet(f"{new}/{name}")

    put("documents", tables.documents)
    if derived:
        vocab = put("vocabulary", index.vocabulary(put("postings", tables.postings)))
        put("prefixes", index.prefix_table(vocab, prefixes))
        put("deletes", index.delete_table(vocab))
        put("filters", tables.filters)
        put("popularity", tables.popularity)
    spark.createDataFrame([(json.dumps(asdict(tables.config), default=list),)], "value string").coalesce(1).write.text(f"{new}/definition")
    _swap(spark, new, path)


def staged(tables: Tables, prefixes: int = Knobs.max_prefix_terms) -> Tables:
    """Lazy tables for one search: postings and vocabulary are written, what follows reads them.

    A search reads both several times; each time would tokenize all documents.
    """
    spark = tables.documents.sparkSession
    root = shared_folder(spark)

    def put(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    post = put("postings", tables.postings)
    vocab = put("vocabulary", index.vocabulary(post))
    return replace(tables, postings=post, vocabulary=vocab, prefixes=index.prefix_table(vocab, prefixes), deletes=index.delete_table(vocab))


def load(spark: SparkSession, path: str) -> Tables:
    """The index of a snapshot; derived tables that it lacks are rebuilt lazily."""
    fs, place = _files(spark, path)
    if not fs.exists(place):
        raise InvalidRequest(f"no snapshot at {path}")
    raw = json.loads(spark.read.text(f"{path}/definition").first()[0])
    if not raw["index_fields"] or raw["result_size"] < 0:
        raise InvalidRequest("the snapshot's definition is not valid")
    raw["result_size"] = raw["result_size"] or DEFAULT_RESULTS
    config = IndexConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
    docs = spark.read.parquet(f"{path}/documents")
    _, there = _files(spark, f"{path}/postings")
    if not fs.exists(there):
        return build(docs, config)
    tables = Tables(config, *(spark.read.parquet(f"{path}/{name}") for name in Tables.NAMES))
    if tables.popularity.isEmpty():  # then no plan joins it
        tables.popularity = tables.popularity.limit(0)
    return tables


def save_vectors(vectors: DataFrame | None, members: DataFrame | None, cats: DataFrame | None, path: str, knobs: dict) -> None:
    """Write (id, vector, ...), memberships, categories and knobs; without vectors an error."""
    if vectors is None or members is None or cats is None:
        raise InvalidRequest("the index has no vectors")
    spark = vectors.sparkSession
    new = f"{path}.new-{uuid.uuid4().hex[:8]}"
    for name, df in (("vectors", vectors), ("members", members), ("categories", cats)):
        df.write.parquet(f"{new}/{name}")
    spark.createDataFrame([(json.dumps(knobs),)], "value string").coalesce(1).write.text(f"{new}/knobs")
    _swap(spark, new, path)


def load_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, dict] | None:
    """The saved vectors, or None if there are none at the path."""
    fs, place = _files(spark, path)
    if not fs.exists(place):
        return None
    knobs = json.loads(spark.read.text(f"{path}/knobs").first()[0])
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("vectors", "members", "categories")) + (knobs,)
