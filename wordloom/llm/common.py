"""Shared scratch tables, column helpers and word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.ship import ship

#: Words are maximal runs outside these characters (space and U+0009 to U+000D).
#: One by one they stand in a table of the matcher; a range doesn't.
WORD_GAP = r"[\x20\x09\x0A\x0B\x0C\x0D]+"

#: Tables of at most this many rows of a few numbers each may be broadcast;
#: every caller counts first and has a shuffle join for larger ones.
BROADCAST_ROWS = 400_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own and
    a cluster uses the warehouse, which is shared as well.
    """
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.startswith("local"):
            at = "file://" + tempfile.mkdtemp(prefix="wordloom-")
            spark.conf.set("spark.checkpoint.dir", at)
        else:
            at = spark.conf.get("spark.sql.warehouse.dir")
    return at.rstrip("/")


class Scratch:
    """Written tables that cut the lineage, so lost executors cost a reread."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(path)
        self.count = 0

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` once and return the table read from there."""
        self.count += 1
        at = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._wordloom_at = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing lazy reads any more."""
        for df in tables:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(df._wordloom_at), True)


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of ``df``, whatever its columns."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, also when the name holds dots."""
    return df["`" + name.replace("`", "``") + "`"]


def words_of(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark for broadcast when its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
