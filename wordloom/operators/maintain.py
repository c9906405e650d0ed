"""Upserts, deletes, compaction and statistics on document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.operators.index import Tables


def upsert(base: DataFrame, delta: DataFrame) -> DataFrame:
    """``base`` with the documents of ``delta`` in place of those with their ids.

    Within ``delta`` the last row of an id wins, by its ``version`` if it has
    that column; otherwise ids are distinct there.
    """
    if "version" in delta.columns:
        w = Window.partitionBy("id").orderBy(F.desc("version"))
        delta = delta.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
    kept = base.join(delta.select("id"), "id", "left_anti")
    return kept.unionByName(delta, allowMissingColumns=True)


def delete(base: DataFrame, ids: DataFrame) -> DataFrame:
    """``base`` without the given ids; unknown ids change nothing."""
    return base.join(ids.select("id"), "id", "left_anti")


def compact(versions: DataFrame, deleted: DataFrame) -> DataFrame:
    """The live rows of a version log (id, version, ...): last versions, not deleted."""
    w = Window.partitionBy("id").orderBy(F.desc("version"))
    last = versions.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
    return last.join(deleted.select("id"), "id", "left_anti")


def compact_stats(versions: DataFrame, live: DataFrame) -> DataFrame:
    """One row: stored and active documents before and after.

    ``removed_versions`` is zero, as old versions go when they are replaced.
    """
    before = versions.agg(F.count_distinct("id").alias("stored_before"))
    after = live.agg(F.count("*").alias("stored_after"), F.count_distinct("id").alias("active_after"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(before).join(one(after), "__one").drop("__one").withColumn("removed_versions", F.lit(0).cast("bigint"))


def index_stats(tables: Tables) -> DataFrame:
    """One row: documents, terms, postings, filter keys and documents with popularity."""
    counts = {
        "documents": tables.documents.agg(F.count("*").alias("n")),
        "terms": tables.vocabulary.agg(F.count("*").alias("n")),
        "postings": tables.postings.agg(F.count("*").alias("n")),
        "filter_keys": tables.filters.agg(F.count_distinct("field", "value").alias("n")),
        "popular": tables.popularity.agg(F.count("*").alias("n")),
    }
    rows = None
    for name, df in counts.items():
        part = df.select(F.lit(name).alias("name"), "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy().pivot("name", list(counts)).agg(F.first("n"))


def latency_stats(times: DataFrame, by: str, value: str, percents: tuple[int, ...] = (50, 95, 99), steps: int = 1024) -> DataFrame:
    """Count, mean and exact nearest-rank percentiles of each group.

    Counts by step of the value range tell in which step each rank lies, and
    only those steps are ranked, so no task sorts a group.
    """
    rows = times.where(F.col(value).isNotNull()).select(F.col(by).alias("mode"), F.col(value).cast("double").alias("v"))
    whole = rows.groupBy("mode").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    on = lambda a, b: a["mode"].eqNullSafe(b["of"])
    ends = whole.select(F.col("mode").alias("of"), "n", "lo", "hi")
    spread = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * steps), F.lit(steps - 1))).otherwise(F.lit(0))
    counts = rows.join(ends, on(rows, ends)).select("mode", "n", spread.cast("int").alias("step"), "v").groupBy("mode", "n", "step", "v").agg(F.count("*").alias("c"))
    sums = counts.groupBy("mode", "n", "step").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("mode").orderBy("step"))
    ranks = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.ceil(F.col("n") * p / 100).alias("r")) for p in percents)))
    asked = sums.withColumn("upto", upto).select("mode", "step", "upto", "c", ranks.alias("x")).where("x.r <= upto and x.r > upto - c")
    asked = asked.select(F.col("mode").alias("of"), F.col("step").alias("in"), "x.p", (F.col("x.r") - F.col("upto") + F.col("c")).alias("r"))
    within = counts.withColumn("seen", F.sum("c").over(Window.partitionBy("mode", "step").orderBy("v")))
    hit = within.join(asked, on(within, asked) & (F.col("step") == F.col("in"))).where("seen >= r").groupBy("mode", "p").agg(F.min("v").alias("v"))
    wide = hit.groupBy(F.col("mode").alias("of")).agg(*(F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percents))
    return whole.join(wide, on(whole, wide)).select("mode", "n", "mean", *(f"p{p}" for p in percents))


def status_counts(log: DataFrame, by: str, failed) -> DataFrame:
    """Requests and failures of each mode."""
    return log.groupBy(F.col(by).alias("mode")).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"))
