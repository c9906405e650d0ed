"""Index tables derived from documents: postings and all that follows from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.config import IndexConfig, Knobs
from wordloom.functions import text as fn

#: Shortest term in the fuzzy dictionary.
FUZZY_LEAST = 4


def live_documents(raw: DataFrame, config: IndexConfig, version: str | None = None, distinct: bool = False) -> DataFrame:
    """Documents with a usable id as string column ``id``, the last version of each.

    Without a ``version`` column the last row read counts.  ``distinct`` tells
    that no id is repeated, which saves dealing the documents by id.
    """
    df = raw.withColumn("id", fn.plain_text(raw[config.id_field], raw.schema[config.id_field].dataType))
    df = df.where(F.col("id").isNotNull() & ~F.col("id").isin("", "<nil>"))
    if version or distinct:
        return latest(df, version) if version else df
    return latest(df.withColumn("__order", F.monotonically_increasing_id()), "__order").drop("__order")


def latest(df: DataFrame, version: str) -> DataFrame:
    """The row with the greatest version of each id."""
    w = Window.partitionBy("id").orderBy(F.desc(version))
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def postings(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """(term, id, score): the summed shares of a term in a document.

    A token's share is that of its field.  All tokens of a document are in one
    row, so they are sorted and summed there and no row is dealt by document.
    """
    rows = _sorted_tokens(docs, config)
    if len(config.index_fields) == 1:
        term, score = lambda i: F.get("t", i), lambda a, b: (b - a) * F.col("s")
    else:
        term, score = lambda i: F.get("t", i)["t"], lambda a, b: F.aggregate(F.slice("t", a + 1, b - a), F.lit(0).cast("bigint"), lambda n, x: n + x["s"])
    first = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (term(i) != term(i - 1)))
    rows = rows.withColumn("first", first)
    ends = F.array_append(F.slice("first", F.lit(2), F.size("first")), F.size("t"))
    each = rows.select("id", F.explode(F.zip_with("first", ends, lambda a, b: F.struct(term(a).alias("term"), score(a, b).cast("bigint").alias("score")))).alias("x"))
    return each.select("x.term", "id", "x.score")


def term_totals(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """(term, df, score): postings of each term and their summed scores, of documents whose postings are not written.

    Every token adds its share; the first of a document's equal tokens adds the
    document.  No posting is made, and no function runs by token.
    """
    rows = _sorted_tokens(docs, config)
    if len(config.index_fields) == 1:
        each = rows.select("t", "s", F.posexplode("t").alias("i", "term"))
        before = F.get("t", F.col("i") - 1)
    else:
        each = rows.select("t", F.posexplode("t").alias("i", "x")).select("t", "i", F.col("x.t").alias("term"), F.col("x.s").alias("s"))
        before = F.get("t", F.col("i") - 1)["t"]
    new = (F.col("i") == 0) | (before != F.col("term"))
    return each.select("term", new.cast("bigint").alias("n"), "s").groupBy("term").agg(F.sum("n").alias("df"), F.sum("s").alias("score"))


def _sorted_tokens(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """(id, t, s) of documents with tokens: these sorted, and the share of each.

    With several fields (id, t), and ``t`` holds pairs of token and share.
    """
    tokens = [fn.field_tokens(docs, f) for f in config.index_fields]
    rows = fn.made_once(docs, "id", **{f"t{i}": t for i, t in enumerate(tokens)})
    total = sum((F.size(f"t{i}") * config.weight(f) for i, f in enumerate(config.index_fields)), F.lit(0)).cast("bigint")
    rows = rows.withColumn("total", total).where("total > 0")
    share = [F.greatest(F.expr(f"{fn.SCORE_UNIT * config.weight(f)}L div total"), F.lit(1).cast("bigint")) for f in config.index_fields]
    if len(tokens) == 1:
        return rows.select("id", F.sort_array("t0").alias("t"), share[0].alias("s"))
    return rows.select("id", F.sort_array(F.concat(*(_shared(F.col(f"t{i}"), s) for i, s in enumerate(share)))).alias("t"))


def _shared(tokens: Column, share: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("t"), share.alias("s")))


def vocabulary(post: DataFrame) -> DataFrame:
    """(term, df): documents of each term."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary_of(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """The vocabulary of documents whose postings are not written: no score is made."""
    tokens = F.concat(*(fn.field_tokens(docs, f) for f in config.index_fields))
    return vocabulary(docs.select(F.explode(F.array_distinct(tokens)).alias("term")))


def prefix_table(vocab: DataFrame, most: int = Knobs.max_prefix_terms) -> DataFrame:
    """(prefix, rank, term, df): the most frequent terms under each proper prefix."""
    rows = vocab.select("term", "df", F.explode(fn.proper_prefixes(F.col("term"))).alias("prefix"))
    w = Window.partitionBy("prefix").orderBy(F.desc("df"), "term")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("prefix", "rank", "term", "df")


def delete_table(vocab: DataFrame) -> DataFrame:
    """(key, term, df) for terms long enough for fuzzy search."""
    return vocab.where(F.length("term") >= FUZZY_LEAST).select(F.explode(fn.delete_keys(F.col("term"))).alias("key"), "term", "df")


def filter_table(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """(field, value, id) of every filter value of the documents."""
    out = None
    for name in config.filters:
        values = fn.filter_values(docs[name], docs.schema[name].dataType) if name in docs.columns else None
        if values is not None:
            rows = docs.select(F.lit(name).alias("field"), F.explode(F.array_distinct(values)).alias("value"), "id")
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else docs.sparkSession.createDataFrame([], "field string, value string, id string")


def popularity_table(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """(id, popularity) where it is above zero."""
    return docs.select("id", fn.popularity(docs, config.popularity_field).alias("popularity")).where("popularity > 0")


@dataclass
class Tables:
    """The tables of an index; each may be lazy or read from a snapshot."""

    config: IndexConfig
    documents: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    prefixes: DataFrame
    deletes: DataFrame
    filters: DataFrame
    popularity: DataFrame

    NAMES = ("documents", "postings", "vocabulary", "prefixes", "deletes", "filters", "popularity")
    #: What each task sorts its rows of a derived table by when it writes them: what
    #: looks them up, so lookups skip pages.
    SORTED = {"postings": ("term", "id"), "vocabulary": ("term",), "prefixes": ("prefix", "rank"), "deletes": ("key", "term"), "filters": ("field", "value", "id")}


def build(docs: DataFrame, config: IndexConfig, knobs: Knobs = Knobs()) -> Tables:
    """All tables of live documents (see ``live_documents``)."""
    post = postings(docs, config)
    vocab = vocabulary_of(docs, config)
    return Tables(config, docs, post, vocab, prefix_table(vocab, knobs.max_prefix_terms), delete_table(vocab), filter_table(docs, config), popularity_table(docs, config))
