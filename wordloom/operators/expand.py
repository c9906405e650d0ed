"""From query texts to candidate terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.config import Knobs
from wordloom.functions import text as fn
from wordloom.operators.index import Tables


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, group_no, token, n_groups) of (query_id, query)."""
    rows = queries.select("query_id", fn.tokenize(F.col("query")).alias("tokens"))
    return rows.select("query_id", F.size("tokens").alias("n_groups"), F.posexplode("tokens").alias("group_no", "token"))


def _by_bytes(token: Column, steps: tuple[tuple[int, int], ...], rest: int) -> Column:
    out = F.lit(rest)
    for most, cap in reversed(steps):
        out = F.when(F.octet_length(token) <= most, cap).otherwise(out)
    return out


def prefix_cap(token: Column) -> Column:
    return _by_bytes(token, ((2, 50), (5, 40)), 30)


def fuzzy_cap(token: Column) -> Column:
    return _by_bytes(token, ((4, 30), (6, 20)), 10)


#: Batches of at most so many query tokens are sent to every task; each token has
#: fifty candidates at most, so at most 400,000 short rows go with them.
BROADCAST_TOKENS = 8_000


def _plain(df: DataFrame) -> DataFrame:
    return df


def fuzzy_candidates(tokens: DataFrame, deletes: DataFrame, few: bool = False) -> DataFrame:
    """(token, term, rank): dictionary terms that share a delete key with a token.

    The order is that of probing: the token itself, then the token without its
    first, second, ... character; within a key the most frequent first.
    Sharing a key is enough, distance is not verified.  With ``few`` the tokens
    are known to be so few that they are broadcast.
    """
    hint = F.broadcast if few else _plain
    probes = tokens.select("token").distinct().select("token", F.posexplode(fn.query_keys(F.col("token"))).alias("pos", "key"))
    met = deletes.join(hint(probes), "key").where("term <> token").groupBy("token", "term", "df").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("token").orderBy("pos", F.desc("df"), "term")
    return met.withColumn("rank", F.row_number().over(w)).select("token", "term", "rank")


def candidates(queries: DataFrame, tables: Tables, knobs: Knobs = Knobs(), few: bool = False) -> DataFrame:
    """(query_id, n_groups, group_no, cand_rank, term, boost).

    One token: itself, then its first prefix terms; fuzzy terms only if it has
    neither.  Several: each token before the last gives itself and fuzzy terms,
    the last gives itself and prefix terms.
    """
    hint = F.broadcast if few else _plain
    tokens = query_tokens(queries)
    single, last = F.col("n_groups") == 1, F.col("group_no") == F.col("n_groups") - 1
    keep = lambda rank, boost: ("query_id", "n_groups", "group_no", rank.alias("cand_rank"), "term", F.lit(boost).cast("bigint").alias("boost"))
    exact = tables.vocabulary.select(F.col("term").alias("token")).join(hint(tokens), "token").withColumn("term", F.col("token"))
    cap = F.when(single, knobs.single_term_max_prefix_tokens).otherwise(prefix_cap(F.col("token")))
    prefix = tables.prefixes.withColumnRenamed("prefix", "token").join(hint(tokens.where(last)), "token").where(F.col("rank") <= cap)
    found = exact.where(single).select("query_id").union(prefix.where(single).select("query_id")).distinct()
    alone = tokens.where(single).join(hint(found), "query_id", "left_anti")
    asked = tokens.where(~last).unionByName(alone)
    cap = F.when(single, knobs.single_term_max_fuzzy_tokens).otherwise(fuzzy_cap(F.col("token")))
    fuzzy = fuzzy_candidates(asked, tables.deletes, few).join(hint(asked), "token").where(F.col("rank") <= cap)
    return exact.select(*keep(F.lit(0), knobs.exact_match_boost)).unionByName(prefix.select(*keep(F.col("rank"), 1))).unionByName(fuzzy.select(*keep(F.col("rank"), 1)))
