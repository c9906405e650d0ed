"""Made-up corpora, vocabularies and query loads for measurements."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_vocabulary(n: int, seed: int = 42) -> list[str]:
    """n different words of 3 to 12 small letters."""
    rng, seen = random.Random(seed), {}
    while len(seen) < n:
        seen["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 12)))] = None
    return list(seen)


def documents(spark: SparkSession, n: int, vocabulary: Sequence[str], seed: int = 42) -> DataFrame:
    """(id, title, tags, year): 3 to 20 words, 1 to 10 tags, 2000 to 2024."""
    words = F.array(*map(F.lit, vocabulary))
    draw = lambda salt, lo, hi: (F.pmod(F.xxhash64("k", F.lit(seed), salt), F.lit(hi - lo + 1)) + lo).cast("int")
    some = lambda salt, lo, hi: F.transform(F.sequence(F.lit(1), draw(F.lit(salt), lo, hi)), lambda i: F.element_at(words, draw(F.concat(F.lit(salt + "/"), i.cast("string")), 1, len(vocabulary))))
    return spark.range(n).withColumnRenamed("id", "k").select(
        F.concat(F.lit("d"), F.col("k").cast("string")).alias("id"), F.array_join(some("title", 3, 20), " ").alias("title"), some("tags", 1, 10).alias("tags"), draw(F.lit("year"), 2000, 2024).alias("year")
    )


def misspell(word: str, rng: random.Random) -> str:
    """A word with two neighbours swapped, a letter dropped or one doubled."""
    if len(word) < 3:
        return word
    how = rng.randrange(3)
    i = rng.randrange(len(word) - (how == 0))
    if how == 0:
        return word[:i] + word[i + 1] + word[i] + word[i + 2 :]
    return word[:i] + word[i + 1 :] if how == 1 else word[:i] + word[i] + word[i:]


def shortened(word: str, rng: random.Random) -> str:
    """A proper prefix of at least two letters, where the word has one."""
    return word[: rng.randint(2, len(word) - 1)] if len(word) > 2 else word


#: Shares of misspelled and prefix queries; the rest is exact.
MIXES = {"benchmark": (0.10, 0.25), "load": (0.15, 0.65)}


def one_term(vocabulary: Sequence[str], rng: random.Random, mix: str = "benchmark") -> str:
    wrong, short = MIXES[mix]
    word, x = rng.choice(vocabulary), rng.random()
    return misspell(word, rng) if x < wrong else shortened(word, rng) if x < wrong + short else word


def many_terms(pool: Sequence[str], rng: random.Random, mix: str = "benchmark") -> str:
    """Two to four terms of a vocabulary or of one document; the last may be cut or wrong."""
    words = [rng.choice(pool) for _ in range(rng.randint(2, 4))]
    return " ".join([*words[:-1], one_term([words[-1]], rng, mix)])


def query_load(vocabulary: Sequence[str], n: int, filters: Sequence[str], seed: int = 42, mix: str = "benchmark", pools: Sequence[Sequence[str]] = ()) -> list[tuple[int, str, str, str | None]]:
    """(query_id, mode, query, filter value) with the four modes in turn.

    Queries of several terms take them from one of the ``pools``, the tokens of
    a document each, where there are any.
    """
    rng, out = random.Random(seed), []
    for i in range(n):
        mode = ("single", "single_filter", "multi", "multi_filter")[i % 4]
        query = one_term(vocabulary, rng, mix) if mode.startswith("single") else many_terms(rng.choice(pools) if pools else vocabulary, rng, mix)
        out.append((i, mode, query, rng.choice(filters) if mode.endswith("filter") else None))
    return out
