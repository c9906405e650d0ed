"""Quality rules whose cutoffs limit the false rejection of good documents.

Fixed measures of each whole text are compared with cutoffs chosen from the
labelled documents.  All rules tighten together along a path fixed beforehand,
and a step of it rejects what any of its cutoffs does.  Per stratum the steps
are tested from the loosest on: a step is certified while the exact binomial
tail P(Bin(n, alpha) <= k) of the k good texts it would reject among n stays
within the error level, which is split over the strata (Bonferroni); testing in
a fixed order ends with the first failure and needs no further correction.  So
the rules together wrongly reject at most the share ``alpha`` of a stratum's
good documents, with confidence 1 - delta over all strata at once.  Equal texts
are one trial.  Strata of fewer than ``LEAST_GOOD`` good texts can certify
nothing alone and are one stratum together.

Everything is DataFrame expressions; counts are aggregated before they meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import WORD_GAP, Scratch, column, own_name, small, words_of

ALPHA, DELTA = 0.02, 0.05
LEAST_GOOD = 300
#: Each rule: a share of two measures, and its loosest and tightest cutoff; texts
#: above the cutoff are rejected.
RULES = {
    "symbols": ("n_symbols", "word_chars", 0.5, 0.02),
    "capitals": ("n_capitals", "word_chars", 0.8, 0.3),
    "exclaims": ("n_exclaims", "n_words", 1.0, 0.2),
    "dup_lines": ("n_dup_lines", "n_lines", 0.9, 0.4),
    "repeats": ("n_repeat_words", "n_words", 0.5, 0.35),
}
STEPS = 24
#: The cutoffs of each rule by step.
PATH = {r: [round(hi + (lo - hi) * g / (STEPS - 1), 4) for g in range(STEPS)] for r, (_, _, hi, lo) in RULES.items()}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims")


def _repeat_words(h: Column) -> Column:
    """Words in three-word windows that occur again, from the word hashes."""
    n = F.size(h)
    two = F.zip_with(F.slice(h, 1, n - 2), F.slice(h, 2, n - 2), lambda a, b: F.xxhash64(a, b))
    return F.when(n < 4, F.array().cast("array<bigint>")).otherwise(F.zip_with(two, F.slice(h, 3, n - 2), lambda a, b: F.xxhash64(a, b)))


def _covered(s: Column) -> Column:
    """Distinct words under the windows of equal hash in the sorted array."""
    n = F.size(s) - 1
    none = F.array().cast("array<int>")
    again = F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(none))
    words = F.transform(F.array_distinct(F.flatten(again)), lambda p: F.array(p, p + 1, p + 2))
    return F.size(F.array_distinct(F.flatten(words)))


def measures(docs: DataFrame, text_col: str = "text", into: str = "measures") -> DataFrame:
    """All columns of ``docs`` and a struct of the measures of each whole text.

    Null and empty texts have no words and zero for every measure.
    """
    stage = own_name(docs, "__stage")
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    out = docs.withColumn(stage, F.struct(text.alias("t"), words_of(text).alias("w")))
    t, w = F.col(stage)["t"], F.col(stage)["w"]
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn(
        stage,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(t, WORD_GAP, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            lines.alias("lines"),
            F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
            F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclaims"),
            F.transform(w, lambda x: F.xxhash64(x)).alias("h"),
        ),
    )
    keep = lambda *names: [F.col(stage)[n].alias(n) for n in names]
    out = out.withColumn(stage, F.struct(*keep("n_words", "word_chars", "n_symbols", "n_capitals", "n_exclaims", "lines"), _repeat_words(F.col(stage)["h"]).alias("v")))
    v = F.col(stage)["v"]
    ordered = F.when(F.size(F.array_distinct(v)) < F.size(v), F.sort_array(F.transform(v, lambda h, p: F.struct(h.alias("h"), p.alias("p")))))
    n_lines = F.size(F.col(stage)["lines"]).cast("long")
    dup = n_lines - F.size(F.array_distinct(F.col(stage)["lines"]))
    out = out.withColumn(stage, F.struct(*keep("n_words", "word_chars", "n_symbols", "n_capitals", "n_exclaims"), n_lines.alias("n_lines"), dup.alias("n_dup_lines"), ordered.alias("s")))
    s = F.col(stage)["s"]
    repeats = F.when(s.isNull(), F.lit(0)).otherwise(_covered(s)).cast("long").alias("n_repeat_words")
    return out.withColumn(stage, F.struct(*keep(*(m for m in MEASURES if m != "n_repeat_words")), repeats)).withColumnRenamed(stage, into)


def _share(m: Column, rule: str) -> Column:
    top, all_ = (m[x] for x in RULES[rule][:2])
    return F.when(all_ > 0, top / all_).otherwise(F.lit(0.0))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _ln_factorial(x: Column) -> Column:
    """ln x! for whole numbers: exact to 20, then Stirling's series."""
    y = x.cast("double")
    series = (y + 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed down from k; 1 where k is above the mean.

    Terms more than 40 standard deviations below k vanish in double precision.
    """
    first = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(F.sqrt(n * (p * (1 - p))) * 40 + 60)).cast("int")
    odds = (1 - p) / p
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        at = k - i + 1
        term = acc["term"] * at / (n - at + 1) * odds
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), zero, add, lambda acc: acc["sum"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(first) * total)


def first_step(m: Column) -> Column:
    """The first step that rejects a text, STEPS where none does."""
    passed = lambda share, r: F.size(F.filter(F.array(*map(F.lit, PATH[r])), lambda c: share <= c))
    return F.least(*(passed(_share(m, r), r) for r in RULES))


def certified(scratch: Scratch, measured: DataFrame, labels: DataFrame, *, label_id: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(own, stratum, step): the last certified step, null where none is.

    ``own`` is false for the strata that are one together, whose name is null.
    """
    good = labels.groupBy(column(labels, label_id).alias("__good")).agg(F.max(column(labels, label_col)).alias("__q")).where("__q = 1").select("__good")
    rows = measured.where(~base_failed(F.col("measures"))).join(good, F.col("id") == F.col("__good"), "left_semi")
    texts = rows.select("stratum", "text_hash", first_step(F.col("measures")).alias("first")).distinct()
    seen = scratch.table(texts.groupBy("stratum", "first").count(), "seen")
    n = seen.groupBy(F.col("stratum").alias("of")).agg(F.sum("count").alias("n"))
    large = F.col("n") >= LEAST_GOOD
    seen = seen.join(n, F.col("stratum").eqNullSafe(F.col("of"))).select(large.alias("own"), F.when(large, F.col("stratum")).alias("stratum"), "first", "count")
    groups = seen.groupBy("own", "stratum").agg(F.sum("count").alias("n"), F.collect_list(F.struct("first", "count")).alias("by"))
    groups = scratch.table(groups, "strata")
    level = delta / max(1, groups.count())
    rejected = F.aggregate(F.filter("by", lambda b: b["first"] <= F.col("g")), F.lit(0).cast("long"), lambda a, b: a + b["count"])
    cells = groups.select("own", "stratum", "n", "by", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("g")).select("own", "stratum", "n", "g", rejected.alias("k"))
    # More are rejected at each step, so the last step that holds is the one before the first failure.
    return cells.groupBy("own", "stratum").agg(F.max(F.when(binomial_tail(F.col("k"), F.col("n"), alpha) <= level, F.col("g"))).alias("step"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk: float) -> DataFrame:
    """(id, the measures, base_failed, failed_rules, kept, text_hash) of each row.

    ``kept`` is false for a base failure (fewer than 50 words, or over half of
    them in repeated three-word windows) or a share above a certified cutoff.
    Strata without good labels follow the small ones; a null stratum is one of
    its own; null and empty texts fail the base; repeated rows are judged each
    and are one trial; labels repeated for an id count once, as good if any is;
    with no labels only the base rules act; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"), column(docs, stratum_col).cast("string").alias("stratum"))
    table = measures(rows).select("id", "stratum", "measures", F.xxhash64("text").alias("text_hash"))
    table = scratch.table(table, "measures")
    steps = scratch.table(certified(scratch, table, labels, **risk), "steps")
    rest = steps.where(~F.col("own")).first()  # one row at most
    own = steps.where("own").select(F.col("stratum").alias("of"), "step", F.lit(True).alias("own"))
    judged = table.join(small(own, own.count()), table["stratum"].eqNullSafe(own["of"]), "left")
    m, step = F.col("measures"), F.when(F.col("own"), F.col("step")).otherwise(F.lit(rest["step"] if rest else None).cast("int"))
    failed = F.array_compact(F.array(*(F.when(_share(m, r) > F.element_at(F.array(*map(F.lit, PATH[r])), step + 1), F.lit(r)) for r in RULES)))
    judged = judged.withColumns({"base_failed": base_failed(m), "failed_rules": failed})
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return judged.select(F.col("id").alias(id_col), *(m[x].alias(x) for x in MEASURES), "base_failed", "failed_rules", kept.alias("kept"), "text_hash")


def without(docs: DataFrame, verdict: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, all columns unchanged.

    Rows meet on id and text, both null-safe, so ids that several texts share
    are judged one by one.
    """
    bad = verdict.where(~F.col("kept")).select(column(verdict, id_col).alias(own_name(docs, "__bad")), F.col("text_hash").alias(own_name(docs, "__hash"))).distinct()
    bad = Scratch(docs.sparkSession, "rejected").table(bad)
    bad = small(bad, bad.count())
    on = column(docs, id_col).eqNullSafe(bad[bad.columns[0]]) & (F.xxhash64(column(docs, text_col).cast("string")) == bad[bad.columns[1]])
    return docs.join(bad, on, "left_anti")
