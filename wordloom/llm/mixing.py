"""Mixing documents to target weights over soft domains.

A softmax regression trained on a labelled table gives each document a
posterior over the domains.  Its features are the words that tell most about
the domain, each present or not, and it is scaled on labelled rows that the
training has not seen.  Projected gradient then fits a nonnegative rate for
every document, by least squares on the expected tokens of each domain against
the targets, starting from one and moving no rate without need.  The rate
depends on the posterior alone, which is rounded to hundredths that sum to one,
so each step reads the token sums of the distinct posteriors.  Rates become
whole copies by a draw for each row; of several draws the one is taken whose
totals come closest to the targets.  Everything that touches documents is
DataFrame expressions; only the bounded labelled sample comes to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import BROADCAST_ROWS, Scratch, column, own_name, small, words_of

#: The classifier is fitted on at most about so many labelled rows.
MAX_LABELLED = 20_000
#: Words that it looks at, one for every two rows at most, from those in so many
#: labelled rows at least.
FEATURES, LEAST_ROWS = 2000, 5
SLOTS = 1 << 16
#: Gradient steps, and the ridge, which is divided by the rows.
STEPS, RIDGE = 200, 0.3
#: Draws of which the one with the closest totals is taken.
DRAWS = 32


@dataclass(frozen=True)
class Mixer:
    """A fitted mixing: domains, classifier, gradient steps and the draw."""

    domains: tuple[str, ...]
    words: tuple[int, ...] = ()
    weights: tuple[tuple[float, ...], ...] = ()
    bias: tuple[float, ...] = ()
    steps: tuple[tuple[float, ...], ...] = ()
    most: float = 8.0
    draw: int = 0


def _features(text: Column) -> tuple[Column, Column]:
    """Words of the text, and the hashes of words, repeated ones too."""
    return words_of(F.lower(text)), lambda w: F.transform(w, lambda x: F.xxhash64(x))


def _literal(values, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def labelled_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) from quality and toxicity labels; null where neither tells."""
    one = labels.groupBy(column(labels, id_col).alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return one.select("id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean").alias("domain"))


def softmax_regression(rows: np.ndarray, at: np.ndarray, y: np.ndarray, width: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (width, kinds) and biases by adaptive full gradients.

    ``rows`` and ``at`` list the row and feature of each feature that is present.
    """
    w, grown = np.zeros((width + 1, kinds)), np.full((width + 1, kinds), 1e-8)
    goal = np.eye(kinds)[y]
    for _ in range(STEPS if len(y) else 0):
        off = _chances(rows, at, len(y), w[:-1], w[-1]) - goal
        g = RIDGE / len(y) * w
        for k in range(kinds):
            g[:-1, k] += np.bincount(at, off[rows, k], width) / len(y)
            g[-1, k] = off[:, k].mean()
        grown += g * g
        w -= 0.3 * g / np.sqrt(grown)
    return w[:-1], w[-1]


def _scores(rows: np.ndarray, at: np.ndarray, n: int, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(rows, w[at, k], n) + bias[k] for k in range(len(bias))], axis=1)


def _chances(rows: np.ndarray, at: np.ndarray, n: int, w: np.ndarray, bias: np.ndarray, scale: float = 1.0) -> np.ndarray:
    z = scale * _scores(rows, at, n, w, bias)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _scale(rows: np.ndarray, at: np.ndarray, y: np.ndarray, w: np.ndarray, bias: np.ndarray) -> float:
    """The scale of the scores under which rows not trained on are most likely."""
    if not len(y):
        return 1.0
    loss = lambda s: -np.log(_chances(rows, at, len(y), w, bias, s)[np.arange(len(y)), y] + 1e-12).sum()
    return min((2.0 ** (k / 8) for k in range(-24, 13)), key=loss)


def fit_classifier(docs: DataFrame, domains: DataFrame, names: tuple[str, ...], scratch: Scratch, max_labelled: int = MAX_LABELLED) -> Mixer:
    """Softmax regression on a sample of the labelled rows of (id, text).

    The sample takes rows by hash, at most about ``max_labelled`` of them; a
    quarter of it is kept for the scale.  Without labels all domains are alike.
    """
    domains = domains.where(F.col("domain").isin(*names) & F.col("id").isNotNull())
    words, hashes = _features(F.col("text"))
    rows = docs.join(small(domains, domains.count()), "id").select("domain", F.struct(words.alias("w")).alias("x")).select("domain", F.array_distinct(hashes(F.col("x.w"))).alias("h"))
    rows = scratch.table(rows.withColumn("u", F.xxhash64(F.monotonically_increasing_id())), "labelled")
    n = rows.count()
    if not n:
        return Mixer(names, (), tuple(() for _ in names), (0.0,) * len(names))
    rows = rows.where(F.pmod("u", F.lit(1_000_000)) < int(min(1.0, max_labelled / n) * 1_000_000)) if n > max_labelled else rows
    held = F.pmod(F.shiftright("u", 32), F.lit(4)) == 0
    per = {r["domain"]: r["count"] for r in rows.where(~held).groupBy("domain").count().collect()}
    total = max(1, sum(per.values()))
    seen = rows.where(~held).select("domain", F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(names)))
    part = lambda a, b: F.when(a > 0, a / total * F.log(a * float(total) / b)).otherwise(F.lit(0.0))
    told = sum((part(F.col(f"n{i}"), F.col("n") * per.get(d, 0)) + part(F.lit(per.get(d, 0)) - F.col(f"n{i}"), (F.lit(total) - F.col("n")) * per.get(d, 0)) for i, d in enumerate(names)), F.lit(0.0))
    best = seen.where(F.col("n") >= LEAST_ROWS).select("h", told.alias("told")).orderBy(F.desc("told"), "h").limit(min(FEATURES, total // 2 + 1)).collect()  # FEATURES rows
    place: dict[int, int] = {}
    for r in best:  # of words that share a slot the one that tells more
        place.setdefault(r["h"] & (SLOTS - 1), r["h"])
    chosen = sorted(place.values())
    sample = rows.select("domain", held.alias("held"), _hits(F.col("h"), tuple(chosen)).alias("hits")).collect()  # about max_labelled rows
    code = {d: i for i, d in enumerate(names)}

    def packed(held: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = sorted((code[r["domain"]], r["hits"]) for r in sample if r["held"] == held)
        each = np.array([len(hits) for _, hits in some], int)
        return np.repeat(np.arange(len(some)), each), np.array([p - 2 for _, hits in some for p in hits], int), np.array([y for y, _ in some], int)

    at, of, y = packed(False)
    w, bias = softmax_regression(at, of, y, len(chosen), len(names))
    scale = _scale(*packed(True), w, bias)
    return Mixer(names, tuple(chosen), tuple(map(tuple, (w.T * scale).tolist())), tuple((bias * scale).tolist()))


def _hits(h: Column, words: tuple[int, ...]) -> Column:
    """Places of the known words among the hashes, each once: 2 is the first."""
    slots = [1] * SLOTS
    for i, x in enumerate(words):
        slots[x & (SLOTS - 1)] = i + 2
    table, known = _literal(slots, "int"), _literal(words, "bigint") if words else F.array().cast("array<bigint>")
    # Known words are found by compiled code; the place of each, which is slower, is looked up for them alone.
    return F.transform(F.array_intersect(h, known), lambda x: F.element_at(table, (x.bitwiseAND(SLOTS - 1) + 1).cast("int")))


def scored(docs: DataFrame, mixer: Mixer, text_col: str, into: str) -> DataFrame:
    """All columns and a struct (tokens, p): words, and hundredths by domain that sum to 100."""
    stage, k = own_name(docs, "__stage"), len(mixer.domains)
    words, hashes = _features(column(docs, text_col).cast("string"))
    out = docs.withColumn(stage, F.struct(words.alias("w")))
    out = out.withColumn(stage, F.struct(F.size(F.col(stage)["w"]).cast("long").alias("tokens"), hashes(F.col(stage)["w"]).alias("h")))
    x = F.col(stage)
    keep = x["tokens"].alias("tokens")
    out = out.withColumn(stage, F.struct(keep, _hits(x["h"], mixer.words).alias("hits")))
    score = lambda bias, w: F.aggregate(x["hits"], F.lit(bias), lambda s, p: s + F.element_at(_literal([0, *w], "double"), p))
    scores = F.array(*(score(b, [f"{v:.9g}" for v in w]) for b, w in zip(mixer.bias, mixer.weights, strict=True)))
    out = out.withColumn(stage, F.struct(keep, scores.alias("s")))
    out = out.withColumn(stage, F.struct(keep, F.transform(x["s"], lambda s: F.exp(s - F.array_max(x["s"]))).alias("e")))
    share = F.aggregate(x["e"], F.lit(0.0), lambda s, v: s + v)
    out = out.withColumn(stage, F.struct(keep, F.transform(x["e"], lambda v: 100 * v / share).alias("q")))
    # The places left by rounding down go to the largest remainders, the first of equal ones.
    rest = F.lit(100) - sum((F.floor(x["q"][i]) for i in range(k)), F.lit(0))
    over = [x["q"][i] - F.floor(x["q"][i]) for i in range(k)]
    before = lambda i: sum(((over[j] > over[i]) if j > i else (over[j] >= over[i])).cast("int") for j in range(k) if j != i) if k > 1 else F.lit(0)
    p = F.array(*((F.floor(x["q"][i]) + (before(i) < rest).cast("int")).cast("int") for i in range(k)))
    return out.withColumn(stage, F.struct(keep, p.alias("p"))).withColumnRenamed(stage, into)


def rate(mixer: Mixer, p: Column) -> Column:
    """The fitted rate: the gradient steps applied to one, projected each time to 0 up to ``most``."""
    if not mixer.steps:
        return F.lit(1.0)
    steps = F.from_json(F.lit("[" + ",".join("[" + ",".join(repr(v) for v in s) + "]" for s in mixer.steps) + "]"), "array<array<double>>")
    slope = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a / 100 * b), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(steps, F.lit(1.0), lambda r, g: F.least(F.lit(mixer.most), F.greatest(F.lit(0.0), r - slope(g))))


def goals(have: list[float], names: tuple[str, ...], targets: dict[str, float], budget: str = "total", growth: float = 1.0, at_most: tuple[str, ...] = ()) -> list[float]:
    """The tokens that each domain should have.

    Targets are shares of the mix, whatever they sum to.  ``budget`` sets its
    tokens in all: ``total`` as many as there are, the name of a domain so many
    that this domain's expected tokens stay, times ``growth``.  Domains named in
    ``at_most`` never get more than they have, so what is scarce and unwanted is
    not repeated to fill its share.
    """
    want = [targets.get(n, 0.0) / sum(targets.values()) for n in names]
    total = sum(have)
    if budget in names and have[names.index(budget)] > 0 and want[names.index(budget)] > 0:
        total = have[names.index(budget)] / want[names.index(budget)]
    return [min(w * total * growth, h) if n in at_most else w * total * growth for n, h, w in zip(names, have, want, strict=True)]


def fit_rates(cells: DataFrame, mixer: Mixer, targets: dict[str, float], *, budget: str = "total", growth: float = 1.0, at_most: tuple[str, ...] = (), rounds: int = 60, near: float = 1e-4) -> Mixer:
    """Projected gradient on ``cells`` (p, tokens), the sums by posterior.

    The squares are weighted by the inverse of the domains' Gram matrix, under
    which a step of one is the longest that is safe and meets the targets at
    once where no rate is projected.  Rounds end when every total is within
    ``near`` of its target.  A domain without tokens is left out.
    """
    names = mixer.domains
    k, at = len(names), lambda i: F.col("p")[i] / 100
    sums = cells.agg(*(F.sum(F.col("tokens") * at(i)).alias(f"n{i}") for i in range(k)), *(F.sum(F.col("tokens") * at(i) * at(j)).alias(f"g{i}_{j}") for i in range(k) for j in range(k))).first()
    have = [float(sums[f"n{i}"] or 0) for i in range(k)]
    if not sum(have):
        return mixer
    goal = np.array(goals(have, names, targets, budget, growth, at_most))
    met = np.array([h > 0 for h in have])
    gram = np.array([[float(sums[f"g{i}_{j}"] or 0) for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(gram * np.outer(met, met), rcond=1e-9, hermitian=True)
    steps: list[tuple[float, ...]] = []
    for _ in range(rounds):
        now = replace(mixer, steps=tuple(steps))
        got = cells.select("tokens", "p", rate(now, F.col("p")).alias("r")).agg(*(F.sum(F.col("tokens") * at(i) * F.col("r")).alias(f"n{i}") for i in range(k))).first()
        off = np.array([float(got[f"n{i}"]) for i in range(k)]) - goal
        if np.all(np.abs(off[met]) <= near * np.maximum(goal[met], near * sum(have))):
            break
        steps.append(tuple((inverse @ np.where(met, off, 0)).tolist()))
    return replace(mixer, steps=tuple(steps))


def copies(r: Column, key: Column, draw: int = 0) -> Column:
    """Whole copies: the rate rounded up or down by the row's draw, right on average."""
    u = F.pmod(F.xxhash64(key, F.lit(draw)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(r) + (u < r - F.floor(r)).cast("int")).cast("long")


def best_draw(rows: DataFrame, mixer: Mixer) -> Mixer:
    """The draw whose domain totals are closest to those of the rates."""
    k = len(mixer.domains)
    each = rows.select("tokens", "p", "key", rate(mixer, F.col("p")).alias("r"))
    weigh = lambda n, i: F.sum(F.col("tokens") * F.col("p")[i] / 100 * n)
    got = each.agg(*(weigh(F.col("r"), i).alias(f"r{i}") for i in range(k)), *(weigh(copies(F.col("r"), F.col("key"), d), i).alias(f"d{d}_{i}") for d in range(DRAWS) for i in range(k))).first()
    off = lambda d: max(abs((got[f"d{d}_{i}"] or 0) - got[f"r{i}"]) / got[f"r{i}"] for i in range(k) if got[f"r{i}"])
    return replace(mixer, draw=min(range(DRAWS), key=off)) if any(got[f"r{i}"] for i in range(k)) else mixer


def fit(docs: DataFrame, domains: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", *, max_labelled: int = MAX_LABELLED, **goal: object) -> tuple[Mixer, DataFrame]:
    """The mixing and the table (id, tokens, p, key) of all rows.

    ``domains`` holds (id, domain); ``goal`` is as in ``goals``.  Null and empty texts have no tokens and
    the posterior of the biases; repeated rows and null ids are mixed like
    others, equal rows by equal copies; without documents or labels all
    domains are alike.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    mixer = fit_classifier(rows, domains, tuple(sorted(targets)), scratch, max_labelled)
    rows = scored(rows, mixer, "text", "x").select("id", "x.tokens", "x.p", F.xxhash64("id", "text").alias("key"))
    rows = scratch.table(rows, "posteriors")
    cells = rows.groupBy("p").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    # Three domains have at most 5151 posteriors; only many domains need more than one task.
    cells = scratch.table(cells.coalesce(1) if math.comb(99 + len(targets), 100) <= BROADCAST_ROWS else cells, "cells")
    return best_draw(rows, fit_rates(cells, mixer, targets, **goal)), rows


def mixed(docs: DataFrame, domains: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """The mixed documents: every row as often as its copies, columns unchanged."""
    mixer, _ = fit(docs, domains, targets, id_col, text_col, **how)
    name = own_name(docs, "__mix")
    out = scored(docs, mixer, text_col, name)
    key = F.xxhash64(column(docs, id_col), column(docs, text_col).cast("string"))
    n = copies(rate(mixer, F.col(name)["p"]), key, mixer.draw)
    return out.withColumn(name, F.explode(F.array_repeat(F.lit(0), n.cast("int")))).drop(name)


def report(docs: DataFrame, domains: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """(id, tokens, p_<domain>..., rate, copies) of each row."""
    mixer, rows = fit(docs, domains, targets, id_col, text_col, **how)
    out = rows.withColumn("rate", rate(mixer, F.col("p")))
    shares = [(F.col("p")[i] / 100).alias(f"p_{n}") for i, n in enumerate(mixer.domains)]
    return out.select(F.col("id").alias(id_col), "tokens", *shares, "rate", copies(F.col("rate"), F.col("key"), mixer.draw).alias("copies"))
