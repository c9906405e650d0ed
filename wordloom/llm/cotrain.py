"""Quality classifier by co-training of a text view and a page view.

The text view sees the hashed words of a whole text, the page view its
metadata: language, source, size and layout.  Each round both are trained, and
each hands the unlabelled texts it is surest of, with its verdict, to the
other.  All unlabelled texts are scored in every round where they lie, and only
the sums of the sure ones' words by label, with a bound of their curvature, come to
the driver, which fits them together with the labelled rows.  Both views are calibrated on labels that no round has seen, and so is
their sum, which scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import Scratch, column, small

#: The classifiers are fitted on at most about so many labelled rows, drawn one by
#: one, and on all unlabelled ones.
MAX_LABELLED = 6000
WORDS_DIM, PAGE_DIM = 1 << 13, 1 << 9
ROUNDS, SHARE = 4, 0.1
WORDS_KEPT = 400_000
#: Scores are counted by steps of one over this, up to FAR either way.
STEPS, FAR = 64, 40


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) % WORDS_DIM
        return value


def text_view(text: str | None, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and their counts; no words, no entries."""
    parts = (text or "").encode("utf-8", "surrogatepass").split()
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(np.fromiter(map(known.__getitem__, parts), np.int64, len(parts)), return_counts=True)


def page_view(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Hashed places of the page's metadata, each number by its step."""
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    lines = raw.split(b"\n")
    share = lambda chars: (n - len(raw.translate(None, chars))) / n
    facts = {
        "size": min(12, int(np.log2(n))),
        "lines": min(10, int(np.log2(len(lines)))),
        "line": min(12, int(np.log2(1 + n / len(lines)))),
        "same": int(8 * (1 - len(set(lines)) / len(lines))),
        "marks": min(9, int(60 * share(b"#*$%&|<>{}[]~^=_@\\"))),
        "capitals": min(9, int(30 * share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))),
        "digits": min(9, int(40 * share(b"0123456789"))),
        "stops": min(9, int(100 * share(b".,;:"))),
        "calls": min(9, int(60 * share(b"!?"))),
        "blanks": min(9, int(30 * share(b" "))),
        "lang": lang,
        "source": source,
    }
    return np.array([xxhash.xxh3_64_intdigest(f"{k}={v}") % PAGE_DIM for k, v in facts.items()], np.int64)


class Rows:
    """Sparse rows: places, weights and the number of entries of each row."""

    def __init__(self, at: np.ndarray, w: np.ndarray, n: np.ndarray):
        self.at, self.w, self.n = at.astype(np.int64), w.astype(float), n
        self.row = np.repeat(np.arange(len(n)), n)

    def dot(self, theta: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.w * theta[self.at], len(self.n)) + theta[-1]

    def sums(self, by_row: np.ndarray, dim: int) -> np.ndarray:
        """The rows' sum, each times its number; the bias comes last."""
        return np.append(np.bincount(self.at, self.w * by_row[self.row], dim), by_row.sum())

    def take(self, rows: np.ndarray) -> Rows:
        """The rows marked true."""
        own = rows[self.row]
        return Rows(self.at[own], self.w[own], self.n[rows])


def views_of(batch: pd.DataFrame) -> tuple[Rows, Rows]:
    """Both views of packed rows; a text's weights have length eight."""
    unpack = lambda c, kind: np.frombuffer(b"".join(batch[c]), kind)
    size = lambda c: batch[c].map(len).to_numpy(np.int64) // 2
    text = Rows(unpack("a", np.uint16), np.log1p(unpack("n", np.uint32)), size("a"))
    text.w *= (8 / np.sqrt(np.bincount(text.row, text.w**2, len(text.n)).clip(1e-9)))[text.row]
    page = unpack("p", np.uint16)
    return text, Rows(page, np.ones(len(page)), size("p"))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: Rows, y: np.ndarray, dim: int, pool: Pool | None = None, steps: int = 120, ridge: float = 1e-3) -> np.ndarray:
    """Weights and bias by adaptive full gradients.

    The pool's loss is its quadratic upper bound about no weights, which takes
    its words' sums by label, and counts at most as much as the labelled rows.
    """
    theta, grown = np.zeros(dim + 1), np.full(dim + 1, 1e-8)
    share = min(1.0, len(y) / pool.n) if pool and pool.n else 0.0
    for _ in range(steps if len(y) else 0):
        g = x.sums(_sigmoid(x.dot(theta)) - y, dim)
        if share:
            g += share * (pool.slope + pool.curve * theta)
        g = g / (len(y) + share * (pool.n if pool else 0)) + ridge * theta
        grown += g * g
        theta -= 0.3 * g / np.sqrt(grown)
    return theta


@dataclass
class Pool:
    """Sums over a view's pseudo-labelled rows: gradient and curvature bound."""

    slope: np.ndarray
    curve: np.ndarray
    n: float


def pseudo_labels(views: tuple[Rows, Rows], past: list) -> list[np.ndarray]:
    """The label each view got from the other in the rounds past, else -1."""
    own = [np.full(len(x.n), -1) for x in views]
    for thetas, cuts in past:
        for k, x in enumerate(views):
            z, free = x.dot(thetas[k]), own[1 - k] < 0
            own[1 - k][free & (z >= cuts[k][1])] = 1
            own[1 - k][free & (z < cuts[k][0])] = 0
    return own


def surest(counts: np.ndarray, good: int, bad: int) -> tuple[float, float]:
    """Scores below and from which about so many rows are surely bad or good.

    ``counts`` has the rows of each step of scores; a step is taken whole.
    """
    above, below = np.cumsum(counts[::-1])[::-1], np.cumsum(counts)
    edge = np.arange(len(counts)) / STEPS - FAR
    high = edge[max(0, int((above >= good).sum()) - 1)] if good else FAR + 1
    low = edge[min(len(edge) - 1, int((below < bad).sum()))] + 1 / STEPS if bad else -FAR - 1
    return min(-1.0, low), max(1.0, high)


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift; the identity without both classes."""
    if len(y) < 10 or y.min() == y.max():
        return 1.0, 0.0
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = _sigmoid(a * z + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - goal) * z).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(a), float(b)


DIMS = (WORDS_DIM, PAGE_DIM)


def cotrain(labelled: pd.DataFrame, pool: DataFrame, rounds: int = ROUNDS, share: float = SHARE) -> dict:
    """Both views' weights and calibrations.

    Both tables hold packed rows.  The labelled rows whose ``u`` is 0 are kept
    for calibration.  In a round a view gives about ``share`` of the pool, in
    the classes' proportion.
    """
    views, y, held = views_of(labelled), labelled["y"].to_numpy(), labelled["u"].to_numpy() == 0
    known, goal = [x.take(~held) for x in views], y[~held]
    n = int(share * pool.count())
    part = round(n * float(y.mean()))
    pools: list[Pool | None] = [None, None]
    past: list = []
    for turn in range(rounds + 1):
        thetas = [logistic(x, goal, dim, p) for x, dim, p in zip(known, DIMS, pools, strict=True)]
        if turn == rounds or not n:
            break

        def count(batches: Iterator[pd.DataFrame], thetas: list = thetas, past: list = tuple(past)) -> Iterator[pd.DataFrame]:
            sums = np.zeros((2, 2 * FAR * STEPS), np.int64)
            for batch in batches:
                both = views_of(batch)
                own = pseudo_labels(both, past)
                for k, x in enumerate(both):
                    z = x.dot(thetas[k])[own[1 - k] < 0]
                    sums[k] += np.bincount(np.floor((z.clip(-FAR, FAR - 1e-9) + FAR) * STEPS).astype(int), minlength=2 * FAR * STEPS)
            k, at = np.nonzero(sums)
            yield pd.DataFrame({"k": k, "at": at, "n": sums[k, at]})

        counts = np.zeros((2, 2 * FAR * STEPS), np.int64)
        for r in pool.mapInPandas(count, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect():  # at most the steps
            counts[r["k"], r["at"]] = r["n"]
        past.append((thetas, [surest(c, part, n - part) for c in counts]))

        def slopes(batches: Iterator[pd.DataFrame], past: list = tuple(past)) -> Iterator[pd.DataFrame]:
            sums, seen = [np.zeros((2, d + 1)) for d in DIMS], [0, 0]
            for batch in batches:
                both = views_of(batch)
                for k, (x, own) in enumerate(zip(both, pseudo_labels(both, past), strict=True)):
                    x, own = x.take(own >= 0), own[own >= 0]
                    length = np.bincount(x.row, x.w, len(own)) + 1
                    sums[k] += x.sums(0.5 - own, DIMS[k]), x.sums(length / 4, DIMS[k])
                    seen[k] += len(own)
            for k, d in enumerate(DIMS):
                yield pd.DataFrame({"k": k, "at": np.arange(-1, d + 1), "g": np.append(seen[k], sums[k][0]), "h": np.append(seen[k], sums[k][1])})

        got = pool.mapInPandas(slopes, "k int, at int, g double, h double").groupBy("k", "at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas().sort_values("at")  # both DIMS
        for k in (0, 1):
            g, h = (got.loc[got["k"] == k, c].to_numpy() for c in "gh")
            pools[k] = Pool(g[1:], h[1:], g[0])
    z = [x.take(held).dot(t) for x, t in zip(views, thetas, strict=True)]
    scales = [calibrate(v, y[held]) for v in z]
    both = sum(a * v + b for (a, b), v in zip(scales, z, strict=True))
    return {"thetas": thetas, "scales": scales, "joint": calibrate(both, y[held])}


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, lang_col: str = "lang", source_col: str = "source", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, text_score, page_score, score, kept) of each row: chances of good.

    ``kept`` is a score of at least a half.  Null and empty texts are scored
    by their page alone; null metadata is a value of its own; repeated rows
    are scored each; labels repeated for an id count once, as good if any is;
    with no labels every score is a half; empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession, "cotrain")
    rows = docs.select(*(column(docs, c).cast(k).alias(n) for c, k, n in ((id_col, docs.schema[id_col].dataType.simpleString(), "id"), (text_col, "string", "text"), (lang_col, "string", "lang"), (source_col, "string", "source"))))
    known_labels = labels.where(F.col(label_col).isNotNull()).groupBy(column(labels, id_col).alias("id")).agg(F.max(label_col).alias("y"))
    total = known_labels.count()

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Buckets()
        for batch in batches:
            words = [text_view(t, known) for t in batch["text"]]
            page = [page_view(t, a, b) for t, a, b in zip(batch["text"], batch["lang"], batch["source"], strict=True)]
            yield pd.DataFrame({
                "id": batch["id"],
                "a": [a.astype(np.uint16).tobytes() for a, _ in words], "n": [n.astype(np.uint32).tobytes() for _, n in words],
                "p": [p.astype(np.uint16).tobytes() for p in page],
            })

    kind = rows.schema["id"].dataType.simpleString()
    packed = rows.mapInPandas(features, f"id {kind}, a binary, n binary, p binary").join(small(known_labels, total), "id", "left")
    packed = scratch.table(packed.select("id", "a", "n", "p", F.coalesce(F.col("y").cast("int"), F.lit(-1)).alias("y"), F.xxhash64(F.monotonically_increasing_id()).alias("u")), "packed")
    # Rows are drawn, not ids, so an id that many rows share is drawn like others.
    n = packed.where("y >= 0").count()
    drawn = F.pmod(F.shiftright("u", 8), F.lit(1_000_000)) < int(min(1.0, max_labelled / max(n, 1)) * 1_000_000)
    labelled = packed.where((F.col("y") >= 0) & drawn).select("y", F.pmod("u", F.lit(4)).cast("int").alias("u"), "a", "n", "p").toPandas()  # about max_labelled rows
    model = cotrain(labelled.sort_values(["y", "u", "p", "a"], kind="stable"), packed.where("y = -1").select("a", "n", "p")) if len(labelled) else None

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.iloc[lo : lo + 512]
                if model is None:
                    yield pd.DataFrame({"id": part["id"], "text_score": 0.5, "page_score": 0.5, "score": 0.5})
                    continue
                z = [a * x.dot(t) + b for x, t, (a, b) in zip(views_of(part), model["thetas"], model["scales"], strict=True)]
                a, b = model["joint"]
                yield pd.DataFrame({"id": part["id"], "text_score": _sigmoid(z[0]), "page_score": _sigmoid(z[1]), "score": _sigmoid(a * (z[0] + z[1]) + b)})

    out = packed.select("id", "a", "n", "p").mapInPandas(score, f"id {kind}, text_score double, page_score double, score double")
    return out.withColumn("kept", F.col("score") >= 0.5).withColumnRenamed("id", id_col)
