"""Vector search: exact cosine, category probing, hybrid results, clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.config import Knobs
from wordloom.functions import vector as fn
from wordloom.ship import ship


def literal_vector(values: Sequence[float]):
    return F.array(*(F.lit(float(v)) for v in values))


def cosine_topk(vectors: DataFrame, query: Sequence[float], k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(rank, id, score) of the k most similar of (id, vector), similarity above zero.

    Filters act before the ranking; zero vectors and other lengths never match.
    """
    q = literal_vector(query)
    rows = vectors if allowed is None else vectors.join(allowed, "id", "left_semi")
    sim = fn.cosine(F.col("vector"), q)
    hits = rows.withColumn("sim", sim).where("sim > 0").withColumn("score", fn.similarity_score(F.col("sim")))
    top = hits.select("id", "score").orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("rank", "id", "score")


def centroids(members: DataFrame) -> DataFrame:
    """(name, pos, total, n) of (name, vector): the summed vector by position."""
    each = members.select("name", F.posexplode(F.col("vector").cast("array<double>")).alias("pos", "x"))
    return each.groupBy("name", "pos").agg(F.sum("x").alias("total"), F.count("*").alias("n"))


def subtract(sums: DataFrame, gone: DataFrame) -> DataFrame:
    """Centroid sums without those of removed members; categories left empty go."""
    less = gone.select("name", "pos", F.col("total").alias("less"), F.col("n").alias("fewer"))
    left = sums.join(less, ["name", "pos"], "left").select("name", "pos", (F.col("total") - F.coalesce("less", F.lit(0.0))).alias("total"), (F.col("n") - F.coalesce("fewer", F.lit(0))).alias("n"))
    return left.where("n > 0")


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no nulls, not all zero."""
    return F.coalesce(F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull()), F.lit(False))


def embedding_counts(vectors: DataFrame) -> DataFrame:
    """One row: vectors that can be clustered, and those that failed or have no direction."""
    return vectors.agg(F.count_if(usable(F.col("vector"))).alias("ok"), F.count_if(~usable(F.col("vector"))).alias("failed"))


def of_sums(sums: DataFrame) -> DataFrame:
    """(name, centroid, norm, count) of centroid sums by position."""
    sums = sums.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", "total"))).alias("c"), F.max("n").alias("count"))
    return sums.select("name", F.col("c.total").alias("centroid"), fn.norm(F.col("c.total")).alias("norm"), "count")


def categories(members: DataFrame) -> DataFrame:
    """(name, centroid, norm, count): categories whose members are gone have no row."""
    return of_sums(centroids(members))


def nearest_categories(cats: DataFrame, query: Sequence[float], n: int = Knobs.ai_search_top_n_categories) -> DataFrame:
    """Names of the n categories whose centroids are most similar to the query."""
    sim = fn.similarity_score(fn.cosine(F.col("centroid"), literal_vector(query), F.col("norm")))
    return cats.where("norm <> 0").withColumn("s", sim).orderBy(F.desc("s"), "name").limit(n).select("name")


def probe_topk(members: DataFrame, cats: DataFrame, query: Sequence[float], k: int, allowed: DataFrame | None = None, n: int = Knobs.ai_search_top_n_categories) -> DataFrame:
    """The k most similar members (name, id, vector) of the nearest categories."""
    probed = members.join(F.broadcast(nearest_categories(cats, query, n)), "name", "left_semi")
    return cosine_topk(probed.dropDuplicates(["id"]).select("id", "vector"), query, k, allowed)


def hybrid(classic: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """Text hits, then vector hits, neither merged nor ranked anew."""
    part = lambda df, n, ai: df.select(F.lit(n).alias("part"), "rank", "id", "score", F.lit(ai).alias("ai"))
    return part(classic, 0, False).unionByName(part(vector_hits, 1, True))


class Clusters:
    """Overlapping categories grown document by document.

    A vector joins every category at least ``threshold`` similar, the best
    first and at most ``per_doc``; with none it founds a new one, and once
    ``most`` exist it joins the nearest.  Ties go to the older category.
    """

    def __init__(self, threshold: float = 0.6, per_doc: int = 3, most: int = 100, members: bool = True):
        self.threshold, self.per_doc, self.most, self.keep = threshold, per_doc, most, members
        self.sums: list[np.ndarray] = []
        self.counts: list[int] = []
        self.member_of: dict[str, list[int]] = {}
        self.vectors: dict[str, np.ndarray] = {}

    def add(self, key: str, vector: Sequence[float]) -> list[int]:
        v = np.asarray(vector, np.float64)
        size = float(np.sqrt(v @ v))
        if size == 0:
            raise ValueError("a zero vector has no direction")
        self.remove(key)
        live = [i for i, n in enumerate(self.counts) if n > 0]
        sims = {i: float(self.sums[i] @ v) / (float(np.sqrt(self.sums[i] @ self.sums[i])) * size or 1.0) for i in live}
        order = sorted(live, key=lambda i: (-sims[i], i))
        chosen = [i for i in order if sims[i] >= self.threshold][: self.per_doc]
        if not chosen and len(live) >= self.most:
            chosen = order[:1]
        if not chosen:
            self.sums.append(np.zeros_like(v))
            self.counts.append(0)
            chosen = [len(self.counts) - 1]
        for i in chosen:
            self.sums[i] = self.sums[i] + v
            self.counts[i] += 1
        if self.keep:
            self.member_of[key], self.vectors[key] = chosen, v
        return chosen

    def remove(self, key: str) -> bool:
        """Exact: the vector leaves its sums, and empty categories are gone."""
        if key not in self.member_of:
            return False
        v = self.vectors.pop(key)
        for i in self.member_of.pop(key):
            self.sums[i] = self.sums[i] - v
            self.counts[i] -= 1
        return True


def cluster_incremental(vectors: DataFrame, knobs: Knobs = Knobs(), start: Sequence[tuple[str, Sequence[float], int]] = ()) -> DataFrame:
    """(id, categories) of (id, ord, vector), folded in the order of ``ord``.

    Each vector's place depends on all before it, so one task reads them in
    order, batch by batch; it holds the categories' sums alone, at most
    ``ai_max_categories``.  ``start`` names categories that exist with their
    sums and counts, so later vectors resume where a written fold ended.
    """

    ship(vectors.sparkSession)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clusters = Clusters(knobs.ai_category_threshold, knobs.ai_max_categories_per_doc, knobs.ai_max_categories, members=False)
        names = [name for name, _, _ in start]
        clusters.sums, clusters.counts = [np.asarray(total, np.float64) for _, total, _ in start], [n for _, _, n in start]
        after = max((int(n.rpartition("-")[2]) for n in names if n.rpartition("-")[2].isdigit()), default=0)
        for batch in batches:
            rows = []
            for k, v in zip(batch["id"], batch["vector"], strict=True):
                if v is not None and np.any(v):
                    chosen = clusters.add(k, v)
                    names += [f"cat-{after + i + 1 - len(start)}" for i in range(len(names), len(clusters.sums))]
                    rows.append((k, [names[i] for i in chosen]))
            yield pd.DataFrame(rows, columns=["id", "categories"])

    ordered = vectors.select("id", "ord", "vector").repartition(1).sortWithinPartitions("ord", "id").select("id", "vector")
    return ordered.mapInPandas(fold, "id string, categories array<string>")


def embed(docs: DataFrame, content: str, model: Callable[[list[str]], list[Sequence[float]]], batch: int = 256, tolerant: bool = False) -> DataFrame:
    """(id, vector) from a callable that turns texts into vectors, in batches.

    With ``tolerant`` a failed batch is asked for text by text, and a text that
    fails alone has a null vector; otherwise the failure is raised.
    """
    ship(docs.sparkSession)

    def asked(texts: list[str]) -> list[list[float] | None]:
        try:
            return [list(map(float, v)) for v in model(texts)]
        except Exception:  # any failure of the service counts against its texts alone
            if not tolerant:
                raise
            return [None] if len(texts) == 1 else [v for t in texts for v in asked([t])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), batch):
                some = part.iloc[lo : lo + batch]
                yield pd.DataFrame({"id": some["id"], "vector": asked(some["text"].tolist())})

    return docs.select("id", F.col(content).alias("text")).mapInPandas(run, "id string, vector array<float>")
