"""Vector functions, probing, clustering and embedding."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.config import Knobs
from wordloom.functions import vector as vf
from wordloom.operators import vectors as vx
from wordloom.sources.readers import HttpEmbedder

PHONE, LAPTOP, BANANA = [1.0, 0.0, 0.0, 0.0], [0.9, 0.1, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]


def test_functions(spark):
    a, b, z = (vx.literal_vector(v) for v in ([3, 4], [4, 3], [0, 0]))
    row = spark.range(1).select(vf.dot(a, b).alias("d"), vf.norm(a).alias("n"), vf.cosine(a, b).alias("c"), vf.cosine(a, z).alias("z"), vf.dot(a, vx.literal_vector([1])).alias("m"), vf.similarity_score(F.lit(-0.9999999)).alias("s")).first()
    assert (row["d"], row["n"], row["z"], row["m"], row["s"]) == (24.0, 5.0, 0.0, 0.0, -999999)
    assert row["c"] == pytest.approx(0.96)


def frame(spark, rows):
    return spark.createDataFrame([(i, n, v) for n, (i, v) in enumerate(rows)], "id string, ord int, vector array<double>")


def categories_of(spark, rows, **knobs):
    got = vx.cluster_incremental(frame(spark, rows), Knobs(**knobs)).collect()
    return {r["id"]: r["categories"] for r in got}


def test_clusters_share_and_part(spark):
    got = categories_of(spark, [("phone", PHONE), ("laptop", LAPTOP), ("banana", BANANA)])
    assert got["phone"] == got["laptop"] != got["banana"]


def test_overlap_and_cap(spark):
    axes = [("phone", PHONE), ("tablet", [0.0, 1.0, 0.0, 0.0]), ("banana", BANANA)]
    both = [*axes, ("hybrid", [0.75, 0.65, 0.2, 0.0])]
    assert categories_of(spark, both)["hybrid"] == ["cat-1", "cat-2"]
    assert categories_of(spark, both, ai_max_categories_per_doc=1)["hybrid"] == ["cat-1"]
    capped = categories_of(spark, [*axes[:2], ("drone", [0.5, 0.1, 0.85, 0.0])], ai_max_categories=2)
    assert capped["drone"] == ["cat-1"]


def test_removal_is_exact():
    c = vx.Clusters()
    c.add("phone", PHONE)
    c.add("laptop", LAPTOP)
    assert np.allclose(c.sums[0], [1.9, 0.1, 0, 0]) and c.counts == [2]
    assert c.remove("laptop") and not c.remove("laptop")
    assert np.allclose(c.sums[0], PHONE) and c.counts == [1]
    with pytest.raises(ValueError):
        c.add("zero", [0, 0, 0, 0])


def test_probe_filter_and_hybrid(spark):
    rows = spark.createDataFrame([("p", "a", PHONE), ("l", "a", LAPTOP), ("b", "b", BANANA), ("n", "c", [-1.0, 0.0, 0.0, 0.0])], "id string, name string, vector array<double>")
    cats = vx.categories(rows)
    probe = [0.9, 0.3, 0.3, 0.0]
    assert [r["id"] for r in vx.probe_topk(rows, cats, probe, 5, n=1).orderBy("rank").collect()] == ["l", "p"]
    only = spark.createDataFrame([("b",)], "id string")
    assert [r["id"] for r in vx.cosine_topk(rows.select("id", "vector"), probe, 5, only).collect()] == ["b"]
    assert vx.cosine_topk(rows.select("id", "vector").where("id = 'n'"), PHONE, 5).count() == 0
    classic = spark.createDataFrame([(1, "p", 5)], "rank int, id string, score long")
    both = vx.hybrid(classic, vx.cosine_topk(rows.select("id", "vector"), PHONE, 2))
    assert [(r["part"], r["id"], r["ai"]) for r in both.orderBy("part", "rank").collect()] == [(0, "p", False), (1, "p", True), (1, "l", True)]


def test_centroid_sum(spark):
    rows = spark.createDataFrame([("a", PHONE), ("a", LAPTOP)], "name string, vector array<double>")
    got = vx.categories(rows).first()
    assert got["centroid"] == pytest.approx([1.9, 0.1, 0, 0]) and got["count"] == 2


def test_embed_in_batches(spark):
    docs = spark.createDataFrame([("1", "aa"), ("2", "b")], "id string, text string")
    got = vx.embed(docs, "text", lambda texts: [[len(t), 1.0] for t in texts]).collect()
    assert {r["id"]: r["vector"] for r in got} == {"1": [2.0, 1.0], "2": [1.0, 1.0]}


class Answers:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, asked, timeout):
        self.asked.append((asked, timeout))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return io.BytesIO(json.dumps(answer).encode())


def test_embedder_tries_again():
    good = {"data": [{"index": 0, "embedding": [1.0, 2.0]}]}
    opener = Answers(OSError("down"), {"data": []}, good)
    client = HttpEmbedder("http://x/", "m", "k", waits=(0, 0), opener=opener)
    assert client(["text"]) == [[1.0, 2.0]]
    asked, timeout = opener.asked[0]
    assert asked.full_url == "http://x/embeddings" and asked.headers["Authorization"] == "Bearer k" and timeout == 60
    with pytest.raises(OSError):
        HttpEmbedder("http://x", "m", waits=(0,), opener=Answers(OSError(), OSError()))(["t"])
