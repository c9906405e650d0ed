"""Near-duplicate vectors by sign hashing in several tables.

Random hyperplanes give each vector a code per table; vectors that share a
code in a table are compared exactly, in double precision.  The number of bits
follows the number of vectors so buckets stay small, and the number of tables
follows from the bits and ``miss``, the chance that a pair at the threshold
meets in no table.  A pair counts in the first table where it meets, so links
are counted without listing pairs, and each bucket gives only the forest of
its links.  Large buckets are compared in pairs of blocks; none is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import Scratch, column, small
from wordloom.llm.components import connected_components

BLOCK = 512
#: Vectors in a bucket on average: larger buckets mean fewer tables, so less is
#: shuffled and more compared, which is cheap by blocks.
IN_BUCKET = 256


def shape(rows: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a code and number of tables for so many vectors."""
    bits = min(31, max(4, round(math.log2(max(rows, 1) / IN_BUCKET + 1))))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-(agree**bits))))


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _width(bits: int) -> int:
    """Bytes of a code."""
    return 2 if bits <= 16 else 4


def _codes(classes: DataFrame, dim: int, bits: int, tables: int, single: bool) -> DataFrame:
    """(cid, m, codes, v): a code for each table, and the vector in the precision it came in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(8).standard_normal((dim, bits * tables))
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                codes = ((_unit(v) @ planes >= 0).reshape(len(v), tables, bits) * weights).sum(axis=2).astype(f"<u{_width(bits)}")
                yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("m"), _binary(codes), _binary(v.astype("<f4" if single else "<f8"))], names=["cid", "m", "codes", "v"])

    return classes.where(F.size("v") == dim).select("cid", "m", "v").mapInArrow(run, "cid long, m long, codes binary, v binary")


def _links(rows: DataFrame, bits: int, single: bool, threshold: float) -> DataFrame:
    """(cid, links, root) from each bucket or pair of blocks with links."""

    def compared(t: int, cid: np.ndarray, m: np.ndarray, side: np.ndarray, codes: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...] | None:
        i, j = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        p, q = np.nonzero(v[i] @ v[j].T >= threshold)
        p, q = i[p], j[q]
        once = (side[p] != 2) | (p < q)
        p, q = p[once], q[once]
        if t and len(p):
            fresh = np.concatenate([~(codes[p[at : at + 65536], :t] == codes[q[at : at + 65536], :t]).any(axis=1) for at in range(0, len(p), 65536)])
            p, q = p[fresh], q[fresh]
        if not len(p):
            return None
        links = np.zeros(len(cid), np.int64)
        np.add.at(links, p, m[q])
        np.add.at(links, q, m[p])
        root = np.arange(len(cid))
        while True:
            least = root.copy()
            np.minimum.at(least, p, root[q])
            np.minimum.at(least, q, root[p])
            least = least[least]
            if (least == root).all():
                break
            root = least
        has = np.flatnonzero(links)
        return cid[has], links[has], cid[root[has]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("t", "code", "bi", "bj")
        held: list[pa.RecordBatch] = []
        last: tuple = ()

        def flush() -> pa.RecordBatch | None:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            get = lambda c: table.column(c).to_numpy(zero_copy_only=False)
            raw = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(table.num_rows, -1)
            if table.num_rows < 2:
                return None
            out = compared(last[0], get("cid"), get("m"), get("side"), raw("codes", f"<u{_width(bits)}"), _unit(raw("v", "<f4" if single else "<f8")))
            return out and pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["cid", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                now = tuple(int(k[lo]) for k in keys)
                if held and now != last:
                    if (out := flush()) is not None:
                        yield out
                    held.clear()
                last = now
                held.append(batch.slice(lo, hi - lo))
        if held and (out := flush()) is not None:
            yield out

    dealt = rows.repartition("t", "code", "bi", "bj").sortWithinPartitions("t", "code", "bi", "bj")
    return dealt.mapInArrow(run, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = 0.9, miss: float = 1e-4) -> DataFrame:
    """Each row's links and group: (id, n_links, component_id, kept).

    Vectors link when their cosine is at least ``threshold``; vectors of
    different lengths never do.  Null, empty and zero vectors, and those with
    a null or non-finite component, link with nothing.  Equal vectors form one
    class and count as links of each other; repeated rows are vectors of their
    own; null ids link like others.  Empty tables give no rows, other columns
    are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardup-vec")
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    v = column(vectors, vector_col).cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(column(vectors, id_col).cast("long").alias("id"), F.when(sound, v).alias("v"))
    rows = rows.select("id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("k1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("k2"))
    classes = rows.where("v is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v"))
    classes = scratch.table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    edges, links = None, None
    for dim, n in sorted((r["dim"], r["count"]) for r in classes.groupBy(F.size("v").alias("dim")).count().collect()):
        bits, tables = shape(n, threshold, miss)
        coded = scratch.table(_codes(classes, dim, bits, tables, single), "codes")
        each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.struct(t.alias("t"), F.xxhash64(t, F.substring("codes", t * _width(bits) + 1, F.lit(_width(bits)))).alias("code"))))
        spots = coded.select("cid", each.alias("x")).select("cid", "x.t", "x.code")
        hot = scratch.table(spots.groupBy("t", "code").count().where(F.col("count") > BLOCK), "hot")
        n_hot = hot.count()
        dealt = coded.select("cid", "m", "codes", "v", each.alias("x")).select("cid", "m", "codes", "v", "x.t", "x.code")
        dealt = dealt.join(small(hot, n_hot), ["t", "code"], "left") if n_hot else dealt.withColumn("count", F.lit(1))
        dealt = dealt.withColumn("n", F.ceil(F.coalesce("count", F.lit(1)) / BLOCK).cast("int")).drop("count")
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        dealt = dealt.select("t", "code", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "cid", "m", side.alias("side"), "codes", "v")
        found = scratch.table(_links(dealt, bits, single, threshold), "found")
        edges = found if edges is None else edges.union(found)
    if edges is None:
        edges = spark.createDataFrame([], "cid long, links long, root long")
    links = edges.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = connected_components(edges.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch)
    least = comp.join(classes.select(F.col("cid").alias("id"), "rep"), "id").groupBy("root").agg(F.min("rep").alias("least"))
    least = scratch.table(least, "least")
    least = small(least, least.count())  # a component's members need not meet in one task
    place = classes.select("k1", "k2", "cid", "rep", "m").join(links, "cid", "left").join(comp.withColumnRenamed("id", "cid"), "cid", "left").join(least, "root", "left")
    place = scratch.table(place.select("k1", "k2", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("least")), "place")
    out = rows.select("id", "k1", "k2").join(place, ["k1", "k2"], "left")
    top = F.when(F.col("k1").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), top.alias("component_id"), F.col("id").eqNullSafe(top).alias("kept"))
