"""MinHash near-duplicates of texts with sequential Bayesian verification.

A text's set holds the hashes of its distinct word shingles.  Equal sets form
one class, so exact copies never meet again.  Classes get MinHash signatures,
bands of them give buckets.  A bucket's pivot is its least class; the buckets
with one pivot form a gathering.

1. Every class of a gathering is compared with the pivot.
2. Classes of a gathering that are still in different components are compared
   with each other, block by block, so no task holds a gathering, none is
   capped, and only links that join components are given out.

Each candidate pair is read in batches of the signature and dropped once the
posterior chance of a similarity at the threshold falls under ``miss``;
survivors are verified on the whole sets.  Pairs inside a component are never
expanded, and every pair that shares a bucket is covered.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import Scratch, column, own_name, small
from wordloom.llm.components import connected_components

BANDS, ROWS, BATCH = 32, 5, 32
HASHES = BANDS * ROWS
BLOCK, BLOCK_BYTES = 256, 8 << 20
WORDS_KEPT = 400_000


class _Words(dict):
    """Word hashes by word; emptied when full, which costs time only."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def shingle_set(text: str | None, words: dict, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text.

    A to Z count as a to z.  A text of fewer words than a shingle has its whole
    sequence as one; null, empty and blank texts have none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    draw = lambda: rng.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64)
    return (draw() << np.uint64(1)) | np.uint64(1), draw()


def signature(z: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The low 16 bits of each of the minima, in pieces so memory is bounded."""
    a, b = family
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(z), 4096):
        np.minimum(low, ((z[None, at : at + 4096] * a + b) >> np.uint64(24)).min(axis=1), out=low)
    return low.astype("<u2").tobytes()


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """For each batch end n: the fewest equal hashes that keep a pair.

    With a uniform prior the posterior of the similarity after m of n matches
    is Beta(m + 1, n - m + 1); its upper tail at t equals P(Bin(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append((n, m))
    return out


def _surviving(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows a[p], b[q] no batch prunes, and their matches."""
    live, got, at = np.arange(len(p)), np.zeros(len(p), np.int32), 0
    for n, least in bounds:
        got[live] += (a[p[live], at:n] == b[q[live], at:n]).sum(axis=1)
        live, at = live[got[live] >= least], n
    return live, got


def _signatures(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u2").reshape(len(values), HASHES)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, hash, cls, n, sig) of each row; cls and sig are null for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, family = _Words(), _family()
        for batch in batches:
            n, cls, sig = [], [], []
            for text in batch["text"]:
                z = shingle_set(text, words, size)
                n.append(len(z))
                cls.append(hashlib.blake2b(z.tobytes(), digest_size=16).digest() if len(z) else None)
                sig.append(signature(z, family) if len(z) else None)
            yield pd.DataFrame({"id": batch["id"], "hash": batch["hash"], "cls": cls, "n": n, "sig": sig})

    text = column(docs, text_col).cast("string")
    rows = docs.select(column(docs, id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    return rows.mapInPandas(run, "id long, hash long, cls binary, n long, sig binary")


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, nodes: DataFrame) -> DataFrame:
    """(nid, z) for the given classes, computed anew from their whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for batch in batches:
            z = [shingle_set(text, words, size).tobytes() for text in batch["text"]]
            yield pd.DataFrame({"cls": [hashlib.blake2b(x, digest_size=16).digest() for x in z], "z": z})

    wanted = nodes.select(F.col("rep").alias("id")).distinct()
    rows = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text"))
    rows = rows.join(small(wanted, nodes.count()), rows["id"].eqNullSafe(wanted["id"]), "left_semi")
    found = rows.mapInPandas(run, "cls binary, z binary").dropDuplicates(["cls"])
    return found.join(nodes.select("nid", "cls"), "cls").select("nid", "z")


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, bounds: list, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""

    @F.pandas_udf("boolean")
    def kept(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        if len(a):
            rows = np.arange(len(a))
            out[_surviving(_signatures(a), _signatures(b), rows, rows, bounds)[0]] = True
        return pd.Series(out)

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = 0
            if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both) and both > 0)
        return pd.Series(out, dtype=bool)

    sig = lambda c: nodes.select(F.col("nid").alias(c), F.col("sig").alias(f"sig_{c}"))
    z = lambda c: sets.select(F.col("nid").alias(c), F.col("z").alias(f"z_{c}"))
    near = pairs.join(sig("a"), "a").join(sig("b"), "b").where(kept("sig_a", "sig_b")).select("a", "b")
    return near.join(z("a"), "a").join(z("b"), "b").where(linked("z_a", "z_b")).select("a", "b")


def _shared(g: dict, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets p with the sets q, pair by pair.

    Many pairs go through products of incidence matrices, a bounded piece of
    the hashes that several sets share at a time.
    """
    if len(p) <= 64:
        return np.array([len(np.intersect1d(g["z"][i], g["z"][j], assume_unique=True)) for i, j in zip(p, q, strict=True)], np.int64)
    rows, cols = np.unique(p), np.unique(q)
    used = np.union1d(rows, cols)
    owner = np.repeat(used, [len(g["z"][i]) for i in used])
    _, at, n = np.unique(np.concatenate([g["z"][i] for i in used]), return_inverse=True, return_counts=True)
    owner, at = owner[n[at] > 1], at[n[at] > 1]
    place = np.full(len(g["z"]), -1)
    place[used] = np.arange(len(used))
    both = np.zeros((len(rows), len(cols)), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], np.unique(at[order], return_inverse=True)[1]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        i, j = np.searchsorted(at, (lo, lo + 4096))
        part = np.zeros((len(used), 4096), np.float32)
        part[place[owner[i:j]], at[i:j] - lo] = 1
        both += part[place[rows]] @ part[place[cols]].T
    return both[np.searchsorted(rows, p), np.searchsorted(cols, q)].astype(np.int64)


def _joined(g: dict, bounds: list, percent: int) -> list[tuple[int, int]]:
    """Links that join components, of strangers (side 0) and members (side 1).

    Two strangers meet on both sides and are compared once.  Unpruned pairs of different components are verified on their whole sets;
    of those that link, a forest over the components is enough.
    """
    i, j = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
    top = {c: c for c in np.unique(g["comp"]).tolist()}
    size = np.array([len(z) for z in g["z"]])
    out = []

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    step = max(1, 100_000 // max(1, len(j)))
    for at in range(0, len(i), step):
        p, q = (v.ravel() for v in np.meshgrid(i[at : at + step], j, indexing="ij"))
        odd = (g["comp"][p] != g["comp"][q]) & ((g["nid"][p] < g["nid"][q]) | ~g["odd"][q])
        odd &= 100 * np.minimum(size[p], size[q]) >= percent * np.maximum(size[p], size[q])
        p, q = p[odd], q[odd]
        live, _ = _surviving(g["sig"], g["sig"], p, q, bounds)
        apart = [k for k in live if find(int(g["comp"][p[k]])) != find(int(g["comp"][q[k]]))]
        p, q = p[apart], q[apart]
        both = _shared(g, p, q)
        for k in np.flatnonzero(100 * both >= percent * (size[p] + size[q] - both)):
            u, v = find(int(g["comp"][p[k]])), find(int(g["comp"][q[k]]))
            if u != v:
                top[u] = v
                out.append((int(g["nid"][p[k]]), int(g["nid"][q[k]])))
    return out


def _mates(rows: DataFrame, bounds: list, percent: int) -> DataFrame:
    """(a, b): verified links between components, from each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame:
            g = pd.concat(held)
            block = {c: g[c].to_numpy() for c in ("nid", "comp", "side", "odd")}
            block |= {"sig": _signatures(g["sig"]), "z": [np.frombuffer(z, np.uint64) for z in g["z"]]}
            return pd.DataFrame(_joined(block, bounds, percent), columns=["a", "b"], dtype=np.int64)

        last = None
        for batch in batches:
            key = (batch["pivot"].to_numpy(), batch["bi"].to_numpy(), batch["bj"].to_numpy())
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1 if len(batch) else []
            for lo, hi in zip([0, *cut], [*cut, len(batch)], strict=True):
                if lo == hi:
                    continue
                now = tuple(k[lo] for k in key)
                if held and now != last:
                    yield flush()
                    held = []
                last = now
                held.append(batch.iloc[lo:hi])
        if held:
            yield flush()

    dealt = rows.repartition("pivot", "bi", "bj").sortWithinPartitions("pivot", "bi", "bj")
    return dealt.mapInPandas(run, "a long, b long")


def _blocks(members: DataFrame, comp: DataFrame, nodes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of gatherings that still hold two components, dealt to block pairs.

    Strangers, whose component is not the pivot's, are one side and all members
    the other, so a few strangers in a large gathering cost a few copies of it.
    Blocks are bounded by their sets' bytes as well.
    """
    known = members.join(comp.withColumnRenamed("id", "nid"), "nid", "left").join(nodes.select("nid", (8 * F.col("n")).alias("bytes")), "nid")
    known = scratch.table(known.select("pivot", "nid", "bytes", F.coalesce("root", "nid").alias("comp")), "known")
    blocks = lambda *names: [F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias(names[0])]
    main = F.max(F.when(F.col("nid") == F.col("pivot"), F.col("comp"))).alias("main")
    mixed = known.groupBy("pivot").agg(*blocks("n"), main, F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi and c > 2").select("pivot", "n", "main")
    mixed = scratch.table(mixed, "mixed")
    rows = known.join(small(mixed, mixed.count()), "pivot").withColumn("odd", F.col("comp") != F.col("main"))
    strange = scratch.table(rows.where("odd").groupBy("pivot").agg(*blocks("s")), "strange")
    rows = rows.join(small(strange, strange.count()), "pivot").join(nodes.select("nid", "sig"), "nid").join(sets, "nid")
    own = lambda n: F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ("nid", "comp", "odd", "sig", "z")
    left = rows.where("odd").select("pivot", own("s").alias("bi"), every("n").alias("bj"), *keep, F.lit(0).alias("side"))
    right = rows.select("pivot", every("s").alias("bi"), own("n").alias("bj"), *keep, F.lit(1).alias("side"))
    return left.union(right)


def _groups(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, shingle: int, percent: int, miss: float) -> DataFrame:
    """(id, hash of the text, n, top, kept) of each row; top is the least id of the group."""
    bounds = least_matches(percent / 100, miss)
    prints = scratch.table(fingerprints(docs, id_col, text_col, shingle), "prints")
    classes = prints.where("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    nodes = scratch.table(classes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = nodes.select("nid", F.explode(keys).alias("bkey"))
    buckets = bands.groupBy("bkey").agg(F.count("*").alias("c"), F.min("nid").alias("pivot")).where("c > 1")
    buckets = scratch.table(buckets.select("bkey", "pivot"), "buckets")
    members = scratch.table(bands.join(buckets, "bkey").select("pivot", "nid").distinct(), "members")
    involved = scratch.table(nodes.join(members.select("nid").distinct(), "nid", "left_semi"), "involved")
    sets = scratch.table(_sets(docs, id_col, text_col, shingle, involved), "sets")

    star = members.where("nid <> pivot").select(F.col("pivot").alias("a"), F.col("nid").alias("b"))
    edges = scratch.table(_verified(star, involved, sets, bounds, percent), "links")
    comp = connected_components(edges, scratch)
    more = scratch.table(_mates(_blocks(members, comp, involved, sets, scratch), bounds, percent), "links")
    comp = connected_components(edges.union(more), scratch)
    least = comp.join(nodes.select(F.col("nid").alias("id"), "rep"), "id").groupBy("root").agg(F.min("rep").alias("least"))
    least = scratch.table(least, "least")
    placed = comp.join(small(least, least.count()), "root").select(F.col("id").alias("nid"), "least")
    place = nodes.join(placed, "nid", "left").select("cls", F.coalesce("least", "rep").alias("least"))
    place = scratch.table(place, "place")
    scratch.drop(members, sets, involved)
    out = prints.select("id", "hash", "cls", "n").join(place, "cls", "left")
    top = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select("id", "hash", "n", top.alias("top"), F.col("id").eqNullSafe(top).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """Each row's near-duplicate group: (id, n_shingles, component_id, kept).

    Texts link when 100 * |intersection| >= percent * |union| of their shingle
    sets; groups are the connected components.  ``component_id`` is the least
    id of the group, ``kept`` marks it.  Defined cases: rows without words are
    groups of their own; repeated rows and ids stay rows of the result; null
    ids link like others and are the least of a group only if all are null;
    empty tables give no rows; other columns are not read.  ``miss`` is the
    chance at which a pair at the threshold may be pruned by its signature.
    """
    groups = _groups(docs, Scratch(docs.sparkSession, "neardup"), id_col, text_col, shingle, percent, miss)
    return groups.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("top").alias("component_id"), "kept")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """One row of each group, all columns unchanged.

    The row with the group's least id stays.  Rows that repeat both id and
    text are one; those that share the least id with other texts all stay, and
    so do rows without an id in groups that have none.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    groups = scratch.table(_groups(docs, scratch, id_col, text_col, shingle, percent, miss), "groups")
    names = own_name(docs, "__id"), own_name(docs, "__hash")
    key = [F.col("id").alias(names[0]), F.col("hash").alias(names[1])]
    bad = groups.where(~F.col("kept")).select(*key).distinct()
    again = groups.where("kept").groupBy("id", "hash").count().where("count > 1").select(*key)
    on = column(docs, id_col).cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64(column(docs, text_col).cast("string")) == F.col(names[1]))
    out = docs.join(small(bad, bad.count()), on, "left_anti")
    n = again.count()
    if not n:
        return out
    once = out.join(small(again, n), on, "left_semi").dropDuplicates([id_col, text_col])
    return out.join(small(again, n), on, "left_anti").unionByName(once)
