"""Masked pseudo-likelihood of texts by a bidirectional window network.

Every word is predicted from the two words on each side.  A word is a token and
its chance within the token.  The most frequent words have a token each, other
words share that of their last three letters, so their tongue and their
punctuation stay visible; within a token a word has the chance that the counts
of the whole corpus give it, and the table of these counts holds every distinct
word.  The network has a table for each side, one hidden layer and a soft
maximum in two steps, over groups of tokens and within the group.

It is trained in numpy on every partition, at every word of every document, and
the partitions' parameters are averaged by the words they saw.  A first pass
over every eighth piece of each partition gives all the same start.  A text's
score is the sum of the log-probabilities of its words, each given both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import Scratch, column, small

GROUPS, MEMBERS, HIDDEN = 32, 32, 24
TOKENS = GROUPS * MEMBERS
#: Tokens of frequent words, of frequent endings, and shared by other endings.
OWN, TAILS = 640, 352
SHARED = TOKENS - OWN - TAILS
EDGE = TOKENS
SIDES = (-2, -1, 1, 2)
REACH = 2
SHAPES = {"tables": (len(SIDES), TOKENS + 1, HIDDEN), "bias": (HIDDEN,), "w1": (HIDDEN, GROUPS), "b1": (GROUPS,), "w2": (GROUPS, HIDDEN, MEMBERS), "b2": (GROUPS, MEMBERS)}
SIZE, TABLES = sum(int(np.prod(s)) for s in SHAPES.values()), int(np.prod(SHAPES["tables"]))
#: A step takes so many neighbouring words from each of so many places.
LANES, WIDTH = 8, 512
#: Places of a group that are multiplied at once.
TILE = 32
RATE = 0.15
#: Words gathered before training or scoring, and bytes scanned at once.
PIECE, SCAN = 1 << 17, 1 << 16
#: The first pass trains on every so many pieces.
WARM = 8
#: The counts of so many words are held by every task, the others' are joined.
FREQUENT = 300_000
#: A task merges its counts when it holds so many, and gives them out beyond half of it.
HELD = 1 << 22
#: States are cut into parts of so many numbers; those of so many partitions are averaged at once.
PART, FAN_IN = 1 << 14, 32
STATE = "pid int, part int, w long, v binary"

#: Capitals become small letters and white space a blank.
_PLAIN = bytes(32 if c in b"\t\n\x0b\f\r " else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A word's hash is a polynomial over random numbers for its bytes, a blank's is zero.
_DRAWS = np.random.default_rng(9).integers(0, 1 << 63, 256, np.uint64) | np.uint64(1)
_DRAWS[32] = 0
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


_UP, _DOWN = _powers(_BASE, 2 * SCAN), _powers(pow(_BASE, -1, 1 << 64), 2 * SCAN)


def _hashed(part: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of the words that begin at the given places, not negative."""
    up, down = (_UP, _DOWN) if len(part) <= len(_UP) else (_powers(_BASE, len(part)), _powers(pow(_BASE, -1, 1 << 64), len(part)))
    h = np.add.reduceat(np.take(_DRAWS, part) * up[: len(part)], first) * down[first]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def scan(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and last three bytes of all words, and words by text.

    ``raw`` holds the texts' UTF-8 bytes on end and ``ends`` where each ends.
    A to Z count as a to z.
    """
    hashes, tails, starts = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    lo = 0
    while lo < len(raw):
        plain, hi = b"", lo
        while hi < len(raw):  # a piece ends at a gap or with a text
            new = min(len(raw), hi + SCAN)
            plain += raw[hi:new].tobytes().translate(_PLAIN)
            inner = ends[np.searchsorted(ends, lo, side="right") : np.searchsorted(ends, new, side="right")]
            cut = max(plain.rfind(b" ") + 1, int(inner[-1]) - lo if len(inner) else 0)
            hi = new
            if cut:
                hi = lo + cut
                break
        part = np.frombuffer(plain, np.uint8, hi - lo)
        word = part != 32
        cuts = ends[np.searchsorted(ends, lo) : np.searchsorted(ends, hi)] - lo
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first[cuts] = word[cuts]
        cuts = cuts[cuts > 0] - 1
        last[cuts] = word[cuts]
        at, to = np.flatnonzero(first), np.flatnonzero(last)
        if len(at):
            n = to - at
            hashes.append(_hashed(part, at))
            tail = part[to].astype(np.int32)
            tail += np.where(n > 0, part[to - 1], 0).astype(np.int32) << 8
            tail += np.where(n > 1, part[to - 2], 0).astype(np.int32) << 16
            tails.append(tail)
            starts.append(at + lo)
        lo = hi
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.concatenate(tails), np.diff(np.searchsorted(starts, ends), prepend=0)


def _scanned(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``scan`` of an Arrow column; null texts have no words."""
    texts = texts.fill_null("").cast(pa.large_string())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None and edges[-1] > edges[0] else np.empty(0, np.uint8)
    return scan(raw, edges[1:] - edges[0])


class Vocabulary:
    """Tokens of words and their chances within the token.

    ``words`` and ``counts`` hold the most frequent words, the most frequent
    first; ``tails`` the most frequent endings of the words beyond the first
    OWN, and ``seen`` how often each token occurs.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, ends: np.ndarray, tails: np.ndarray, seen: np.ndarray):
        self.tails = np.sort(tails)
        self.tail_token = (OWN + np.argsort(tails)).astype(np.int16)
        self.seen = np.append(np.maximum(seen, 1e-9), 1.0)
        token = self.of_tails(ends)
        token[:OWN] = np.arange(min(OWN, len(words)))
        share = np.log(counts) - np.log(self.seen[token])
        bits = max(4, int(len(words)).bit_length() + 2)
        self.mask, self.slots = (1 << bits) - 1, np.full(1 << bits, len(words), np.int32)
        self.slots[(words & self.mask)[::-1]] = np.arange(len(words), dtype=np.int32)[::-1]
        late = self.slots[words & self.mask] != np.arange(len(words))  # slots taken by more frequent words
        order = np.flatnonzero(late)[np.argsort(words[late])]
        self.late, self.late_at = words[order], order.astype(np.int32)
        self.words, self.token, self.share = np.append(words, -1), np.append(token, EDGE).astype(np.int16), np.append(share, np.nan)

    def of_tails(self, tails: np.ndarray) -> np.ndarray:
        """Tokens of words by their ending alone."""
        token = (OWN + TAILS + tails % SHARED).astype(np.int16)
        if len(self.tails):
            at = np.minimum(np.searchsorted(self.tails, tails), len(self.tails) - 1)
            token = np.where(self.tails[at] == tails, self.tail_token[at], token)
        return token

    def find(self, words: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words and log-chances within them, NaN if not held."""
        at = self.slots[words & self.mask]
        far = np.flatnonzero(self.words[at] != words)
        if len(far):
            near = np.searchsorted(self.late, words[far])
            near[near == len(self.late)] = 0
            hit = self.late[near] == words[far] if len(self.late) else np.zeros(len(far), bool)
            at[far] = len(self.words) - 1
            at[far[hit]] = self.late_at[near[hit]]
            far = far[~hit]
        token = self.token[at]
        token[far] = self.of_tails(tails[far])
        return token, self.share[at]


def layout_of(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group and member of each token: the groups have equally many tokens and near equal words."""
    group, member = np.zeros(TOKENS, np.uint8), np.zeros(TOKENS, np.uint8)
    load, n = np.zeros(GROUPS), np.zeros(GROUPS, int)
    for t in np.argsort(-seen[:TOKENS], kind="stable").tolist():
        g = int(np.argmin(np.where(n < MEMBERS, load, np.inf)))
        group[t], member[t] = g, n[g]
        load[g] += seen[t]
        n[g] += 1
    return group, member


def initial(seen: np.ndarray, layout: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Small random tables, and the tokens' frequencies as biases."""
    theta = (np.random.default_rng(9).standard_normal(SIZE) * 0.1).astype(np.float32)
    model, share = parts(theta), np.zeros((GROUPS, MEMBERS))
    share[layout] = seen[:TOKENS] + 0.5
    model["b1"][:] = np.log(share.sum(axis=1) / share.sum())
    model["b2"][:] = np.log(share / share.sum(axis=1, keepdims=True))
    return theta


def parts(theta: np.ndarray, layout: tuple[np.ndarray, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """The parameters by name, and the tokens' layout."""
    out, at = dict(zip(("group", "member"), layout, strict=True)) if layout else {}, 0
    for name, s in SHAPES.items():
        n = int(np.prod(s))
        out[name] = theta[at : at + n].reshape(s)
        at += n
    return out


def line_of(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One line of all texts with edges around each, and its word places."""
    at = np.arange(len(tokens)) + REACH * np.repeat(np.arange(1, len(n) + 1), n)
    line = np.full(len(tokens) + REACH * (len(n) + 1), EDGE, np.int16)
    line[at] = tokens
    return line, at


def _hidden(model: dict, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.take(model["tables"][0], line[at + SIDES[0]], axis=0)
    for k, o in enumerate(SIDES[1:], 1):
        h += np.take(model["tables"][k], line[at + o], axis=0)
    h += model["bias"]
    h /= 1 + np.abs(h)
    return h


def _softmax(z: np.ndarray) -> np.ndarray:
    """Chances in place of scores, which are cut at a size that no fit comes near."""
    np.clip(z, -80, 80, out=z)
    np.exp(z, out=z)
    flat = z.reshape(-1, z.shape[-1])
    flat /= flat @ np.ones((z.shape[-1], 1), z.dtype)
    return z


def _dealt(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place's row when the groups' rows are dealt to tiles, and each tile's group."""
    order = np.argsort(group, kind="stable")
    n = np.bincount(group, minlength=GROUPS)
    tiles = -(-n // TILE)
    row = np.empty(len(group), np.int64)
    row[order] = np.arange(len(group)) + np.repeat((np.cumsum(tiles) - tiles) * TILE - (np.cumsum(n) - n), n)
    return row, np.repeat(np.arange(GROUPS), tiles)


def _within(model: dict, h: np.ndarray, row: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden rows in tiles, and the chances of their groups' members."""
    dealt = np.zeros((len(of) * TILE, HIDDEN), np.float32)
    dealt[row] = h
    dealt = dealt.reshape(len(of), TILE, HIDDEN)
    z = dealt @ model["w2"][of]
    z += model["b2"][of][:, None]
    return dealt, _softmax(z)


def gradients(model: dict, line: np.ndarray, at: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the summed loss at places of a line; that of the hidden sums by place."""
    y, every = line[at], np.arange(len(at))
    h = _hidden(model, line, at)
    group, member = model["group"][y], model["member"][y]
    p = _softmax(h @ model["w1"] + model["b1"])
    p[every, group] -= 1
    out = {"w1": h.T @ p, "b1": p.sum(axis=0)}
    dh = p @ model["w1"].T
    row, of = _dealt(group)
    dealt, q = _within(model, h, row, of)
    used = np.zeros((len(of) * TILE, 1), np.float32)
    used[row] = 1
    flat = q.reshape(-1, MEMBERS)
    flat *= used
    flat[row, member] -= 1
    first = np.flatnonzero(np.diff(of, prepend=-1))
    out["w2"], out["b2"] = np.zeros(SHAPES["w2"], np.float32), np.zeros(SHAPES["b2"], np.float32)
    out["w2"][of[first]] = np.add.reduceat(dealt.transpose(0, 2, 1) @ q, first)
    out["b2"][of[first]] = np.add.reduceat(q.sum(axis=1), first)
    dh += np.take((q @ model["w2"][of].transpose(0, 2, 1)).reshape(-1, HIDDEN), row, axis=0)
    h = 1 - np.abs(h)
    dh *= h
    dh *= h
    out["bias"] = dh.sum(axis=0)
    return out, dh


class Trainer:
    """Adaptive steps over lines, in place on its own state.

    The state is the parameters, the summed squares of their gradients and
    those of the tables' rows.
    """

    def __init__(self, theta: np.ndarray, state: np.ndarray | None = None, layout: tuple | None = None):
        n = SIZE - TABLES
        self.state = np.concatenate([theta, np.full(n + len(SIDES) * (TOKENS + 1), 1e-6, np.float32)]) if state is None else state.copy()
        self.model = parts(self.state, layout)
        self.grown, at = {}, SIZE
        for k, s in list(SHAPES.items())[1:]:
            self.grown[k] = self.state[at : at + int(np.prod(s))].reshape(s)
            at += int(np.prod(s))
        self.rows = self.state[at:].reshape(len(SIDES), TOKENS + 1)
        self.seen = 0

    def step(self, line: np.ndarray, at: np.ndarray) -> None:
        slopes, dh = gradients(self.model, line, at)
        for k, g in slopes.items():
            self.grown[k] += g * g
            self.model[k] -= RATE * g / np.sqrt(self.grown[k])
        for k, o in enumerate(SIDES):
            side = line[at + o]
            order = np.argsort(side, kind="stable")
            names = side[order]
            first = np.flatnonzero(names[1:] != names[:-1]) + 1
            first = np.append(0, first)
            g = np.add.reduceat(np.take(dh, order, axis=0), first)
            own = names[first]
            self.rows[k, own] += (g * g) @ np.full(HIDDEN, 1 / HIDDEN, np.float32)
            self.model["tables"][k, own] -= RATE * g / np.sqrt(self.rows[k, own])[:, None]

    def line(self, line: np.ndarray, at: np.ndarray) -> None:
        """Steps over all word places of a line, each from LANES parts of it."""
        self.seen += len(at)
        each = -(-len(at) // LANES)
        for lo in range(0, each, WIDTH):
            places = np.concatenate([at[k * each : (k + 1) * each][lo : lo + WIDTH] for k in range(LANES)])
            self.step(line, places)


def score_line(model: dict, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of the token at each place given both sides."""
    out = np.empty(len(at))
    for lo in range(0, len(at), LANES * WIDTH):
        i = at[lo : lo + LANES * WIDTH]
        y, h = line[i], _hidden(model, line, i)
        group, member = model["group"][y], model["member"][y]
        p = _softmax(h @ model["w1"] + model["b1"])[np.arange(len(i)), group]
        row, of = _dealt(group)
        p *= _within(model, h, row, of)[1].reshape(-1, MEMBERS)[row, member]
        out[lo : lo + len(i)] = np.log(p, dtype=np.float64)
    return out


def _texts(batches: Iterator[pa.RecordBatch], ids: bool = False) -> Iterator[tuple]:
    """(ids, hashes, endings, words by text) of about PIECE words or one text each."""
    for batch in batches:
        hashes, tails, n = _scanned(batch.column("text"))
        upto = np.append(0, np.cumsum(n))
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PIECE, side="right")) - 1)
            yield batch.column("id").slice(lo, hi - lo) if ids else None, hashes[upto[lo] : upto[hi]], tails[upto[lo] : upto[hi]], n[lo:hi]
            lo = hi


def _merged(held: list[tuple]) -> tuple:
    """Each word once, with its ending and summed count."""
    words, tails, n = (np.concatenate(x) for x in zip(*held, strict=True))
    code, once = pd.factorize(words)
    tail = np.empty(len(once), np.int32)
    tail[code] = tails
    return once, tail, np.bincount(code, n, len(once)).astype(np.int64)


def count_words(rows: DataFrame) -> DataFrame:
    """(word, tail, n): every distinct word of all texts by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(held[0][0]), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 18)]) for x in held[0]], names=["word", "tail", "n"])
            held.clear()

        held: list[tuple] = []
        for _, words, tails, n in _texts(batches):
            held.append(_merged([(words, tails, np.ones(len(words)))]))
            if sum(len(x[0]) for x in held) > HELD:
                held[:] = [_merged(held)]
                if len(held[0][0]) > HELD // 2:
                    yield from told()
        if held:
            held[:] = [_merged(held)]
            yield from told()

    return rows.select("text").mapInArrow(run, "word long, tail int, n long").groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


def fit_vocabulary(counts: DataFrame, scratch: Scratch) -> Vocabulary:
    """The vocabulary of counted words; at most FREQUENT of them come to the driver."""
    step = F.floor(F.log("n") * 16)
    above, cut = 0, 0
    for r in counts.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():  # a few hundred steps
        if above >= OWN and above + r["count"] > FREQUENT:
            break
        above, cut = above + r["count"], r["s"]
    top = counts.where(step >= F.lit(cut)).orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    words, ends, n = (top.column(c).to_numpy() for c in ("word", "tail", "n"))
    own = words[:OWN].tolist()
    tails = scratch.table(counts.where(~F.col("word").isin(own)).groupBy("tail").agg(F.sum("n").alias("n")), "tails")
    known = tails.orderBy(F.desc("n"), "tail").limit(TAILS).collect()
    rest = tails.where(~F.col("tail").isin([r["tail"] for r in known])).groupBy((F.col("tail") % SHARED).alias("k")).agg(F.sum("n").alias("n")).collect()  # SHARED rows
    seen = np.zeros(TOKENS)
    seen[: len(own)] = n[: len(own)]
    seen[OWN : OWN + len(known)] = [r["n"] for r in known]
    for r in rest:
        seen[OWN + TAILS + r["k"]] = r["n"]
    return Vocabulary(words, n.astype(float), ends, np.array([r["tail"] for r in known], np.int32), seen)


def _averaged(states: DataFrame, scratch: Scratch) -> np.ndarray | None:
    """The mean of the partitions' states by their words, FAN_IN at a time in their order.

    ``states`` holds a row for each part of a partition's state: (pid, part, w, v).
    """

    def mean(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("pid").to_numpy()).tolist()
        w = rows.column("w").to_numpy()
        total, sums = float(w.sum()), 0.0
        for k in order:
            sums = sums + np.frombuffer(rows.column("v")[k].as_py(), np.float32) * (w[k] / total)
        first = {c: rows.column(c)[order[0]].as_py() for c in ("pid", "part")}
        return pa.table({"pid": pa.array([first["pid"] // FAN_IN], pa.int32()), "part": pa.array([first["part"]], pa.int32()), "w": [int(w.sum())], "v": [sums.astype(np.float32).tobytes()]})

    states = scratch.table(states, "states")
    most = states.agg(F.max("pid")).first()[0]
    if most is None:
        return None
    while most > 0:
        grouped = states.withColumn("g", F.floor(F.col("pid") / FAN_IN)).groupBy("part", "g")
        states, most = scratch.table(grouped.applyInArrow(mean, STATE), "states"), most // FAN_IN
    return np.concatenate([np.frombuffer(bytes(r["v"]), np.float32) for r in states.orderBy("part").collect()])  # one state


def fit_network(rows: DataFrame, vocabulary: Vocabulary, scratch: Scratch) -> np.ndarray:
    """The averaged parameters after the first pass and one over every word."""
    layout = layout_of(vocabulary.seen)
    theta, state = initial(vocabulary.seen, layout), None
    for every in (WARM, 1):

        def fit(batches: Iterator[pa.RecordBatch], every: int = every, state: np.ndarray | None = state) -> Iterator[pa.RecordBatch]:
            own, turn = Trainer(theta, state, layout), TaskContext.get().partitionId()
            for _, words, tails, n in _texts(batches):
                if turn % every == 0 and len(words):
                    own.line(*line_of(vocabulary.find(words, tails)[0], n))
                turn += 1
            if own.seen:
                cuts = [own.state[lo : lo + PART].tobytes() for lo in range(0, len(own.state), PART)]
                same = lambda x, kind: pa.array([x] * len(cuts), kind)
                yield pa.RecordBatch.from_arrays([same(TaskContext.get().partitionId(), pa.int32()), pa.array(range(len(cuts)), pa.int32()), same(own.seen, pa.int64()), pa.array(cuts, pa.binary())], names=["pid", "part", "w", "v"])

        got = _averaged(rows.select("text").mapInArrow(fit, STATE), scratch)
        state = state if got is None else got
    return theta if state is None else state[:SIZE].copy()


def fit(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """Word counts, vocabulary and parameters from (text)."""
    counts = scratch.table(count_words(rows), "counts")
    vocabulary = fit_vocabulary(counts, scratch)
    return counts, vocabulary, fit_network(rows, vocabulary, scratch)


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_likelihood, mean_log_likelihood) of each row.

    Null, empty and blank texts have no words, 0 and a null mean.  Repeated
    rows are scored each, null ids like others; empty tables give no rows;
    other columns are not read.  Counts and training read every document; a
    text is scored as a whole, whatever its length.
    """
    scratch = Scratch(docs.sparkSession, "pseudolik")
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    counts, vocabulary, theta = fit(rows, scratch)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, none = parts(theta, layout_of(vocabulary.seen)), vocabulary.seen
        for ids, words, tails, n in _texts(batches, ids=True):
            token, share = vocabulary.find(words, tails)
            line, at = line_of(token, n)
            row, far = np.repeat(np.arange(len(n)), n), np.isnan(share)
            # A word that is not held has the log of its count less that of its token's; the join adds the former.
            each = score_line(model, line, at) + np.where(far, -np.log(none[token]), share)
            ends = np.append(0, np.cumsum(np.bincount(row[far], minlength=len(n)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(words[far]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(np.bincount(row, each, len(n))), lists], names=["id", "n_words", "sum", "words"])

    kind = rows.schema["id"].dataType.simpleString()
    scored = scratch.table(rows.mapInArrow(score, f"id {kind}, n_words long, sum double, words array<long>").withColumn("uid", F.monotonically_increasing_id()), "scored")
    # A word that occurs once adds nothing, and those that every task holds are never asked for.
    held = float(np.exp(np.nanmin(vocabulary.share + np.log(vocabulary.seen[vocabulary.token])))) if len(vocabulary.words) > 1 else 1.0
    asked = counts.where((F.col("n") > 1) & (F.col("n") <= held + 0.5)).select("word", F.log("n").alias("more"))
    far = scored.select("uid", F.explode("words").alias("word")).join(small(asked, asked.count()), "word").groupBy("uid").agg(F.sum("more").alias("more"))
    out = scored.drop("words").join(far, "uid", "left").withColumn("log_likelihood", F.col("sum") + F.coalesce("more", F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_words", "log_likelihood", (F.col("log_likelihood") / F.nullif(F.col("n_words"), F.lit(0))).alias("mean_log_likelihood"))
