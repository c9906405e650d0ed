"""Best-fit packing of token sequences by hierarchical residual merging.

Each input partition tokenizes its documents, cuts only those longer than a
sequence and packs the pieces best-fit by falling length.  Nearly full bins
are final; the others go up a tree as items of their fill and are packed again
with the bins of other partitions, until one group is left or a round gains
nothing more than one bin in a thousand.  A group never holds more than
``max_items`` bins, whatever the input.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import Scratch, column, small

#: The tokenizer's own split of texts within Latin-1: contractions, runs of
#: letters, single numerals, runs of other characters.
_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMERAL = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMERAL}]|[^{_LETTER}{_NUMERAL}{_SPACE}]+")
PARTS_KEPT = 600_000
#: A task packs its pieces when it holds so many.
HELD = 500_000


class WordTokenizer:
    """Token ids as little-endian 32-bit bytes, with a bounded store of parts.

    Lower-casing, normal form and split act on each part of a Latin-1 text
    alone, so parts met before are looked up; the ids equal those of the whole
    text.  Other texts, and those that may hold special tokens, are encoded
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        vocab = self.inner.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: list[str]) -> None:
        ids = np.array(self.inner.encode(" ".join(parts), add_special_tokens=False).ids, "<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) != len(parts):
            self.known.update((p, self._whole(p)) for p in parts)
            return
        raw, at = ids.tobytes(), 0
        for part, end in zip(parts, ends.tolist(), strict=True):
            self.known[part] = raw[at:end]
            at = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is empty."""
        split: list[list[str] | None] = []
        fresh: set[str] = set()
        if len(self.known) > PARTS_KEPT:
            self.known.clear()
        for text in texts:
            try:
                (text or "").encode("latin-1")
            except UnicodeEncodeError:
                split.append(None)
                continue
            if text and "<|" in text:
                split.append(None)
                continue
            parts = _PARTS.findall(text.lower()) if text else []
            fresh.update(set(parts).difference(self.known))
            split.append(parts)
        if fresh:
            self._learn(list(fresh))
        get = self.known.__getitem__
        return [self._whole(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, split, strict=True)]


@functools.cache
def tokenizer_at(path: str) -> WordTokenizer:
    """One tokenizer for each worker process, so tasks share the parts met."""
    return WordTokenizer(path)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item, best-fit by falling length.

    Bins stand in a list per free space and a bit set tells which are used, so
    an item finds the tightest bin without a search over bins.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, opened = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        rest = used >> n
        if rest:
            space = n + ((rest & -rest).bit_length() - 1)
            b = free[space].pop()
            if not free[space]:
                used ^= 1 << space
        else:
            space, b, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = b, capacity - space
        if space > n:
            free[space - n].append(b)
            used |= 1 << (space - n)
    return bins, offsets


def _local(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer_at(tokenizer)
        cols: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "crc", *(["ids"] if with_ids else []))}
        first = TaskContext.get().partitionId() << 36

        def told() -> Iterator[pd.DataFrame]:
            nonlocal first
            out = pd.DataFrame(cols)
            out["id"] = out["id"].astype("Int64")
            out["bin"], out["offset"] = best_fit(out["length"].to_numpy(), capacity)
            out["bin"] += first
            first = int(out["bin"].max()) + 1
            for v in cols.values():
                v.clear()
            for lo in range(0, len(out), 10_000):
                yield out.iloc[lo : lo + 10_000]

        for batch in batches:
            ids, texts = batch["id"].tolist(), batch["text"].tolist()
            for lo in range(0, len(texts), 64):
                for key, raw in zip(ids[lo : lo + 64], encoder.encode(texts[lo : lo + 64]), strict=True):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), capacity * 4)):
                        part = raw[at : at + capacity * 4]
                        cols["id"].append(key)
                        cols["piece"].append(k)
                        cols["start"].append(at // 4)
                        cols["length"].append(len(part) // 4)
                        cols["crc"].append(zlib.crc32(part))
                        if with_ids:
                            cols["ids"].append(part)
                if len(cols["id"]) >= HELD:
                    yield from told()
        if cols["id"]:
            yield from told()

    rows = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text"))
    extra = ", ids binary" if with_ids else ""
    return rows.mapInPandas(run, f"id long, piece int, start long, length long, crc long{extra}, bin long, offset long")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 1,
    slack: int = 4,
    fan_in: int = 8,
    max_items: int = 100_000,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their place in as few sequences as found.

    Columns: id, piece, start, length, ids_crc32, sequence_id, offset, and
    ``ids`` (little-endian 32-bit) if asked for.  A document is its token ids
    and ``end_id``; null and empty texts are ``end_id`` alone.  Bins with at
    most ``slack`` places free are final at once.  Repeated rows and null ids
    are packed like others, empty tables give no rows, other columns are not
    read.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.table(_local(docs, id_col, text_col, tokenizer, capacity, end_id, with_ids), "pieces")
    bins = scratch.table(pieces.groupBy("bin").agg(F.sum("length").alias("fill")), "bins")
    moved = None
    groups = max(1, bins.select(F.shiftright("bin", 36).alias("p")).distinct().count())

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "bin"], ascending=[False, True])
        place, offset = best_fit(group["fill"].to_numpy(), capacity)
        names = group["bin"].to_numpy()
        first = np.zeros(place.max() + 1, np.int64)
        first[place[::-1]] = names[::-1]
        return pd.DataFrame({"bin": names, "root": first[place], "shift": offset, "fill": group["fill"].to_numpy()})

    turn = 0
    while True:
        turn += 1
        low = bins.where(F.col("fill") < capacity - slack).agg(F.min("fill")).first()[0]
        if low is None:
            break
        open_bins = bins.where((F.col("fill") < capacity - slack) & (F.col("fill") <= capacity - low))
        n = open_bins.count()
        groups = max(math.ceil(n / max_items), math.ceil(groups / fan_in))
        key = F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)).cast("int") if groups * max_items < n * 2 and groups > 1 else F.pmod(F.shiftright("bin", 36), F.lit(groups)).cast("int")
        step = open_bins.withColumn("g", key).groupBy("g").applyInPandas(merge, "bin long, root long, shift long, fill long")
        step = scratch.table(step, "step")
        gain = step.where("bin <> root").count()
        if gain:
            hops = step.where("bin <> root").select("bin", "root", "shift")
            onto = hops.select(F.col("bin").alias("root"), F.col("root").alias("next"), F.col("shift").alias("more"))
            if moved is not None:
                far = moved.join(onto, "root", "left").select("bin", F.coalesce("next", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
                hops = far.union(hops)
            moved = scratch.table(hops, "moved")
            kept = step.groupBy(F.col("root").alias("bin")).agg(F.sum("fill").alias("fill"))
            bins = scratch.table(kept, "bins")
        else:
            bins = step.select("bin", "fill")
        if groups == 1 or gain * 1000 < n:
            break
    if moved is not None:
        pieces = pieces.join(small(moved, moved.count()), "bin", "left")
    else:
        pieces = pieces.withColumns({"root": F.lit(None).cast("long"), "shift": F.lit(0).cast("long")})
    return pieces.select(
        F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), *(["ids"] if with_ids else []),
        F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
