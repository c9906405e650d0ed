"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys and virtual nodes stand on a ring of ``ticks`` places.  A key belongs to
the first virtual node clockwise; a shard takes its own keys up to its
capacity and the rest continue clockwise to the next shard with room.  With no
spare room the shard counts differ by one at most.  The plan is made per tick,
whose number is fixed, so what the driver reads does not grow with the input;
rows then find their place by the tick's plan and their rank within the tick.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.common import Scratch, column

TICKS, VNODES = 8192, 64
#: Rows that one window of ranks should hold at most.
RANKED = 50_000


def tick_of(key: Column, ticks: int = TICKS) -> Column:
    """The ring place of a key; null keys share one."""
    text = F.coalesce(key.cast("string"), F.lit("\0null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(ticks)).cast("int")


def virtual_nodes(shards: int, vnodes: int = VNODES, ticks: int = TICKS) -> list[tuple[int, int]]:
    """(tick, shard) in ring order; of several at a tick the least shard leads."""
    place = lambda s, v: int(hashlib.md5(f"{s}#{v}".encode()).hexdigest()[:8], 16) % ticks
    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(total: int, shards: int, spare: float = 0.0) -> list[int]:
    """Most rows of each shard: equal shares, or more by the share ``spare``."""
    if spare:
        return [-(-int(total * (1 + spare) + 1) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def plan(counts: dict[int, int], shards: int, room: Sequence[int], vnodes: int = VNODES, ticks: int = TICKS) -> list[tuple[int, int, int, int, int]]:
    """(tick, first rank, end rank, shard, first slot) that cover all rows.

    First every shard takes its own keys in ring order, then the keys left
    over go clockwise in ring order.
    """
    ring = virtual_nodes(shards, vnodes, ticks)
    places = [t for t, _ in ring]
    room, used, out, left = list(room), [0] * shards, [], []

    def put(tick: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard] - used[shard])
        if n > 0:
            out.append((tick, lo, lo + n, shard, used[shard]))
            used[shard] += n
        return lo + max(n, 0)

    for tick in sorted(counts):
        at = bisect.bisect_left(places, tick) % len(ring)
        lo = put(tick, 0, counts[tick], ring[at][1])
        if lo < counts[tick]:
            left.append((tick, lo, at))
    for tick, lo, at in left:
        for step in range(1, len(ring)):
            lo = put(tick, lo, counts[tick], ring[(at + step) % len(ring)][1])
            if lo == counts[tick]:
                break
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 8, spare: float = 0.0, vnodes: int = VNODES) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each row.

    ``size`` is the text's UTF-8 bytes plus one, null texts counting none;
    slots number a shard's rows from 0 without gaps.  Rows that repeat an id
    share a tick and are ranked by size, checksum and then as read; null ids
    share one tick.  Empty tables give no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "ring")
    text = column(docs, text_col).cast("string")
    rows = docs.select(
        column(docs, id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), tick_of(column(docs, id_col)).alias("tick"),
    )
    rows = scratch.table(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    counts = {r["tick"]: r["count"] for r in rows.groupBy("tick").count().collect()}  # at most TICKS rows
    parts = plan(counts, shards, capacities(sum(counts.values()), shards, spare), vnodes)

    # A tick is ranked in parts of its rows, so that a repeated id holds up no task.
    share = F.greatest(F.ceil(F.col("n") / RANKED).cast("int"), F.lit(1))
    many = docs.sparkSession.createDataFrame(sorted(counts.items()), "tick int, n long")
    rows = rows.join(F.broadcast(many), "tick").withColumn("sub", F.pmod("uid", share)).drop("n")
    subs = rows.groupBy("tick", "sub").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("tick").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    subs = scratch.table(subs.withColumn("before", before).drop("count"), "subs")
    own = F.row_number().over(Window.partitionBy("tick", "sub").orderBy("id", "size", "text_crc32", "uid")) - 1
    ranked = rows.withColumn("own", own)
    starts = subs.where("before > 0").select("tick", "sub", "before")
    n_starts = starts.count()
    ranked = ranked.join(F.broadcast(starts) if n_starts <= 4 * TICKS else starts, ["tick", "sub"], "left") if n_starts else ranked.withColumn("before", F.lit(0))
    ranked = ranked.withColumn("rank", F.col("own") + F.coalesce("before", F.lit(0)))
    # A tick's plan has at most a part for each shard.
    table = docs.sparkSession.createDataFrame(parts, "tick int, lo long, hi long, shard int, slot0 long")
    steps = table.groupBy("tick").agg(F.collect_list(F.struct("lo", "hi", "shard", "slot0")).alias("parts"))
    placed = ranked.join(F.broadcast(steps), "tick").withColumn("part", F.filter("parts", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"]))[0])
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("part.shard").alias("shard"), (F.col("part.slot0") + F.col("rank") - F.col("part.lo")).alias("slot"))
