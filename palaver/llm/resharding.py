"""Operator 7 - resharding by minimum-cost flow.

An old layout (shard of each row) is brought to new capacities while the fewest
bytes move.  Rows of an old shard are cut by a hash into ``CELLS`` blocks; the
blocks' sizes are all the driver sees (old shards x CELLS numbers, whatever the
input's size).  A minimum-cost flow from old shards to new capacities, where
staying is free and a moved byte costs one, gives the bytes that each pair
exchanges; whole blocks are dealt to fit it, then single blocks move from the
fullest to the emptiest shard while that narrows the spread.  The table of
blocks is broadcast (its size is bounded by its rows), documents are dealt once
to their files, one task to a file of about ``FILE_BYTES``, and files of shards
that lose or gain are rewritten.  Rows of the other shards are given as they are
read from ``docs``: where that is the old files, these stay in use.

The law is ``bytes``: sizes near equal.  Slots are gapless in each shard: a
block's first slot is known, so only rows of one block are ranked together.
Equal texts are not kept together: they lie in different old shards, and to
bring them together would move bytes that need not move.

Cases: null text is empty (size 16); a null doc_id is placed by its text; rows
that repeat an id lie in one block, in the order of crc and size; more shards
than rows leave shards empty; an empty table gives an empty table; other columns
are carried to the files whatever their names; ``shard``, ``slot`` and
``old_shard`` of the input get ``_in`` appended there, until the name is free.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import free_names, shared_folder

OLD, NEW, CELLS = 32, 40, 2048
OVERHEAD = 16
FILE_BYTES = 128 << 20


def min_cost_flow(supply: np.ndarray, capacity: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Flow from each supply to each capacity that ships all at the least cost (successive shortest paths)."""
    if supply.sum() > capacity.sum():
        raise ValueError("capacities are too small")
    m, n = cost.shape
    flow = np.zeros((m, n), np.int64)
    left, room = supply.astype(np.int64).copy(), capacity.astype(np.int64).copy()
    big = np.iinfo(np.int64).max // 4
    while (left > 0).any():
        # shortest distances over arcs m -> n (cost) and, where there is flow, n -> m (-cost)
        near, far = np.where(left > 0, 0, big), np.full(n, big)
        via_n, via_m = np.full(m, -1), np.full(n, -1)
        for _ in range(m + n):
            step = np.minimum(near, big)[:, None] + cost
            best = step.argmin(axis=0)
            value = step[best, np.arange(n)]
            better = value < far
            far, via_m = np.where(better, value, far), np.where(better, best, via_m)
            back = np.where(flow > 0, far[None, :] - cost, big)
            best = back.argmin(axis=1)
            value = back[np.arange(m), best]
            closer = value < near
            near, via_n = np.where(closer, value, near), np.where(closer, best, via_n)
            if not better.any() and not closer.any():
                break
        end = int(np.where(room > 0, far, big).argmin())
        path, i = [], end
        while True:
            j = int(via_m[i])
            path.append((j, i, 1))
            if via_n[j] < 0 or left[j] > 0 and near[j] == 0:
                break
            i = int(via_n[j])
            path.append((j, i, -1))
        amount = min(int(left[path[-1][0]]), int(room[end]), *(int(flow[j, i]) for j, i, s in path if s < 0))
        for j, i, s in path:
            flow[j, i] += s * amount
        left[path[-1][0]] -= amount
        room[end] -= amount
    return flow


@dataclass
class Plan:
    """For each block (old shard * cells + cell) with rows: new shard, first slot, file."""

    block: np.ndarray
    shard: np.ndarray
    first: np.ndarray
    file: np.ndarray
    size: np.ndarray
    old: np.ndarray
    new: int

    @property
    def bytes(self) -> np.ndarray:
        return np.bincount(self.shard, weights=self.size, minlength=self.new).astype(np.int64)

    @property
    def moved(self) -> int:
        return int(self.size[self.shard != self.old].sum())

    @property
    def affected(self) -> set[int]:
        """Shards that lose or gain a block."""
        move = self.shard != self.old
        return set(self.shard[move].tolist()) | {o for o in self.old[move].tolist() if o < self.new}


def solve(block: np.ndarray, size: np.ndarray, rows: np.ndarray, cells: int, new: int, shares: np.ndarray | None = None) -> Plan:
    """Deals blocks to new shards whose capacities are in proportion to ``shares`` (else equal)."""
    order = np.argsort(block)
    block, size, rows = block[order], size[order], rows[order]
    old = block // cells
    sources = int(old.max()) + 1 if len(old) else 1
    supply = np.bincount(old, weights=size, minlength=sources).astype(np.int64)
    shares = np.ones(new) if shares is None else np.asarray(shares, float)
    exact = np.floor(np.cumsum(shares) / shares.sum() * supply.sum()).astype(np.int64)
    capacity = np.diff(np.append(0, exact))
    capacity[-1] += supply.sum() - capacity.sum()
    cost = (np.arange(sources)[:, None] != np.arange(new)[None, :]).astype(np.int64)
    flow = min_cost_flow(supply, capacity, cost)
    shard = np.zeros(len(block), np.int64)
    for o in range(sources):
        at = np.flatnonzero(old == o)
        if len(at):
            middle = np.cumsum(size[at]) - size[at] / 2
            turn = np.argsort(cost[o], kind="stable")  # what stays comes first
            shard[at] = turn[np.minimum(np.searchsorted(np.cumsum(flow[o][turn]), middle, side="left"), new - 1)]
    _level(shard, size, shares / shares.sum() * supply.sum())
    by = np.lexsort((block, shard))
    first, file = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
    for s in range(new):
        own = by[np.searchsorted(shard[by], s) : np.searchsorted(shard[by], s, side="right")]
        first[own] = np.cumsum(rows[own]) - rows[own]
        file[own] = (np.cumsum(size[own]) - size[own]) // FILE_BYTES
    return Plan(block, shard, first, file, size, old, new)


def _level(shard: np.ndarray, size: np.ndarray, target: np.ndarray) -> None:
    """Moves one block at a time from the shard furthest above its target to that furthest below, while that helps.

    A move lowers the sum of the squares of what shards are off, so moves end.
    """
    over = np.bincount(shard, weights=size, minlength=len(target)) - target
    own = [[] for _ in target]
    for i in np.argsort(size, kind="stable"):
        own[shard[i]].append((int(size[i]), int(i)))
    while True:
        a, b = int(over.argmax()), int(over.argmin())
        gap = over[a] - over[b]
        k = bisect.bisect_right(own[a], (gap / 2, len(size)))
        near = [own[a][j] for j in (k - 1, k) if 0 <= j < len(own[a]) and 0 < own[a][j][0] < gap]
        if not near:
            return
        s, i = min(near, key=lambda x: abs(x[0] - gap / 2))
        own[a].remove((s, i))
        bisect.insort(own[b], (s, i))
        shard[i] = b
        over[a] -= s
        over[b] += s


def _hash_int(x: np.ndarray) -> np.ndarray:
    """Spark's ``hash`` of int columns (32-bit Murmur3 with its seed 42), by which it deals rows."""
    u = np.uint32
    turn = lambda v, n: v << u(n) | v >> u(32 - n)
    with np.errstate(over="ignore"):
        h = turn(u(42) ^ turn(x.astype(np.int32).view(u) * u(0xCC9E2D51), 15) * u(0x1B873593), 13) * u(5) + u(0xE6546B64)
        h ^= u(4)
        h = (h ^ h >> u(16)) * u(0x85EBCA6B)
        h = (h ^ h >> u(13)) * u(0xC2B2AE35)
        return (h ^ h >> u(16)).view(np.int32)


def deal_keys(n: int) -> np.ndarray:
    """For each of n partitions an int that a repartition by it sends there."""
    out, at = np.zeros(n, np.int32), 0
    seen = np.zeros(n, bool)
    while not seen.all():
        x = np.arange(at, at + 4 * n, dtype=np.int32)
        to, first = np.unique(_hash_int(x).astype(np.int64) % n, return_index=True)
        new = ~seen[to]
        out[to[new]], seen[to[new]] = x[first[new]], True
        at += 4 * n
    return out


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))


def _old(old: Column | None) -> Column:
    """The old shard of each row."""
    return (F.pmod(F.xxhash64(_key()), F.lit(OLD)) if old is None else old).cast("long")


def _block(old: Column, cells: int) -> Column:
    return old * cells + F.pmod(F.xxhash64(_key(), F.lit(11)), F.lit(cells))


def _size() -> Column:
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + OVERHEAD


def _crc() -> Column:
    return F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def plan_reshard(docs: DataFrame, *, new: int = NEW, old: Column | None = None, cells: int = CELLS, shares: np.ndarray | None = None) -> Plan:
    """The transfers; at most (old shards) x cells rows come to the driver."""
    blocks = docs.select(_block(_old(old), cells).alias("block"), _size().alias("size")).groupBy("block").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toArrow()
    cols = [blocks[c].to_numpy().astype(np.int64) for c in ("block", "size", "n")]
    return solve(*cols, cells, new, shares)


def _renamed(columns: list[str]) -> list[str]:
    """The columns without the names that the layout gives; those get _in appended until they are free."""
    used = {c.lower() for c in columns} | {"shard", "slot", "old_shard"}
    out = []
    for c in columns:
        if c.lower() in ("shard", "slot", "old_shard"):
            while c.lower() in used:
                c += "_in"
            used.add(c.lower())
        out.append(c)
    return out


def reshard(docs: DataFrame, *, new: int = NEW, old: Column | None = None, cells: int = CELLS, shares: np.ndarray | None = None, path: str | None = None) -> tuple[DataFrame, Plan]:
    """Rewrites the shards that change below ``path`` (folders shard=N) and returns their rows with shard and slot, and the plan."""
    spark = docs.sparkSession
    plan = plan_reshard(docs, new=new, old=old, cells=cells, shares=shares)
    carried = _renamed(docs.columns)
    stays = [s for s in range(new) if s not in plan.affected]
    files, file = np.unique(np.stack([plan.shard, plan.file], axis=1), axis=0, return_inverse=True)
    deal = deal_keys(max(1, len(files)))
    p_old, p_block, p_size, p_crc, p_first, p_deal = free_names([*carried, "shard", "slot", "old_shard"], "old", "block", "size", "crc", "first", "deal")
    table = spark.createDataFrame(
        list(zip(plan.block.tolist(), plan.shard.tolist(), plan.first.tolist(), deal[file.ravel()].tolist(), strict=True)),
        f"`{p_block}` long, shard int, `{p_first}` long, `{p_deal}` int",
    )
    # what is computed from the rows comes first, under names that none of them has
    sized = docs.select(*[F.col(f"`{c}`") for c in docs.columns], _old(old).alias(p_old), _size().alias(p_size), _crc().alias(p_crc), _block(_old(old), cells).alias(p_block))
    placed = sized.toDF(*carried, p_old, p_size, p_crc, p_block).join(F.broadcast(table), p_block)
    dealt = placed.repartition(len(deal), p_deal)
    rank = F.row_number().over(Window.partitionBy(p_deal, p_block).orderBy("doc_id", p_crc, p_size))
    out = dealt.select(*[F.col(f"`{c}`") for c in carried], (F.col(p_first) + rank - 1).alias("slot"), F.col(p_old).cast("int").alias("old_shard"), "shard")
    path = path or shared_folder(spark)
    out.where(~F.col("shard").isin(stays) if stays else F.lit(True)).write.partitionBy("shard").parquet(path)
    written = spark.read.schema(out.schema).parquet(path)
    return (written.unionByName(out.where(F.col("shard").isin(stays))) if stays else written), plan


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", _size().alias("size"), _crc().alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
