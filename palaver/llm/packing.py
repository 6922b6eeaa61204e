"""Operator 8 - best-fit packing by a configuration linear program.

Every document is its ids and an end id, cut into pieces of at most ``CAPACITY``
only where it is longer.  The driver sees the histogram of piece lengths (at
most CAPACITY numbers, whatever the input's size) and solves the configuration
linear program on it by multiplicative weights: a knapsack over the capacity
prices configurations, one within ``SLACK`` of the best is taken in a step, and
the weight of a length falls as its demand is covered, until all demand is.  One
knapsack serves several steps: prices only fall, so a configuration of lengths
that no step has touched since is still as good, and the best is no better.

Steps are rounded down to whole sequences, fullest first; room that they leave
is filled with the longest pieces that fit, and what the rounding leaves over is
filled best-fit, longest first, whole configurations at a time.  That is done
with the steps that leave no room and with all steps, and the way with fewer
sequences is taken.  The prices also bound every packing from below
(``Slots.bound``).

A piece's place follows from its length and its rank among pieces of that
length.  Ranks are counted in each input partition while ids are made and put
together from counts by partition and length, so no task ranks a whole length.

Cases: null text is empty (the end id alone); rows that repeat an id are packed
each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .cluster import materialise
from .tokens import SLICE, closed, default_vocabulary, encoder

CAPACITY, END = 2048, 0
STEP, RATE, SLACK = 0.25, 1.0, 0.05
#: Configurations in a row that are not good enough, after which the knapsack is solved anew.
MISSES = 16


def _values(price: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The unbounded knapsack: the greatest price that fits into each room up to the capacity."""
    # a length is never taken where a shorter one has its price: only the others are tried
    tried = np.flatnonzero(price > np.maximum.accumulate(np.append(0, price[:-1])))
    price, lengths = price[tried], lengths[tried]
    value = np.zeros(capacity + 1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        k = fit[c]
        value[c] = max(value[c - 1], (price[:k] + value[c - lengths[:k]]).max()) if k else value[c - 1]
    return value


def _configuration(first: int, price: np.ndarray, value: np.ndarray, lengths: np.ndarray, room: int) -> np.ndarray:
    """Counts of the lengths with ``first`` among them: each next one has the best price with what can follow it; lengths without price are left out."""
    counts = np.zeros(len(lengths), np.int64)
    counts[first] = 1
    room -= int(lengths[first])
    while True:
        k = int(np.searchsorted(lengths, room, side="right"))
        if not k:
            return counts
        worth = np.where(price[:k] > 0, price[:k] + value[room - lengths[:k]], -1)
        # of equals the longest
        i = k - 1 - int(worth[::-1].argmax())
        if worth[i] <= 0:
            return counts
        counts[i] += 1
        room -= int(lengths[i])


def _fill(counts: np.ndarray, lengths: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """counts with the longest pieces added that fit and are left."""
    counts = counts.copy()
    while room > 0:
        k = int(np.searchsorted(lengths, room, side="right"))
        free = np.flatnonzero(left[:k] > counts[:k])
        if not len(free):
            break
        i = int(free[-1])
        n = min(int(left[i] - counts[i]), room // int(lengths[i]))
        counts[i] += n
        room -= n * int(lengths[i])
    return counts


def _rounded(plan, weight, lengths, demand, capacity, least) -> list[tuple[int, np.ndarray]]:
    """Steps that fill ``least`` or more, cut to whole sequences and to what is left, fullest first, its room filled; the rest best-fit."""
    left, out = demand.copy(), []

    def take(counts: np.ndarray, most: int) -> int:
        counts = _fill(counts, lengths, left, capacity - int((counts * lengths).sum()))
        on = counts > 0
        n = min(most, int((left[on] // counts[on]).min()))
        left[on] -= n * counts[on]
        out.append((n, counts))
        return n

    for counts, step in sorted(zip(plan, weight, strict=True), key=lambda x: -int((x[0] * lengths).sum())):
        on = counts > 0
        n = min(int(step), int((left[on] // counts[on]).min())) if int((counts * lengths).sum()) >= least else 0
        while n:
            n -= take(counts, n)
    while left.any():
        take(np.zeros(len(lengths), np.int64), int(left.max()))
    return out


def program(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[np.ndarray], list[float], float]:
    """Configurations and how many sequences each has, that cover the whole demand; and a bound that no packing is below.

    A step covers at least STEP of the demand for one length, so there are at
    most 1 / STEP steps a length, however many documents there are.
    """
    covered = np.zeros(len(lengths))
    plan: list[np.ndarray] = []
    weight: list[float] = []
    bound = 0.0
    while (covered < 1).any():
        price = np.where(covered < 1, lengths / capacity * np.exp(-RATE * covered), 0)
        value = _values(price, lengths, capacity)
        best = value[capacity]
        bound = max(bound, float(price @ demand) / best)
        untouched, misses = price.copy(), 0
        with_first = price + value[capacity - lengths]
        for i in np.argsort(-with_first, kind="stable").tolist():
            if not untouched[i]:
                continue
            if with_first[i] < (1 - SLACK) * best or misses == MISSES:
                break
            counts = _configuration(i, untouched, value, lengths, capacity)
            if float(price @ counts) < (1 - SLACK) * best:
                misses += 1
                continue
            misses = 0
            on = counts > 0
            step = max(1.0, STEP * float((demand[on] / counts[on]).min()))
            plan.append(counts)
            weight.append(step)
            covered += counts * step / demand
            untouched[on] = 0
    return plan, weight, bound


def configurations(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, dict[int, int]]], int]:
    """(sequences, {length: pieces in each}) that use up the histogram (pieces by length, from 0) exactly; and the least number that could."""
    lengths = np.flatnonzero(histogram)
    left = histogram[lengths].astype(np.int64)
    plan, weight, bound = program(lengths, left.astype(float), capacity)
    ways = (_rounded(plan, weight, lengths, left, capacity, least) for least in (capacity, 0))
    out = min(ways, key=lambda way: sum(n for n, _ in way))
    # the bound is that of exact prices; a hair is taken off for their rounding
    return [(n, {int(lengths[i]): int(c[i]) for i in np.flatnonzero(c)[::-1]}) for n, c in out], int(np.ceil(bound * (1 - 1e-9)))


@dataclass
class Slots:
    """For each length: ranks at which configurations begin, and of each its first sequence, pieces and offset."""

    by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sequences: int
    bound: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            begin, first, each, at = self.by[int(n)]
            rows = np.flatnonzero(length == n)
            k = np.searchsorted(begin, rank[rows], side="right") - 1
            nth = rank[rows] - begin[k]
            sequence[rows] = first[k] + nth // each[k]
            offset[rows] = at[k] + nth % each[k] * n
        return sequence, offset


def slots(plan: list[tuple[int, dict[int, int]]], bound: int = 0) -> Slots:
    by: dict[int, list] = {}
    used: dict[int, int] = {}
    total = 0
    for n, counts in plan:
        at = 0
        for length, c in counts.items():
            by.setdefault(length, []).append((used.get(length, 0), total, c, at))
            used[length] = used.get(length, 0) + n * c
            at += length * c
        total += n
    return Slots({k: tuple(np.array(v, np.int64).T) for k, v in by.items()}, total, bound)


def _pieces(vocabulary: str, end: int, capacity: int):
    def run(batches):
        part, task = TaskContext.get().partitionId(), encoder(vocabulary)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            raw, offsets = tk.string_buffers(batch.column(1))
            for i, j in tk.slices(offsets, SLICE):
                ids, first = closed(*task.encode(*tk.part(raw, offsets, i, j)), end)
                size = np.diff(first)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(j - i), count)
                piece = tk.expand(np.zeros(j - i, np.int64), count)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                order = np.argsort(length, kind="stable")
                new = np.bincount(length, minlength=capacity + 1)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - (np.cumsum(new) - new)[length[order]] + seen[length[order]]
                seen += new
                at = first[doc] + start
                crc = np.array([zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return run


def pack(docs: DataFrame, *, vocabulary: str | None = None, end: int = END, capacity: int = CAPACITY) -> tuple[DataFrame, Slots]:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; and the places of the sequences."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    pieces = materialise(plain.mapInArrow(_pieces(vocabulary or default_vocabulary(), end, capacity), kinds))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    rows = counts.groupBy("length").agg(F.sum("n").alias("n")).toArrow()
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[rows["length"].to_numpy()] = rows["n"].to_numpy()
    table = slots(*configurations(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))

    def place(batches):
        for b in batches:
            sequence, offset = table.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    own = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return own.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"), table
